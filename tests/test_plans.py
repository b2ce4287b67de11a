"""The physical plans stay what they were designed to be."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import features, history, labels, profiling, scoring, splitting, windows
from fleetspan.plans.catalog import load_model
from fleetspan.streaming import messages
from tests.helpers import fleet, with_rul


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def shuffles(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "readings")
    spark.createDataFrame(with_rul(fleet({("FD001", u): 40 for u in range(5)}))).write.parquet(path)
    return spark.read.parquet(path)


def test_labels_do_not_shuffle_readings(stored):
    made = labels.remaining_useful_life(stored.drop("RUL"))
    assert "Exchange hashpartitioning" not in plan(made) and "BroadcastHashJoin" in plan(made)


def test_split_needs_neither_join_nor_shuffle(stored):
    text = plan(splitting.split_by_engine(stored))
    assert "Exchange" not in text and "Join" not in text


def test_windows_share_one_shuffle_and_one_sort(stored):
    for made in (
        windows.sliding_windows(stored, features=["sensor_1"]),
        windows.window_summaries(stored, features=["sensor_1", "sensor_2"]),
        features.engineered_features(stored),
    ):
        assert shuffles(made) == 1 and plan(made).count("Sort [") == 1


def test_scan_reads_only_what_is_used(stored):
    text = plan(windows.sliding_windows(stored, features=["sensor_1"]))
    assert "sensor_2" not in text
    text = plan(labels.engine_lifetimes(stored))
    assert "sensor" not in text


def test_filter_on_an_engine_reaches_the_scan(stored):
    text = plan(labels.remaining_useful_life(stored.drop("RUL")).where(F.col("unit") == 3))
    assert "EqualTo(unit,3)" in text


def test_newest_rows_are_cut_before_the_shuffle(spark, stored):
    text = plan(windows.latest_windows(stored.drop("RUL")))
    assert text.index("Exchange hashpartitioning") < text.index("Partial", text.index("WindowGroupLimit"))
    runs = spark.createDataFrame([("a", "x", 1.0)], "experiment string, name string, val_loss double")
    assert "Partial" in plan(history.best_runs(runs, 3, ["experiment"]))


def test_scores_travel_in_arrow_batches(stored):
    scored = scoring.score_windows(windows.sliding_windows(stored, features=["sensor_1", "sensor_2"]), load_model, 2)
    text = plan(scored)
    assert "ArrowEvalPython" in text and "BatchEvalPython" not in text


def test_messages_are_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "value string")
    assert plan(messages.valid_messages(messages.decode_messages(rows))).count("from_json(") == 1


def test_correlation_is_one_pass_over_the_products(stored):
    text = plan(profiling.correlation_matrix(stored, ["sensor_1", "sensor_2", "RUL"]))
    assert text.count("Scan parquet") == 1
