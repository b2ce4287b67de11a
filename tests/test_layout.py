"""Readings stored by engine: values, plans, ties and running summaries."""

import contextlib
import io
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.operators import features, labels, windows
from fleetspan.operators.layout import open_series, store_series
from fleetspan.operators.series import last_rows
from fleetspan.operators.summaries import series_moments, summarised
from fleetspan.plans.prepare import prepare_fleet, prepare_layout, prepare_windows
from tests.helpers import brute_windows, fleet, with_rul

KEYS = ["dataset_id", "unit"]
NAMES = ["sensor_1", "sensor_2"]


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def frame():
    return with_rul(fleet({("FD001", u): 40 + u for u in range(5)} | {("FD002", 1): 300, ("FD002", 2): 7}, gaps=True))


@pytest.fixture(scope="module")
def table(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "readings")
    spark.createDataFrame(frame).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module", params=[250_000, 50])
def stored(spark, table, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp("layout") / "series")
    store_series(table.drop("RUL"), path, rows_per_task=request.param)
    return open_series(spark, path)


def test_a_layout_holds_every_reading_and_its_label(table, stored):
    assert (stored.chunks is None) == (stored.ordinary.count() == table.count())
    labelled = stored.labelled()
    assert rows_of(labelled.readings()) == rows_of(table.select(labelled.columns))
    assert rows_of(stored.lifetimes()) == rows_of(labels.engine_lifetimes(table))
    assert stored.engines().count() == 7


def test_windows_features_and_summaries_from_a_layout(frame, table, stored):
    labelled = stored.labelled()
    made = windows.sliding_windows(labelled, features=NAMES)
    found = {(r["dataset_id"], r["unit"], r["window_end"]): (r["x"], r["y"]) for r in made.collect()}
    assert found == brute_windows(frame, 30, 1, NAMES) and made.count() == len(found)
    assert rows_of(windows.latest_windows(stored, features=NAMES)) == rows_of(windows.latest_windows(table, features=NAMES))
    cut = features.engineered_features(stored, NAMES)
    whole = features.engineered_features(table.drop("RUL"), NAMES)
    rounded = lambda df: rows_of(df.select(*[F.round(name, 9) if name.startswith("sensor") else name for name in whole.columns]))
    assert rounded(cut) == rounded(whole)
    a, b = (windows.window_summaries(df, features=NAMES) for df in (labelled, table))
    assert rows_of(a) == rows_of(b) or np.allclose(
        a.orderBy(*KEYS, "window_end").toPandas().iloc[:, 3:], b.orderBy(*KEYS, "window_end").toPandas().iloc[:, 3:], rtol=1e-12, atol=1e-12)


def test_nothing_from_a_layout_is_shuffled(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        labelled = stored.labelled()
        for made in (
            labelled.readings(),
            stored.lifetimes(),
            windows.sliding_windows(labelled, features=NAMES),
            windows.window_summaries(labelled, features=NAMES),
            features.engineered_features(stored, NAMES),
        ):
            text = plan(made)
            assert "Exchange" not in text and "Join" not in text
            # A window keeps the scan in buckets; without it files could be split.
            assert "Window" not in text or "Bucketed: false" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_preparation_from_one_layout_equals_preparation_step_by_step(spark, table):
    rows = table.drop("RUL")
    left = spark.createDataFrame([("FD001", u, 5 * u) for u in range(4)], "dataset_id string, unit int, rul_at_end int")
    stepwise = prepare_fleet(rows, rows, left)
    for rows_per_task in (250_000, 50):
        made = prepare_layout(rows, rows, left, rows_per_task=rows_per_task)
        assert rows_of(made.readings.select(stepwise.readings.columns)) == rows_of(stepwise.readings)
        assert rows_of(made.scaler) == rows_of(stepwise.scaler)
        assert rows_of(prepare_windows(made, features=NAMES)) == rows_of(prepare_windows(stepwise, features=NAMES))


def test_odd_tables(spark, table, tmp_path):
    empty = store_series(table.limit(0).drop("RUL"), str(tmp_path / "empty"))
    assert windows.sliding_windows(empty.labelled(), features=NAMES).count() == 0
    odd = spark.createDataFrame([(None, 1, c, float(c)) for c in range(40)] + [("a", None, None, None)] * 3, "dataset_id string, unit int, cycle int, sensor_1 double")
    held = store_series(odd, str(tmp_path / "odd"))
    assert rows_of(held.readings()) == rows_of(odd)
    assert windows.sliding_windows(held.labelled()).count() == 10
    cut = store_series(odd, str(tmp_path / "cut"), rows_per_task=20)
    assert rows_of(cut.readings()) == rows_of(odd)
    assert rows_of(windows.sliding_windows(cut.labelled())) == rows_of(windows.sliding_windows(held.labelled()))
    with pytest.raises(ValueError, match="frames of"):
        windows.sliding_windows(cut.labelled(), 40)
    with pytest.raises(ValueError, match="the layout is by"):
        windows.sliding_windows(held.labelled(), keys=["unit"])
    with pytest.raises(ValueError, match="clash"):
        store_series(odd.withColumn("_n", F.lit(1)), str(tmp_path / "clash"))


def test_tied_readings_agree_for_all_partitionings_cut_and_whole(spark):
    draw = np.random.default_rng(4)
    rows = [("a", 1, int(i // 9), float(v)) for i, v in enumerate(draw.normal(0, 1, 200))] + [("a", 1, 3, 7.0)] * 4 + [("a", 2, 1, 2.0), ("a", 2, 1, 3.0)]
    base = spark.createDataFrame(rows, "dataset_id string, unit int, cycle int, sensor_1 double").withColumn(
        "sensor_2", F.when(F.col("sensor_1") > -0.5, F.col("sensor_1")))
    makers = {
        "windows": lambda df, n: windows.sliding_windows(df, 5, 1, ["sensor_1"], target=None, rows_per_task=n),
        "summaries": lambda df, n: windows.window_summaries(df, 5, 1, ["sensor_1"], target=None, rows_per_task=n).select(*KEYS, "window_end", F.round("sensor_1_mean", 9), "sensor_1_last"),
        "features": lambda df, n: features.lag_features(df, ["sensor_1"], rows_per_task=n),
        "repair": lambda df, n: features.repair_missing(df, "interpolate", ["sensor_2"], rows_per_task=n).withColumn("sensor_2", F.round("sensor_2", 9)),
        "latest": lambda df, n: windows.latest_windows(df, 5, ["sensor_1"], rows_per_task=n),
        "last": lambda df, n: last_rows(df, KEYS, ["cycle"], 20),
    }
    for name, make in makers.items():
        answers = [rows_of(make(df, n)) for df in (base.coalesce(1), base.repartition(5, "sensor_1")) for n in (250_000, 30)]
        assert all(answer == answers[0] for answer in answers), name


def brute_moments(time, values):
    made = []
    for i in range(values.shape[1]):
        there = ~np.isnan(values[:, i])
        x, both = values[there, i], there & ~np.isnan(time)
        mean, std = (x.mean(), x.std()) if len(x) else (math.nan, math.nan)
        t, v = time[both], values[both, i]
        spread = ((t - t.mean()) ** 2).sum() if len(t) else 0.0
        slope = ((t - t.mean()) * (v - v.mean())).sum() / spread if spread else math.nan
        made.append((mean, std, slope))
    return np.array(made).T.reshape(-1)


@pytest.mark.parametrize("window", [1, 2, 7, 30])
def test_running_moments_against_every_window_by_itself(window):
    draw = np.random.default_rng(window)
    sizes = [1, window - 1 or 1, window, window + 1, 3 * window + 2, 100]
    n = sum(sizes)
    values = draw.normal(1e3, 5, (n, 3))
    values[draw.random((n, 3)) < 0.2] = np.nan
    values[:, 2] = 0.1
    time = np.concatenate([np.cumsum(draw.integers(1, 4, size)).astype(float) for size in sizes])
    time[draw.random(n) < 0.05] = np.nan
    starts = np.cumsum([0, *sizes[:-1]])
    ends, found = series_moments(time, values, starts, window)
    wanted = [e for s, size in zip(starts, sizes) for e in range(s + window - 1, s + size)]
    assert ends.tolist() == wanted
    for end, got in zip(ends, found):
        expected = brute_moments(time[end + 1 - window : end + 1], values[end + 1 - window : end + 1])
        assert np.allclose(got, expected, rtol=1e-9, atol=1e-9, equal_nan=True)
    # Equal values deviate by nothing at all.
    assert (found[:, 5] == 0).all()


def test_series_go_on_over_batches_and_infinities_stay_in_their_windows():
    window, horizon = 6, 2
    draw = np.random.default_rng(0)
    series = np.repeat([5, 5, 9, 4], [1, 40, 3, 60])
    n = len(series)
    x = draw.normal(0, 1, n)
    x[60] = np.inf
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in ("window_end", "x_mean", "x_std", "x_slope", "x_last", "y")])
    batch = pa.RecordBatch.from_pydict(
        {"_series": series, "_end": np.arange(n, dtype=float), "_time": np.arange(n, dtype=float), "_own": np.ones(n, bool), "x": x, "_y": -x})
    answers = []
    for step in (1, 2, 5, 17, n):
        run = summarised([], window, horizon, ["x"], True, schema)
        parts = [b.to_pydict() for b in run(iter([batch.slice(i, step) for i in range(0, n, step)]))]
        answers.append({end: (m, s, y) for p in parts for end, m, s, y in zip(p["window_end"], p["x_mean"], p["x_std"], p["y"])})
    assert len(answers[0]) == (41 - 7) + (60 - 7)
    for answer in answers:
        assert answer.keys() == answers[0].keys()
        for end, (mean, std, y) in answer.items():
            part = x[int(end) - 5 : int(end) + 1]
            assert y == -x[int(end) + horizon]
            if np.isfinite(part).all():
                assert mean == pytest.approx(part.mean()) and std == pytest.approx(part.std())
            else:
                assert mean == math.inf and std is None
