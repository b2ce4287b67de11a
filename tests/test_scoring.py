import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.functions import payloads
from fleetspan.operators import evaluation, importance, scaling, scoring, splitting, windows
from fleetspan.plans import catalog
from tests.helpers import fleet, with_rul

KEYS = ["dataset_id", "unit"]
NAMES = ["sensor_1", "sensor_2"]


def load_mean():
    return lambda x: x[:, :, 0].mean(axis=1)


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(with_rul(fleet({("FD001", 1): 60, ("FD001", 2): 45})))
    return windows.sliding_windows(rows, 10, 1, NAMES).cache()


def test_every_window_is_scored(made):
    scored = scoring.score_windows(made, load_mean, 2, 10).collect()
    assert len(scored) == made.count()
    for row in scored:
        assert row["rul"] == pytest.approx(np.mean([step[0] for step in row["x"]])) and row["error"] is None


def test_wrong_shapes_and_failing_windows(spark):
    rows = spark.createDataFrame(
        [(1, [[1.0], [2.0]]), (2, [[1.0]]), (3, [[-5.0], [1.0]]), (4, [[1.0, 2.0], [3.0, 4.0]]), (5, None), (6, [[4.0], [6.0]])],
        "id int, x array<array<double>>",
    ).coalesce(1)

    def load():
        def predict(x):
            if (x < 0).any():
                raise ValueError("negative reading")
            return x.mean(axis=(1, 2))

        return predict

    found = {row["id"]: (row["rul"], row["error"]) for row in scoring.score_windows(rows, load, 1, 2).collect()}
    assert found == {
        1: (1.5, None),
        2: (None, "Input must have window_size=2 rows."),
        3: (None, "negative reading"),
        4: (None, "Every row must have 1 values."),
        5: (None, "Input must have window_size=2 rows."),
        6: (5.0, None),
    }


def test_windows_scale_like_readings(spark):
    frame = with_rul(fleet({("FD001", 1): 40}))
    rows = spark.createDataFrame(frame)
    scaler = scaling.fit_minmax(rows, NAMES)
    first = windows.sliding_windows(scaling.apply_minmax(rows, scaler), 10, 1, NAMES)
    after = scoring.scale_windows(windows.sliding_windows(rows, 10, 1, NAMES), scaler, NAMES)
    assert {row["window_end"]: row["x"] for row in first.collect()} == {row["window_end"]: row["x"] for row in after.collect()}


def test_payloads(spark):
    good = [[1.0, 2.0], [3.0, 4.0]]
    bodies = {
        1: {"data": good},
        2: {"data": good, "feature_names": ["sensor_2", "sensor_1"]},
        3: {"data": good, "feature_names": ["sensor_1", "other"]},
        4: {"data": good[:1]},
        5: {"data": [[1.0], [2.0, 3.0]]},
        6: {"data": good, "feature_names": []},
    }
    rows = spark.createDataFrame([(i, json.dumps(body)) for i, body in bodies.items()] + [(7, "{broken")], "id int, value string")
    checked = payloads.validate_windows(payloads.reorder_features(payloads.windows_from_payload(rows), NAMES), 2, 2)
    found = {row["id"]: (row["x"], row["error"]) for row in checked.collect()}
    assert found[1] == found[6] == (good, None)
    assert found[2] == ([[2.0, 1.0], [4.0, 3.0]], None)
    assert found[3] == (None, payloads.WRONG_NAMES)
    assert found[4][1] == found[7][1] == payloads.WRONG_ROWS.format(2)
    assert found[5][1] == payloads.WRONG_WIDTH.format(2)
    assert payloads.accepted(checked).count() == 3 and payloads.rejected(checked).count() == 4


@pytest.mark.parametrize("model", ["linear", "trees"])
def test_regressor_learns_a_trend(spark, model):
    frame = with_rul(fleet({("FD001", u): 60 for u in range(10)}))
    frame["sensor_1"] = frame["RUL"] * 0.5 + frame["sensor_2"] * 0.01
    rows = splitting.split_by_engine(spark.createDataFrame(frame))
    summaries = windows.window_summaries(rows, 10, 1, NAMES, ["split", *KEYS])
    inputs = [f"{name}_{part}" for name in NAMES for part in ("mean", "std", "slope", "last")]
    fitted = scoring.fit_rul_regressor(summaries, inputs, model)
    judged = evaluation.regression_metrics(scoring.predict_rul(summaries, fitted), ["split"])
    assert {row["split"] for row in judged.collect()} == {"train", "val"}
    assert judged.where("split = 'val'").first()["r2_score"] > 0.9
    with pytest.raises(ValueError):
        scoring.fit_rul_regressor(summaries, inputs, "forest")


def test_permutation_importance_against_brute_force(spark):
    frame = with_rul(fleet({("FD001", u): 40 for u in range(8)}))
    frame["RUL"] = frame["sensor_1"]
    rows = spark.createDataFrame(frame)
    made = windows.sliding_windows(rows, 5, 0, NAMES)
    predict = lambda x: x[:, -1, 0]
    ranked = {row["feature"]: row for row in importance.permutation_importance(made, NAMES, predict, KEYS, 40).collect()}
    assert ranked["sensor_1"]["rank"] == 1 and ranked["sensor_2"]["importance"] == 0.0
    # The exchanged series of one block are the block's own series.
    blocks = max(1, made.count() // 40)
    keyed = made.select(
        F.pmod(F.xxhash64(*KEYS, "window_end", F.lit(-1)), F.lit(blocks)).alias("block"),
        F.xxhash64(*KEYS, "window_end", F.lit(0)).alias("place"),
        F.element_at("x", -1)[0].alias("last"),
        "y",
    ).toPandas()
    total = 0.0
    for _, block in keyed.groupby("block"):
        block = block.sort_values("place")
        total += ((np.roll(block["last"], 1) - block["y"]) ** 2).sum()
    assert ranked["sensor_1"]["importance"] == pytest.approx(np.sqrt(total / len(keyed)))


def test_permutation_importance_exchanges_over_all_windows(spark):
    made = spark.range(10_400).select(
        F.lit("FD001").alias("dataset_id"), (F.col("id") % 40).alias("unit"), F.col("id").alias("window_end"),
        F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.sin("id"), F.lit(1.0))).alias("x"), F.sin("id").alias("y"),
    )
    found = importance.permutation_importance(made, ["sensor_1", "sensor_2"], lambda x: x[:, -1, 0], KEYS).collect()
    keyed = made.select(F.xxhash64(*KEYS, "window_end", F.lit(0)).alias("place"), "y").toPandas().sort_values("place")
    expected = np.sqrt(((np.roll(keyed["y"], 1) - keyed["y"]) ** 2).mean())
    assert {row["feature"]: row["importance"] for row in found} == {"sensor_1": pytest.approx(expected, rel=1e-12), "sensor_2": 0.0}
    empty = importance.permutation_importance(made.limit(0), ["sensor_1"], lambda x: x[:, -1, 0], KEYS).collect()
    assert [row["importance"] for row in empty] == [None]


def test_a_hanging_model_costs_only_its_windows(spark):
    rows = spark.range(40).select("id", F.array(F.array(F.col("id").cast("double"))).alias("x")).coalesce(1)

    def load():
        def predict(x):
            if (x % 13 == 5).any():
                time.sleep(60)
            return x[:, -1, 0]

        return predict

    found = {row["id"]: (row["rul"], row["error"]) for row in scoring.score_windows(rows, load, 1, 1, deadline=0.2, tries=40).collect()}
    assert found == {i: (None, "timeout") if i % 13 == 5 else (float(i), None) for i in range(40)}
    # Without tries left the rest of the batch is given up, and nothing waits for longer.
    start = time.time()
    given_up = scoring.score_windows(rows, load, 1, 1, deadline=0.2, tries=2).where("error = 'timeout'").count()
    assert 20 <= given_up <= 40 and time.time() - start < 30


def test_a_hanging_window_is_waited_for_once_besides_its_batch(spark):
    rows = spark.range(200).select("id", F.array(F.array(F.col("id").cast("double"))).alias("x")).coalesce(1)

    def load():
        def predict(x):
            if (x % 40 == 7).any():
                time.sleep(60)
            return x[:, -1, 0]

        return predict

    # One call for the batch, one for each of five windows, and one that is left.
    found = {row["id"]: (row["rul"], row["error"]) for row in scoring.score_windows(rows, load, 1, 1, deadline=0.3, tries=7).collect()}
    assert found == {i: (None, "timeout") if i % 40 == 7 else (float(i), None) for i in range(200)}


def test_importance_sends_windows_twice_whatever_the_number_of_features(spark):
    names = [f"sensor_{i}" for i in range(1, 13)]
    frame = with_rul(fleet({("FD001", u): 40 for u in range(4)}, sensors=names))
    made = windows.sliding_windows(spark.createDataFrame(frame), 5, 1, names)
    predict = lambda x: x[:, -1, 0] + 2 * x[:, 0, 11]
    found = {row["feature"]: row["importance"] for row in importance.permutation_importance(made, names, predict, KEYS).collect()}
    keyed = made.select("y", "x", *[F.xxhash64(*KEYS, "window_end", F.lit(i)).alias(f"p{i}") for i in range(12)]).toPandas()
    x, y = np.stack([np.stack(v) for v in keyed["x"]]), keyed["y"].to_numpy()
    base = np.sqrt(((predict(x) - y) ** 2).mean())
    for i, name in enumerate(names):
        order = np.argsort(keyed[f"p{i}"].to_numpy())
        other = x.copy()
        other[order, :, i] = x[np.roll(order, 1), :, i]
        assert found[name] == pytest.approx(np.sqrt(((predict(other) - y) ** 2).mean()) - base, abs=1e-9)
    stored = importance._kept_with_ids(made.select(*KEYS, "window_end", "x", "y"))
    donors = importance._donors(stored, [*KEYS, "window_end"], 12, lambda i: F.xxhash64(*KEYS, "window_end", F.lit(i)))
    text = importance._exchanged(stored, donors, 12)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in text.splitlines() if "values" in line or "x#" in line) <= 2


def test_windows_that_may_hang_are_dealt_to_all_cores(spark, tmp_path):
    events = spark.range(60 * 31).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id % 60 as user_id", "'view' as event_type", "double(id % 9) as value", "'{\"k\": 1}' as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    made = catalog.QUERIES["score_with_deadline"](spark, str(tmp_path))
    tasks = [row[0] for row in made.select(F.spark_partition_id()).collect()]
    assert len(tasks) == 60 and len(set(tasks)) >= spark.sparkContext.defaultParallelism
