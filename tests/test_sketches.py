"""Summaries kept per part and merged, against the whole table at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.operators import scaling, sketches
from tests.helpers import ordered


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(6)
    made = [(("a", "b")[i % 2], i % 5, float(v), float(v) + 1e6 if i % 3 else None) for i, v in enumerate(draw.exponential(10, 4000))]
    made += [("a", 0, float("nan"), None), ("c", 1, None, None), (None, 2, 1.0, 2.0)]
    return spark.createDataFrame(made, "dataset_id string, part int, sensor_1 double, sensor_2 double").cache()


def test_percentiles_of_merged_sketches_are_near_in_rank(rows):
    parts = [sketches.value_sketches(rows.where(F.col("part") == i), F.col("sensor_1"), ["dataset_id"]) for i in range(5)]
    merged = sketches.merged_sketches(sketches.union_of(parts), ["dataset_id"])
    shares = [0.01, 0.5, 0.95, 0.99]
    found = {r["dataset_id"]: r for r in sketches.sketched_percentiles(merged, shares, ["dataset_id"]).collect()}
    assert set(found) == {"a", "b", None}
    for name in ("a", "b"):
        values = np.array([r[0] for r in rows.where((F.col("dataset_id") == name) & ~F.isnan("sensor_1")).select("sensor_1").collect()])
        assert found[name]["n"] == len(values)
        for share, value in zip(shares, found[name]["percentiles"]):
            assert abs((values <= value).mean() - share) <= 0.005 + 1 / len(values)
    whole = sketches.merged_sketches(sketches.value_sketches(rows, F.col("sensor_1")))
    assert sketches.sketched_percentiles(whole, [0.5]).count() == 1


def test_engines_from_overlapping_parts(spark):
    parts = [sketches.engine_sketches(spark.range(i * 4000, i * 4000 + 9000).withColumnRenamed("id", "engine_id")) for i in range(3)]
    assert sketches.engines_estimated(sketches.union_of(parts)).first()[0] == pytest.approx(17_000, rel=0.03)
    again = sketches.engines_estimated(sketches.union_of([parts[0], parts[0]])).first()[0]
    assert again == pytest.approx(9000, rel=0.03)


def test_merged_moments_equal_a_refit(rows):
    names = ["sensor_1", "sensor_2"]
    for by in ([], ["dataset_id"]):
        parts = [sketches.moments(rows.where(F.col("part") == i), names, by) for i in range(5)]
        merged = sketches.merged_moments(sketches.union_of(parts), by)
        once = sketches.moments(rows, names, by)
        a, b = ordered(merged.na.fill("-", by), *by, "feature"), ordered(once.na.fill("-", by), *by, "feature")
        assert a["n"].tolist() == b["n"].tolist()
        for column in ("mean", "m2", "min", "max"):
            assert np.allclose(a[column].astype(float), b[column].astype(float), rtol=1e-9, equal_nan=True)
    merged = sketches.merged_moments(sketches.union_of([sketches.moments(rows.where(F.col("part") == i), names) for i in range(5)]))
    assert ordered(sketches.minmax_of(merged), "feature").equals(ordered(scaling.fit_minmax(rows, names), "feature"))
    fitted = ordered(scaling.fit_scaler(rows, names, "standard"), "feature")
    found = ordered(sketches.standard_of(merged), "feature")
    assert np.allclose(fitted.select_dtypes("number"), found[fitted.select_dtypes("number").columns], rtol=1e-9)
