"""Series operators give the same rows whether or not long engines are cut."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetspan.operators import features, labels, quantiles, splitting, windows
from fleetspan.operators.series import long_series, number_rows
from tests.helpers import brute_windows, fleet, ordered, with_rul

KEYS = ["dataset_id", "unit"]
# One engine holds a third of all rows and more.
SKEWED = {("FD001", 1): 400, ("FD002", 1): 90, ("FD001", 2): 31, ("FD001", 3): 30, ("FD002", 2): 29, ("FD002", 3): 300}


@pytest.fixture(scope="module")
def skewed(spark):
    frame = with_rul(fleet(SKEWED, gaps=True))
    return frame, spark.createDataFrame(frame).cache()


def test_rul_counts_down_to_zero(spark):
    rows = spark.createDataFrame([("FD001", u, c) for u in (1, 2) for c in range(1, 11)], "dataset_id string, unit int, cycle int")
    made = labels.remaining_useful_life(rows)
    for unit in (1, 2):
        assert [row["RUL"] for row in made.where(f"unit = {unit}").orderBy("cycle").collect()] == list(range(9, -1, -1))
    assert labels.remaining_useful_life(rows.limit(0)).count() == 0


def test_units_of_different_datasets_are_different_engines(spark):
    rows = spark.createDataFrame([("FD001", 1, 1), ("FD001", 1, 2), ("FD002", 1, 9)], "dataset_id string, unit int, cycle int")
    apart = {(row["dataset_id"], row["cycle"]): row["RUL"] for row in labels.remaining_useful_life(rows).collect()}
    assert apart == {("FD001", 1): 1.0, ("FD001", 2): 0.0, ("FD002", 9): 0.0}
    joined = {row["cycle"]: row["RUL"] for row in labels.remaining_useful_life(rows, keys=["unit"]).collect()}
    assert joined == {1: 8.0, 2: 7.0, 9: 0.0}


def test_engine_without_listed_life_keeps_its_rows(spark):
    rows = spark.createDataFrame([("FD001", 1, 1), ("FD001", 2, 1)], "dataset_id string, unit int, cycle int")
    ends = spark.createDataFrame([("FD001", 1, 10)], "dataset_id string, unit int, rul_at_end int")
    assert sorted((row["unit"], row["RUL"]) for row in labels.remaining_useful_life(rows, ends).collect()) == [(1, 10.0), (2, None)]


def test_missing_keys_form_one_engine(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 1, 5)], "dataset_id string, unit int, cycle int")
    assert sorted(row["RUL"] for row in labels.remaining_useful_life(rows).collect()) == [0.0, 4.0]


@pytest.mark.parametrize("limit", [10, 50])
def test_labels_do_not_depend_on_the_broadcast_bound(spark, skewed, monkeypatch, limit):
    frame, rows = skewed
    monkeypatch.setattr("fleetspan.shared.BROADCAST_BYTES", 200)
    monkeypatch.setattr("fleetspan.operators.labels.CROWDED", 250)
    made = ordered(labels.remaining_useful_life(rows.drop("RUL")), *KEYS, "cycle")
    wanted = frame.sort_values([*KEYS, "cycle"]).reset_index(drop=True)
    assert (made["RUL"] == wanted["RUL"]).all() and len(made) == len(wanted)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 100, 7])
def test_row_numbers(skewed, rows_per_task):
    frame, rows = skewed
    made = ordered(number_rows(rows, KEYS, ["cycle"], "at", "of", rows_per_task), *KEYS, "cycle")
    wanted = frame.sort_values([*KEYS, "cycle"]).reset_index(drop=True)
    groups = wanted.groupby(KEYS)
    assert (made["at"] == groups.cumcount() + 1).all()
    assert (made["of"] == groups["cycle"].transform("size")).all()


@pytest.mark.parametrize("rows_per_task", [1_000_000, 60])
@pytest.mark.parametrize("horizon", [0, 1, 5])
def test_sliding_windows_against_brute_force(skewed, rows_per_task, horizon):
    frame, rows = skewed
    names = ["sensor_1", "sensor_2"]
    made = windows.sliding_windows(rows, 30, horizon, names, rows_per_task=rows_per_task)
    found = {(row["dataset_id"], row["unit"], row["window_end"]): (row["x"], row["y"]) for row in made.collect()}
    assert found == brute_windows(frame, 30, horizon, names)
    assert len(found) == sum(max(0, n - 30 - horizon + 1) for n in SKEWED.values())


# Orders that doubles can't tell apart, that have no number, or that lie dense, tie or are all equal.
ORDERS = {
    "decimal": ("decimal(38,0)", [10**30 + i for i in range(100)]),
    "nanoseconds": ("bigint", [1_700_000_000_000_000_000 + i for i in range(300)]),
    "text": ("string", [f"{i:05d}" for i in range(300)]),
    "wall clock": ("timestamp_ntz", [pd.Timestamp("2024-03-31") + pd.Timedelta(microseconds=i) for i in range(200)]),
    "log-spread": ("double", sorted(float(x) for x in np.exp(np.linspace(-300, 300, 400)))),
    "all equal": ("double", [1.5] * 300),
    "half tied": ("double", [2.0] * 200 + [float(i) for i in range(3, 203)]),
}


@pytest.mark.parametrize("name", ORDERS)
def test_numbers_keep_the_order_of_any_type(spark, name):
    kind, values = ORDERS[name]
    frame = spark.createDataFrame([(7, i, str(v)) for i, v in enumerate(values)], "unit int, place int, text string")
    rows = frame.withColumn("at", F.col("text").cast(kind)).repartition(5)
    plain = number_rows(rows, ["unit"], ["at", "place"])
    pieces = number_rows(rows, ["unit"], ["at", "place"], length="of", rows_per_task=20)
    assert sorted((r["place"], r["_rn"]) for r in pieces.collect()) == sorted((r["place"], r["_rn"]) for r in plain.collect())
    assert pieces.where("_rn <> place + 1").count() == 0
    assert pieces.where(f"of <> {len(values)}").count() == 0


def test_perfect_predictions_have_percentiles(spark):
    rows = spark.range(1000).select(F.lit(0.0).alias("error"))
    found = quantiles.percentiles(rows, "error", [0.5, 0.95], rows_per_task=100).first()
    assert found["percentiles"] == [0.0, 0.0]


def test_ties_are_cut_by_the_next_order_column(spark):
    rows = spark.createDataFrame([("FD001", 1, 5, e) for e in range(500)] + [("FD001", 1, 6, 7)], "dataset_id string, unit int, cycle int, event int")
    made = number_rows(rows, KEYS, ["cycle", "event"], rows_per_task=50)
    assert made.where("cycle = 5 and _rn <> event + 1").count() == 0
    assert made.where("cycle = 6").first()["_rn"] == 501


def test_readings_of_one_moment_are_dealt(spark):
    rows = spark.createDataFrame([("FD001", 1, 5, float(e)) for e in range(1000)] + [("FD001", 1, c, 0.0) for c in (1, 9)], "dataset_id string, unit int, cycle int, sensor_1 double")
    made = number_rows(rows, KEYS, ["cycle"], rows_per_task=50)
    assert sorted(row["_rn"] for row in made.collect()) == list(range(1, 1003))
    assert {row["cycle"]: row["_rn"] for row in made.where("cycle <> 5").collect()} == {1: 1, 9: 1002}


def test_copies_are_counted_and_spread(spark):
    lines = [("FD001", 1, 5, 2.0)] * 1000 + [("FD001", 1, c, float(c)) for c in range(1, 5)] + [("FD001", 1, c, float(c)) for c in range(6, 300)]
    rows = spark.createDataFrame(lines, "dataset_id string, unit int, cycle int, sensor_1 double")
    made = number_rows(rows, KEYS, ["cycle"], rows_per_task=50)
    assert sorted(row["_rn"] for row in made.collect()) == list(range(1, 1299))
    assert sorted(map(tuple, made.select(*rows.columns).collect())) == sorted(lines)
    assert made.where("cycle > 5 and _rn <> cycle + 999").count() == 0
    labelled = rows.withColumn("RUL", F.lit(0.0))
    plain = windows.sliding_windows(labelled, 30, 1, ["sensor_1"])
    pieces = windows.sliding_windows(labelled, 30, 1, ["sensor_1"], rows_per_task=50)
    as_rows = lambda df: sorted((row["window_end"], row["x"]) for row in df.collect())
    assert as_rows(plain) == as_rows(pieces)


def test_missing_order_values_come_last(spark):
    rows = spark.createDataFrame([("FD001", 1, c, i) for i, c in enumerate([None] * 40 + [3] * 40 + list(range(100)))], "dataset_id string, unit int, cycle int, place int")
    plain = ordered(number_rows(rows, KEYS, ["cycle", "place"]), "_rn")
    pieces = ordered(number_rows(rows, KEYS, ["cycle", "place"], rows_per_task=10), "_rn")
    pd.testing.assert_frame_equal(plain, pieces)


def test_no_long_series_needs_no_pieces(skewed):
    _, rows = skewed
    assert long_series(rows, KEYS, 400) is None
    assert long_series(rows, KEYS, 399).table.rows == 1


def test_latest_windows(skewed):
    frame, rows = skewed
    brute = {}
    for key, group in frame.groupby(KEYS):
        group = group.sort_values("cycle")
        if len(group) >= 30:
            brute[key] = group[["sensor_1", "sensor_2"]].to_numpy()[-30:].tolist()
    for options in ({}, {"window": 30}):
        made = windows.latest_windows(rows.drop("RUL"), **options)
        assert {(row["dataset_id"], row["unit"]): row["x"] for row in made.collect()} == brute


def test_latest_windows_beyond_the_rank_limit(skewed, monkeypatch):
    _, rows = skewed
    wanted = ordered(windows.latest_windows(rows.drop("RUL")), *KEYS)
    monkeypatch.setattr("fleetspan.operators.windows.RANK_LIMIT", 5)
    made = ordered(windows.latest_windows(rows.drop("RUL"), rows_per_task=70), *KEYS)
    assert wanted["window_end"].equals(made["window_end"]) and len(made) == 5


def test_windows_keep_missing_values_and_missing_targets(spark):
    rows = spark.createDataFrame(
        [("FD001", 1, 1, None, None), ("FD001", 1, 2, 2.0, None), ("FD001", 1, 3, 3.0, None)],
        "dataset_id string, unit int, cycle int, sensor_1 double, RUL double",
    )
    made = windows.sliding_windows(rows, 2, 1, ["sensor_1"]).collect()
    assert [(row["window_end"], row["x"], row["y"]) for row in made] == [(2, [[None], [2.0]], None)]


def test_small_fixture_targets(spark):
    rows = spark.createDataFrame(
        [("FD001", u, c, 0.5, rul) for u, start in ((1, 100.0), (2, 95.0)) for c, rul in ((1, start), (2, start - 1), (3, start - 2))],
        "dataset_id string, unit int, cycle int, sensor_1 double, RUL double",
    )
    assert windows.sliding_windows(rows).count() == 0
    assert sorted(row["y"] for row in windows.sliding_windows(rows, 2, 1).collect()) == [93.0, 98.0]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 60])
def test_window_summaries(skewed, rows_per_task):
    frame, rows = skewed
    made = windows.window_summaries(rows, features=["sensor_1"], rows_per_task=rows_per_task)
    brute = brute_windows(frame, 30, 1, ["cycle", "sensor_1"])
    assert made.count() == len(brute)
    for row in made.where("dataset_id = 'FD002'").collect():
        x, y = brute[(row["dataset_id"], row["unit"], row["window_end"])]
        x = np.array(x)
        assert row["sensor_1_mean"] == pytest.approx(x[:, 1].mean())
        assert row["sensor_1_std"] == pytest.approx(x[:, 1].std())
        assert row["sensor_1_slope"] == pytest.approx(np.polyfit(x[:, 0], x[:, 1], 1)[0])
        assert (row["sensor_1_last"], row["y"]) == (x[-1, 1], y)


def test_summaries_leave_missing_values_out(spark):
    lines = [("FD001", 1, 1, 2.0, None, 9.0), ("FD001", 1, 2, None, None, 8.0), ("FD001", 1, 4, 5.0, 1.0, 7.0)]
    rows = spark.createDataFrame(lines, "dataset_id string, unit int, cycle int, sensor_1 double, sensor_2 double, RUL double")
    row = windows.window_summaries(rows, 3, 0).first()
    assert (row["sensor_1_mean"], row["sensor_1_std"], row["sensor_1_slope"], row["sensor_1_last"]) == (3.5, 1.5, 1.0, 5.0)
    assert (row["sensor_2_mean"], row["sensor_2_std"], row["sensor_2_slope"], row["y"]) == (1.0, 0.0, None, 7.0)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40])
def test_engineered_features(skewed, rows_per_task):
    frame, rows = skewed
    made = ordered(features.engineered_features(rows, ["sensor_1"], rows_per_task=rows_per_task), *KEYS, "cycle")
    wanted = frame.sort_values([*KEYS, "cycle"]).reset_index(drop=True)
    group = wanted.groupby(KEYS)["sensor_1"]
    rolled = group.rolling(5, min_periods=1)
    for name, values in (
        ("sensor_1_mean_5", rolled.mean()),
        ("sensor_1_std_5", rolled.std(ddof=0)),
        ("sensor_1_min_5", rolled.min()),
        ("sensor_1_max_5", rolled.max()),
    ):
        np.testing.assert_allclose(made[name], values.reset_index(drop=True), atol=1e-6)
    for step in (1, 2, 3):
        np.testing.assert_allclose(made[f"sensor_1_lag_{step}"], group.shift(step))
    np.testing.assert_allclose(made["sensor_1_diff"], group.diff())


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40])
@pytest.mark.parametrize("strategy", features.STRATEGIES)
def test_repair_of_missing_values(spark, rows_per_task, strategy):
    frame = fleet(SKEWED, 3)
    draw = np.random.default_rng(5)
    frame.loc[draw.random(len(frame)) < 0.4, "sensor_1"] = np.nan
    # A gap longer than any piece.
    frame.loc[(frame["unit"] == 1) & frame["cycle"].between(50, 250), "sensor_1"] = np.nan
    made = ordered(features.repair_missing(spark.createDataFrame(frame), strategy, rows_per_task=rows_per_task), *KEYS, "cycle")
    wanted = frame.sort_values([*KEYS, "cycle"]).reset_index(drop=True)
    group = wanted.groupby(KEYS)["sensor_1"]
    if strategy == "drop":
        wanted = wanted.dropna(subset=["sensor_1"]).reset_index(drop=True)
    elif strategy == "interpolate":
        wanted["sensor_1"] = group.transform(lambda values: values.interpolate())
    else:
        wanted["sensor_1"] = wanted["sensor_1"].fillna(group.transform("mean" if strategy == "fill_mean" else "median"))
    assert len(made) == len(wanted)
    np.testing.assert_allclose(made["sensor_1"], wanted["sensor_1"])


def test_interpolation_fixture(spark):
    rows = spark.createDataFrame([("FD001", 1, i + 1, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "dataset_id string, unit int, cycle int, sensor_1 double")
    made = features.repair_missing(rows).orderBy("cycle").collect()
    assert [row["sensor_1"] for row in made] == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    with pytest.raises(ValueError):
        features.repair_missing(rows, "guess")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=120))
def test_percentiles_match_numpy(spark, values):
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = np.percentile(values, [100 * share for share in shares])
    for rows_per_task in (1_000_000, 5):
        found = quantiles.percentiles(rows, "v", shares, rows_per_task=rows_per_task).first()[0]
        np.testing.assert_allclose(found, wanted, rtol=1e-9, atol=1e-9)


def test_percentiles_per_key_leave_missing_values_out(spark, skewed):
    frame, rows = skewed
    holed = rows.withColumn("v", F.when(F.col("cycle") % 3 > 0, F.col("sensor_1")))
    wanted = frame.assign(v=frame["sensor_1"].where(frame["cycle"] % 3 > 0)).groupby(KEYS)["v"].quantile([0.1, 0.5])
    for rows_per_task in (1_000_000, 20):
        made = quantiles.percentiles(holed, "v", [0.1, 0.5], KEYS, rows_per_task=rows_per_task)
        for row in made.collect():
            for share, value in zip((0.1, 0.5), row["percentiles"]):
                assert value == pytest.approx(wanted[(row["dataset_id"], row["unit"], share)])


def test_equal_values_need_no_sorting(spark):
    rows = spark.createDataFrame([(1.0,)] * 500 + [(2.0,)] * 400 + [(3.0,)] * 10, "v double")
    assert quantiles.percentiles(rows, "v", [0.5, 0.6, 0.995], rows_per_task=20).first()[0] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 5])
def test_split_is_exact_disjoint_and_repeatable(spark, rows_per_task):
    rows = spark.createDataFrame([(f"FD00{u % 4}", u, c) for u in range(57) for c in range(3)], "dataset_id string, unit int, cycle int")
    sides = splitting.split_by_engine(rows, 0.2, rows_per_task=rows_per_task)
    assert sides.count() == rows.count()
    per_engine = sides.groupBy("dataset_id", "unit").agg(F.countDistinct("split").alias("sides"), F.first("split").alias("split"))
    assert per_engine.where("sides > 1").count() == 0
    assert per_engine.where("split = 'val'").count() == 11
    again = splitting.split_by_engine(rows.repartition(7), 0.2)
    assert set(map(tuple, again.collect())) == set(map(tuple, sides.collect()))
    other = splitting.split_by_engine(rows, 0.2, seed=7)
    assert set(map(tuple, other.collect())) != set(map(tuple, sides.collect()))


def test_split_fills_up_engines_of_equal_hash(spark):
    rows = spark.createDataFrame([("FD001", u) for u in range(10)], "dataset_id string, unit int")
    made = splitting.split_by_engine(rows, 0.5, order=lambda dataset, unit: F.floor(unit / 4))
    assert sorted(row["unit"] for row in splitting.side(made, "val").collect()) == [0, 1, 2, 3, 4]


def test_split_by_share_is_about_right(spark):
    rows = spark.range(5000).select(F.lit("FD001").alias("dataset_id"), F.col("id").alias("unit"))
    assert 850 < splitting.split_by_share(rows).where("split = 'val'").count() < 1150


def test_results_do_not_depend_on_the_shuffle_width(spark, skewed):
    _, rows = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for width in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        found.append(ordered(windows.sliding_windows(rows, rows_per_task=80).drop("x"), *KEYS, "window_end"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    pd.testing.assert_frame_equal(*found)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_times_are_cut_in_their_order(spark, kind):
    # Two hours around a change of the clocks, and some days.
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        step = "make_interval(0, 0, 0, id * 3)" if kind == "date" else "make_interval(0, 0, 0, 0, 0, 0, id * 30)"
        start = "date'2024-01-01'" if kind == "date" else "timestamp_ntz'2024-03-10 01:00:00'"
        rows = spark.range(400).selectExpr("'FD001' AS dataset_id", "1 AS unit", "id", f"CAST({start} + {step} AS {kind}) AS at")
        plain = ordered(number_rows(rows, KEYS, ["at", "id"]).select("id", "_rn"), "id")
        pieces = ordered(number_rows(rows, KEYS, ["at", "id"], rows_per_task=20).select("id", "_rn"), "id")
        pd.testing.assert_frame_equal(plain, pieces)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
