import os

import pytest
from pyspark.sql import functions as F

from fleetspan.operators.importance import rank_features
from fleetspan.operators.labels import remaining_useful_life
from fleetspan.operators.scaling import apply_minmax, fit_minmax
from fleetspan.operators.splitting import split_by_engine
from fleetspan.operators.windows import sliding_windows
from fleetspan.plans.prepare import prepare_fleet, prepare_windows
from fleetspan.schema import FEATURES
from fleetspan.sources import tables, text, versions


def write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w") as file:
        file.write("\n".join(lines) + "\n")
    return path


def reading_lines(units, cycles, tail=" "):
    sensors = " ".join(f"{0.1 * i:.1f}" for i in range(1, 22))
    return [f"{u} {c} 0.5 0.3 0.2 {sensors}{tail}" for u in range(1, units + 1) for c in range(1, cycles + 1)]


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "train_FD001.txt", reading_lines(3, 20))
    write(tmp_path, "test_FD001.txt", reading_lines(2, 15))
    write(tmp_path, "RUL_FD001.txt", ["10 ", "15"])
    write(tmp_path, "train_FD002.txt", reading_lines(1, 4))
    write(tmp_path, "test_FD002.txt", reading_lines(1, 4))
    write(tmp_path, "RUL_FD002.txt", ["7"])
    return str(tmp_path)


def test_text_is_read_with_fixed_types(spark, folder):
    rows = text.read_fleet(spark, folder, datasets=["FD001"])
    assert rows.columns == ["dataset_id", "unit", "cycle", *FEATURES]
    assert dict(rows.dtypes)["unit"] == "int" and dict(rows.dtypes)["sensor_21"] == "double"
    assert rows.count() == 60
    first = rows.where("unit = 1 and cycle = 1").first()
    assert first["sensor_21"] == 2.1 and first["op_setting_1"] == 0.5


def test_datasets_are_tagged_in_one_scan(spark, folder):
    rows = text.read_fleet(spark, folder, datasets=["FD001", "FD002"])
    assert {row["dataset_id"]: row["count"] for row in rows.groupBy("dataset_id").count().collect()} == {"FD001": 60, "FD002": 4}


def test_blanks_and_bad_lines(spark, tmp_path):
    good = reading_lines(1, 2)
    path = write(tmp_path, "train_FD001.txt", ["   " + good[0].replace(" ", "   ") + " \t ", "", "   ", good[1], "1 3 0.5", good[0].replace("0.5", "abc")])
    kept = text.read_sensor_text(spark, path)
    assert kept.count() == 4
    assert kept.where("_corrupt is null").count() == 2
    assert kept.where("_corrupt is not null and unit is null").count() == 2
    assert text.read_sensor_text(spark, path, "drop").count() == 2
    with pytest.raises(Exception, match="unreadable line"):
        text.read_sensor_text(spark, path, "fail").collect()


def test_ids_are_whole_numbers_in_range(spark, tmp_path):
    rest = reading_lines(1, 1)[0].split(maxsplit=2)[2]
    path = write(tmp_path, "train_FD001.txt", [f"{ids} {rest}" for ids in ("3000000000 1", "1.7 1", "4 1.5", "4 2.0")])
    kept = text.read_sensor_text(spark, path)
    assert [(row["unit"], row["cycle"]) for row in kept.where("_corrupt is null").collect()] == [(4, 2)]
    assert kept.where("_corrupt is not null and unit is null and cycle is null").count() == 3


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        text.read_fleet(spark, str(tmp_path), datasets=["INVALID"])
    write(tmp_path, "train_FD001.txt", [" "])
    with pytest.raises(ValueError):
        text.read_fleet(spark, str(tmp_path), datasets=["FD001"])


def test_engine_id_is_the_line_number(spark, folder):
    ends = text.read_rul_at_end(spark, folder, ["FD001", "FD002"])
    assert sorted(map(tuple, ends.collect())) == [("FD001", 1, 10), ("FD001", 2, 15), ("FD002", 1, 7)]
    running = text.read_rul_at_end(spark, folder, ["FD001", "FD002"], continuous=True)
    assert sorted((row["unit"], row["rul_at_end"]) for row in running.collect()) == [(1, 10), (2, 15), (3, 7)]


def test_line_numbers_across_file_blocks(spark, tmp_path):
    write(tmp_path, "RUL_FD001.txt", [str(i) for i in range(1, 5001)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        ends = text.read_rul_at_end(spark, str(tmp_path), ["FD001"])
        assert ends.count() == 5000
        assert ends.where("unit <> rul_at_end").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_test_labels_follow_the_list(spark, folder):
    rows = text.read_fleet(spark, folder, "test", ["FD001"])
    made = remaining_useful_life(rows, text.read_rul_at_end(spark, folder, ["FD001"]))
    found = {u: [row["RUL"] for row in made.where(f"unit = {u}").orderBy("cycle").collect()] for u in (1, 2)}
    assert found == {1: list(range(24, 9, -1)), 2: list(range(29, 14, -1))}


def test_preparation_end_to_end(spark, folder):
    both = ["FD001", "FD002"]
    fleet = prepare_fleet(
        text.read_fleet(spark, folder, "train", both), text.read_fleet(spark, folder, "test", both), text.read_rul_at_end(spark, folder, both), share=0.3
    )
    counts = {row["split"]: row["count"] for row in fleet.readings.groupBy("split").count().collect()}
    assert counts["test"] == 34 and counts["train"] + counts["val"] == 64
    assert fleet.split("val").select("dataset_id", "unit").distinct().count() == 1
    assert fleet.split("train").where("sensor_3 <> 0.0").count() == 0
    assert fleet.missing().agg(F.sum("missing")).first()[0] == 0
    made = prepare_windows(fleet, window=5, features=FEATURES)
    assert made.where("split = 'test'").count() == 2 * (15 - 5)
    assert made.where("size(x) <> 5 or size(x[0]) <> 24").count() == 0


def test_validation_side_may_be_empty(spark):
    one = spark.createDataFrame([("FD001", 1, 1), ("FD001", 1, 2)], "dataset_id string, unit int, cycle int")
    assert split_by_engine(one, 0.3).where("split = 'val'").count() == 0


def test_scaling_fixture(spark):
    train = spark.createDataFrame([(1, 0.1, 1.0), (1, 0.5, 1.0), (2, 0.9, 1.0)], "unit int, sensor_1 double, sensor_2 double")
    test = spark.createDataFrame([(1, 0.1 + 0.8 / 6, 1.0), (2, 1.7, None), (3, float("nan"), 1.0)], "unit int, sensor_1 double, sensor_2 double")
    scaler = fit_minmax(train)
    assert [row["sensor_1"] for row in apply_minmax(train, scaler).orderBy("sensor_1").collect()] == pytest.approx([0, 0.5, 1])
    made = apply_minmax(test, scaler).orderBy("unit").collect()
    assert made[0]["sensor_1"] == pytest.approx(1 / 6) and made[1]["sensor_1"] == pytest.approx(2.0)
    assert made[2]["sensor_1"] is None
    assert [row["sensor_2"] for row in made] == [0.0, None, 0.0]


def test_tables_round_trip(spark, tmp_path):
    lines = [(u, c, 100.0 - c, "FD001", "train" if u == 1 else "val") for u in (1, 2) for c in range(1, 4)]
    rows = spark.createDataFrame(lines, "unit int, cycle int, RUL double, dataset_id string, split string")
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        tables.write_splits(rows, path, kind)
        schema = rows.drop("split").schema if kind == "csv" else None
        back = tables.read_splits(spark, path, "val", kind, schema)
        assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(line for line in lines if line[4] == "val")


def test_pruned_split_reads_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "unit int, split string")
    tables.write_splits(rows, str(tmp_path / "t"))
    assert len(tables.read_splits(spark, str(tmp_path / "t"), "val").inputFiles()) >= 1
    plan = tables.read_splits(spark, str(tmp_path / "t"), "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_processed_csv_is_read_by_name(spark, tmp_path):
    path = write(tmp_path, "processed.csv", ["RUL,unit,cycle,dataset_id," + ",".join(FEATURES), "9,1,2,FD001," + ",".join(["0.5"] * 24)])
    row = tables.read_processed_csv(spark, path).first()
    assert (row["unit"], row["cycle"], row["RUL"], row["sensor_21"]) == (1, 2, 9.0, 0.5)
    bad = write(tmp_path, "bad.csv", ["unit", "1"])
    with pytest.raises(ValueError, match="columns not found"):
        tables.read_processed_csv(spark, bad)


def test_windows_and_metadata_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", "FD001", 1, c, float(c), 5.0 - c) for c in range(1, 5)], "split string, dataset_id string, unit int, cycle int, sensor_1 double, RUL double")
    made = sliding_windows(rows, 2, 1, ["sensor_1"], ["split", "dataset_id", "unit"])
    path = str(tmp_path / "w")
    tables.write_windows(made, path, ["sensor_1"], 2, 1)
    assert tables.read_metadata(spark, path) == {"window_size": 2, "horizon": 1, "num_features": 1, "feature_columns": ["sensor_1"]}
    assert tables.read_windows(spark, path, "train").count() == 2
    assert tables.read_windows(spark, path, "test").count() == 0


def test_ranking_and_prediction_files(spark, tmp_path):
    means = spark.createDataFrame([("sensor_1", 0.25), ("a_feature_with_a_long_name", 0.5)], "feature string, importance double")
    tables.write_ranking(rank_features(means), str(tmp_path / "r"))
    assert [row[0] for row in spark.read.text(str(tmp_path / "r")).collect()] == [
        "   1 | a_feature_with_a_long_name | 0.500000",
        "   2 | sensor_1     | 0.250000",
    ]
    for kind in ("csv", "json", "parquet"):
        tables.write_predictions(means, str(tmp_path / kind), kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).count() == 2
    with pytest.raises(ValueError):
        tables.write_predictions(means, str(tmp_path / "x"), "npy")


def test_a_failed_overwrite_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "splits")
    rows = spark.createDataFrame([(1, 2.0, "train"), (2, 3.0, "val")], "unit int, sensor_1 double, split string")
    tables.write_splits(rows, path)
    reading = tables.read_splits(spark, path)
    broken = rows.withColumn("sensor_1", F.when(F.col("unit") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        tables.write_splits(broken, path)
    assert sorted(map(tuple, tables.read_splits(spark, path).collect())) == [(1, 2.0, "train"), (2, 3.0, "val")]
    tables.write_splits(rows.where("unit = 1"), path)
    # Who read the version before still can.
    assert reading.count() == 2 and tables.read_splits(spark, path).count() == 1
    tables.write_splits(rows.where("unit = 2"), path, mode="append")
    assert tables.read_splits(spark, path, "val").count() == 1
    assert len(versions.versions(spark, path)) == 2
    versions.forget(spark, path, 1)
    assert len(versions.versions(spark, path)) == 1 and tables.read_splits(spark, path).count() == 2
    with pytest.raises(ValueError):
        versions.forget(spark, path, 0)
    assert versions.current(spark, str(tmp_path / "none")) == str(tmp_path / "none")


def test_windows_and_what_they_consist_of_change_together(spark, tmp_path):
    path = str(tmp_path / "windows")
    rows = spark.createDataFrame([([[1.0]], 1.0, "train")], "x array<array<double>>, y double, split string")
    tables.write_windows(rows, path, ["sensor_1"], 1, 1)
    broken = rows.withColumn("y", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tables.write_windows(broken, path, ["sensor_2"], 1, 1)
    assert tables.read_metadata(spark, path)["feature_columns"] == ["sensor_1"] and tables.read_windows(spark, path).count() == 1


@pytest.mark.parametrize("line", ["1.7", "abc", "3000000000", "NaN"])
def test_remaining_life_that_is_no_whole_number_fails(spark, tmp_path, line):
    (tmp_path / "RUL_FD001.txt").write_text(f"12 \n 7.0\n{line}\n")
    with pytest.raises(Exception, match="unreadable remaining life"):
        text.read_rul_at_end(spark, str(tmp_path), ["FD001"]).collect()
