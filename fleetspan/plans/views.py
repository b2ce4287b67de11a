"""The driver's tables read as fleet data: readings, lifetimes, predictions, losses, weights."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.operators.series import number_rows
from fleetspan.shared import shared_folder

# Divides prices so that no loss ends exactly between two roundings.
LOSS_UNIT = 98765.4321

SENSORS = ["op_setting_1", "sensor_1", "sensor_2", "sensor_3"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def dataset_of(unit: str):
    return F.concat(F.lit("FD00"), (F.col(unit) % 4 + 1).cast("string"))


def _sensors(events: DataFrame) -> DataFrame:
    return events.select(
        dataset_of("user_id").alias("dataset_id"),
        F.col("user_id").alias("unit"),
        "ts",
        "event_id",
        F.length("event_type").cast("double").alias("op_setting_1"),
        F.col("value").alias("sensor_1"),
        F.get_json_object("props", "$.k").cast("double").alias("sensor_2"),
        F.lit(1.0).alias("sensor_3"),
        "event_type",
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as readings: a user is an engine, the n-th event its n-th cycle."""
    rows = _sensors(table(spark, folder, "events"))
    numbered = number_rows(rows, ["dataset_id", "unit"], ["ts", "event_id"], "cycle")
    return numbered.select("dataset_id", "unit", "cycle", *SENSORS)


def gappy_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings whose first sensor is missing on error events."""
    rows = _sensors(table(spark, folder, "events"))
    rows = rows.withColumn("sensor_1", F.when(F.col("event_type") != "error", F.col("sensor_1")))
    numbered = number_rows(rows, ["dataset_id", "unit"], ["ts", "event_id"], "cycle")
    return numbered.select("dataset_id", "unit", "cycle", *SENSORS)


def rul_at_end(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as the list of remaining lives; some engines are not in it."""
    return table(spark, folder, "supplier").select(
        dataset_of("s_suppkey").alias("dataset_id"),
        F.col("s_suppkey").alias("unit"),
        (F.col("s_suppkey") % 120).alias("rul_at_end"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as predictions."""
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("dataset_id"),
        F.col("l_quantity").alias("y_true"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) + F.col("l_tax") * 100).alias("y_pred"),
    )


def losses(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as loss histories: a customer is a run, its orders are the epochs."""
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("epoch"),
        (price / LOSS_UNIT).alias("train_loss"),
        (price * (1 + (F.col("o_orderkey") % 7) / 10) / LOSS_UNIT).alias("val_loss"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as checkpoints with the loss in their name."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("experiment"),
        F.concat(
            F.lit("tft-epoch="),
            F.col("o_orderkey").cast("string"),
            F.lit("-val_loss="),
            F.format_string("%.2f", F.col("o_totalprice")),
            F.lit(".ckpt"),
        ).alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("modified"),
    )


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as attribution weights: the label is the sample, the vector the step."""
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        F.col("label").alias("sample_id"),
        F.col("vec_id").alias("t"),
        F.posexplode("embedding").alias("_at", "_value"),
    ).select(
        "sample_id",
        "t",
        F.concat(F.lit("feature_"), (F.col("_at") + 1).cast("string")).alias("feature"),
        F.abs(F.col("_value").cast("double")).alias("weight"),
    )


# The same views as DuckDB common table expressions.
READINGS_SQL = """
readings AS (
  SELECT 'FD00' || CAST(user_id % 4 + 1 AS VARCHAR) AS dataset_id, user_id AS unit,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
         CAST(length(event_type) AS DOUBLE) AS op_setting_1, value AS sensor_1,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS sensor_2, CAST(1 AS DOUBLE) AS sensor_3,
         event_type
  FROM events)
"""
GAPPY_SQL = READINGS_SQL + """,
gappy AS (
  SELECT dataset_id, unit, cycle, op_setting_1,
         CASE WHEN event_type <> 'error' THEN sensor_1 END AS sensor_1, sensor_2, sensor_3
  FROM readings)
"""
LABELLED_SQL = READINGS_SQL + """,
labelled AS (
  SELECT dataset_id, unit, cycle, op_setting_1, sensor_1, sensor_2, sensor_3,
         CAST(max(cycle) OVER (PARTITION BY dataset_id, unit) - cycle AS DOUBLE) AS RUL
  FROM readings)
"""
PREDICTIONS_SQL = """
predictions AS (
  SELECT l_returnflag AS dataset_id, l_quantity AS y_true,
         l_quantity * (1 - l_discount) + l_tax * 100 AS y_pred
  FROM lineitem)
"""
WEIGHTS_SQL = """
parts AS (
  SELECT label AS sample_id, vec_id AS t, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS value
  FROM embeddings),
weights AS (
  SELECT sample_id, t, 'feature_' || CAST(pos AS VARCHAR) AS feature, abs(CAST(value AS DOUBLE)) AS weight
  FROM parts)
"""
