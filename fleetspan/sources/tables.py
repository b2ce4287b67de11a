"""Reading and writing prepared tables, windows, rankings and predictions."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.operators.importance import ranking_lines
from fleetspan.schema import HORIZON, READING_SCHEMA, WINDOW
from fleetspan.sources import versions

PROCESSED_SCHEMA = T.StructType(
    READING_SCHEMA.fields + [T.StructField("dataset_id", T.StringType()), T.StructField("RUL", T.DoubleType())]
)


def write_splits(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write prepared readings, one folder per ``split``.

    ``overwrite`` makes a new version, see :mod:`versions`; until it is whole, readers see the one before.
    """

    def write(folder: str) -> None:
        writer = df.write.mode(mode).partitionBy("split")
        if format == "csv":
            writer = writer.option("header", True)
        writer.format(format).save(folder)

    if mode == "overwrite":
        versions.replace(df.sparkSession, path, write)
    else:
        write(versions.current(df.sparkSession, path))


def read_splits(spark: SparkSession, path: str, split: str | None = None, format: str = "parquet", schema=None) -> DataFrame:
    """Read prepared readings; one split reads only its own folder."""
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True).schema(
            T.StructType([*(schema or PROCESSED_SCHEMA).fields, T.StructField("split", T.StringType())])
        )
    rows = reader.format(format).load(versions.current(spark, path))
    return rows if split is None else rows.where(F.col("split") == split)


def read_processed_csv(spark: SparkSession, path: str, schema=PROCESSED_SCHEMA) -> DataFrame:
    """Read a prepared CSV file with a header; the columns are found by name."""
    rows = spark.read.option("header", True).csv(path)
    missing = [field.name for field in schema if field.name not in rows.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return rows.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])


def write_windows(
    df: DataFrame, path: str, features, window: int = WINDOW, horizon: int = HORIZON, mode: str = "overwrite"
) -> None:
    """Write windows by ``split`` and what they consist of; both become readable at once."""
    metadata = {
        "window_size": window,
        "horizon": horizon,
        "num_features": len(features),
        "feature_columns": list(features),
    }
    spark = df.sparkSession

    def write(folder: str) -> None:
        df.write.mode(mode).partitionBy("split").parquet(f"{folder}/windows")
        spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")

    if mode == "overwrite":
        versions.replace(spark, path, write)
    else:
        write(versions.current(spark, path))


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read windows; one split reads only its own folder."""
    rows = spark.read.parquet(f"{versions.current(spark, path)}/windows")
    return rows if split is None else rows.where(F.col("split") == split)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """Window size, horizon and feature names; features without names are called ``feature_i``."""
    schema = "window_size int, horizon int, num_features int, feature_columns array<string>"
    found = spark.read.schema(schema).json(f"{versions.current(spark, path)}/metadata").first().asDict()
    if found["feature_columns"] is None:
        found["feature_columns"] = [f"feature_{i}" for i in range(found["num_features"])]
    return found


def write_ranking(ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a feature ranking as text lines in rank order.  One row per feature."""
    ranking_lines(ranked).orderBy("rank").coalesce(1).sortWithinPartitions("rank").select("line").write.mode(mode).text(path)


def write_predictions(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """Write predictions as ``csv``, ``json`` or ``parquet``."""
    if format not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown prediction format {format!r}")
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def write_scaler(scaler: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keep a fitted scaler beside the windows it was applied to.  One row per feature."""
    write = lambda folder: scaler.coalesce(1).write.mode(mode).parquet(folder)
    if mode == "overwrite":
        versions.replace(scaler.sparkSession, path, write)
    else:
        write(versions.current(scaler.sparkSession, path))


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    """A kept scaler, to be applied to later windows or messages."""
    return spark.read.parquet(versions.current(spark, path))
