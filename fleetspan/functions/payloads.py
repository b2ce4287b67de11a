"""Checking and arranging window matrices that come from outside."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.schema import PAYLOAD_SCHEMA, WINDOW

# Answers to unusable requests.
WRONG_ROWS = "Input must have window_size={} rows."
WRONG_NAMES = "Feature names do not match model features."
WRONG_WIDTH = "Every row must have {} values."


def windows_from_payload(df: DataFrame, value="value") -> DataFrame:
    """Decode request bodies: adds ``x`` and ``feature_names``."""
    body = F.from_json(F.col(value).cast("string"), PAYLOAD_SCHEMA)
    # Generated, so that filters further up do not parse the body again.
    return df.select("*", F.inline(F.array(body)).alias("x", "feature_names"))


def reorder_features(df: DataFrame, features, names="feature_names") -> DataFrame:
    """Bring the columns of ``x`` into the order of ``features``.

    Rows without names are taken as they are.  Rows whose names differ get a null ``x`` and an
    ``error``.
    """
    wanted = F.array(*map(F.lit, features))
    given = F.col(names)
    unnamed = given.isNull() | (F.size(given) == 0)
    same = F.array_sort(given) == F.array_sort(wanted)
    places = F.transform(wanted, lambda name: F.array_position(given, name).cast("int"))
    moved = F.transform("x", lambda row: F.transform(places, lambda place: F.try_element_at(row, place)))
    return df.withColumns(
        {
            "x": F.when(unnamed, F.col("x")).when(same, moved),
            "error": F.when(~unnamed & ~same, F.lit(WRONG_NAMES)),
        }
    )


def window_error(x: Column, window: int, width: int) -> Column:
    """What is wrong with the shape of a window, null when nothing is."""
    return (
        F.when(x.isNull() | (F.size(x) != window), F.lit(WRONG_ROWS.format(window)))
        .when(
            ~F.forall(x, lambda row: F.coalesce(F.size(row) == width, F.lit(False))),
            F.lit(WRONG_WIDTH.format(width)),
        )
    )


def validate_windows(df: DataFrame, width: int, window: int = WINDOW) -> DataFrame:
    """Add ``error`` for windows that do not have ``window`` rows of ``width`` values."""
    found = window_error(F.col("x"), window, width)
    earlier = [F.col("error")] if "error" in df.columns else []
    return df.withColumn("error", F.coalesce(*earlier, found))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull()).drop("error")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNotNull())
