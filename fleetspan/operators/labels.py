"""Engine lifetimes and remaining useful life."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.schema import KEYS, TARGET, TIME
from fleetspan.shared import attach, match

# Engines with more readings than this are not shuffled to be labelled.
CROWDED = 1_000_000


def engine_lifetimes(df: DataFrame, keys=KEYS, time=TIME, name="max_cycle") -> DataFrame:
    """Last cycle of every engine."""
    return df.groupBy(*keys).agg(F.max(time).alias(name))


def remaining_useful_life(
    df: DataFrame, rul_at_end: DataFrame | None = None, keys=KEYS, time=TIME, target=TARGET
) -> DataFrame:
    """Add the cycles left at each reading.

    Run-to-failure data end at RUL 0.  For truncated data ``rul_at_end`` (``keys`` plus
    ``rul_at_end``) says what was left after the last reading; engines it lacks get null.

    The lifetimes are aggregated before any shuffle of readings and joined back, so neither a
    long engine nor a wide row has to pass a window; the readings stay where they are as long
    as the counted engine table is small enough to broadcast.
    """
    ends = df.groupBy(*keys).agg(F.max(time).alias("_end"), F.count(F.lit(1)).alias("_rows"))
    left = F.lit(0.0)
    if rul_at_end is not None:
        ends = match(ends, rul_at_end.select(*keys, F.col("rul_at_end").alias("_left")), keys, "left")
        left = F.col("_left").cast("double")
    joined = attach(df, ends, keys, "_rows", CROWDED)
    return joined.withColumn(target, left + (F.col("_end") - F.col(time))).drop("_end", "_left")
