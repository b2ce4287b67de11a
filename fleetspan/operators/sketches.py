"""Summaries that are kept per part of a table and merged: new parts are read once, old ones never again.

Percentiles come from KLL sketches, distinct engines from HLL sketches, scalers from moments.  A summary has one row
per part and group, whatever the part's size, and can be written, read and merged in any order.
"""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.operators.scaling import without_nan

# Size of a percentile sketch: ranks are off by some 0.2 percent at most.
KLL_SIZE = 4096
# Binary logarithm of the slots of a distinct-count sketch: counts are off by about one percent.
HLL_BITS = 14


def union_of(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def value_sketches(df: DataFrame, value: Column, by=(), size: int = KLL_SIZE) -> DataFrame:
    """``by`` and ``sketch`` of a column's values; missing ones and NaN are left out."""
    number = value.cast("double")
    known = df.select(*by, F.when(~F.isnan(number), number).alias("_value")).where("_value is not null")
    return known.groupBy(*by).agg(F.kll_sketch_agg_double("_value", size).alias("sketch"))


def merged_sketches(sketches: DataFrame, by=(), size: int = KLL_SIZE) -> DataFrame:
    """One sketch per group out of those of all parts."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, shares, by=()) -> DataFrame:
    """``by``, ``n`` and ``percentiles`` of merged sketches; a group without values has none."""
    found = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))) for share in shares])
    n = F.kll_sketch_get_n_double("sketch")
    return sketches.select(*by, n.alias("n"), F.when(n > 0, found).alias("percentiles"))


def engine_sketches(messages: DataFrame, engine: str = "engine_id", by=(), bits: int = HLL_BITS) -> DataFrame:
    """``by`` and ``engines``, a sketch of the engines heard of."""
    return messages.groupBy(*by).agg(F.hll_sketch_agg(engine, bits).alias("engines"))


def engines_estimated(sketches: DataFrame, by=()) -> DataFrame:
    """The number of different engines in all parts, within about one percent."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("engines")).alias("engines_monitored"))


def moments(df: DataFrame, features, by=()) -> DataFrame:
    """``by, feature, n, mean, m2, min, max`` of every feature; missing values and NaN are left out."""
    cells = []
    for i, name in enumerate(features):
        value = without_nan(df, name)
        cells += [F.count(value).alias(f"n_{i}"), F.avg(value).alias(f"mean_{i}"), F.var_pop(value).alias(f"var_{i}"), F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}")]
    row = df.groupBy(*by).agg(*cells)
    long = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(f"n_{i}").alias("n"),
            F.col(f"mean_{i}").alias("mean"),
            (F.col(f"var_{i}") * F.col(f"n_{i}")).alias("m2"),
            F.col(f"min_{i}").alias("min"),
            F.col(f"max_{i}").alias("max"),
        )
        for i, name in enumerate(features)
    ]
    return row.select(*by, F.inline(F.array(*long)))


def merged_moments(parts: DataFrame, by=()) -> DataFrame:
    """One row per group and feature out of those of all parts.

    Parts are put together about their common mean, so that nothing cancels where means are far from zero.
    """
    group = Window.partitionBy(*by, "feature")
    total = F.sum("n").over(group)
    centred = parts.withColumn("_mean", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(group), total))
    apart = F.col("mean") - F.col("_mean")
    return centred.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def minmax_of(merged: DataFrame) -> DataFrame:
    """The scaler that :func:`fit_minmax` finds, from merged moments."""
    return merged.select("feature", "min", "max")


def standard_of(merged: DataFrame) -> DataFrame:
    """The scaler that :func:`fit_scaler` finds by ``standard``, from merged moments."""
    return merged.select("feature", F.col("mean").alias("centre"), F.sqrt(F.try_divide("m2", "n")).alias("spread"))
