"""Describing a fleet: summaries, missing values, rules, correlations, histograms."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.labels import engine_lifetimes
from fleetspan.operators.scaling import without_nan
from fleetspan.operators.splitting import engines
from fleetspan.schema import KEYS, TARGET, TIME
from fleetspan.shared import match


def fleet_summary(df: DataFrame, keys=KEYS, time=TIME, by=()) -> DataFrame:
    """Engines, readings, sum of the cycle column and mean lifetime, in total or per ``by``."""
    per_engine = df.groupBy(*keys).agg(
        F.max(time).alias("_end"), F.sum(time).alias("_sum"), F.count(F.lit(1)).alias("_rows")
    )
    return per_engine.groupBy(*by).agg(
        F.count(F.lit(1)).alias("engines"),
        F.sum("_rows").alias("row_count"),
        F.sum("_sum").alias("cycle_sum"),
        F.avg("_end").alias("avg_lifetime"),
    )


def _is_missing(df: DataFrame, name: str) -> Column:
    missing = F.col(name).isNull()
    if df.schema[name].dataType.typeName() in ("double", "float"):
        missing = missing | F.isnan(name)
    return missing


def missing_values(df: DataFrame, columns=None) -> DataFrame:
    """Missing cells per column: ``column, missing``."""
    columns = columns or df.columns
    row = df.agg(*[F.count_if(_is_missing(df, name)).alias(f"missing_{i}") for i, name in enumerate(columns)])
    cells = [
        F.struct(F.lit(name).alias("column"), F.col(f"missing_{i}").alias("missing"))
        for i, name in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*cells)))


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, type, table size and missing cells."""
    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(_is_missing(df, name)).alias(f"missing_{i}") for i, name in enumerate(df.columns)],
    )
    cells = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col(f"missing_{i}").alias("missing"),
        )
        for i, field in enumerate(df.schema)
    ]
    return row.select("row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), F.inline(F.array(*cells)))


def validate_readings(df: DataFrame, keys=KEYS, target=TARGET) -> DataFrame:
    """Rule table ``rule, violations, passed``: no missing cell, no negative RUL, several engines."""
    per_engine = df.groupBy(*keys).agg(
        F.sum(sum((_is_missing(df, name).cast("long") for name in df.columns), F.lit(0).cast("long"))).alias("_missing"),
        F.count_if(F.col(target) < 0).alias("_negative"),
    )
    row = per_engine.agg(
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("_missing"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("_negative"),
        F.when(F.count(F.lit(1)) > 1, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("_single"),
    )
    rules = [("no_missing_values", "_missing"), ("rul_not_negative", "_negative"), ("more_than_one_unit", "_single")]
    cells = [
        F.struct(F.lit(rule).alias("rule"), F.col(name).alias("violations"), (F.col(name) == 0).alias("passed"))
        for rule, name in rules
    ]
    return row.select(F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, features) -> DataFrame:
    """Pearson correlation of every ordered pair of features: ``a, b, r``.

    A pair uses the rows where both values are present; a constant feature gives null.  The
    first pass finds the means.  The second forms, batch by batch, the matrix products that hold
    all pairs' sums around the means; a task returns one small table of sums, which Spark adds.
    Aggregate expressions, several per pair, took many times as long.
    """
    features = list(features)
    count = len(features)
    base = df.select(*[without_nan(df, name).alias(f"c{i}") for i, name in enumerate(features)])
    first = base.agg(
        *[F.avg(f"c{i}").alias(f"mean_{i}") for i in range(count)],
        *[(F.min(f"c{i}") < F.max(f"c{i}")).alias(f"varies_{i}") for i in range(count)],
    ).first()
    means = np.array([first[f"mean_{i}"] or 0.0 for i in range(count)])
    left, right = np.triu_indices(count)

    def pair_sums(batches):
        total = None
        for batch in batches:
            values = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]).astype(float)
            known = ~np.isnan(values)
            values = np.where(known, values - means, 0.0)
            present = known.astype(float)
            sums = np.stack([present.T @ present, values.T @ present, (values * values).T @ present, values.T @ values])
            total = sums if total is None else total + sums
        if total is not None:
            n, plain, square, product = total
            columns = [left, right, n[left, right], plain[left, right], plain[right, left]]
            columns += [square[left, right], square[right, left], product[left, right]]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)

    names = ["i", "j", "n", "sum_a", "sum_b", "square_a", "square_b", "product"]
    partial = base.mapInArrow(pair_sums, "i long, j long, " + ", ".join(f"{name} double" for name in names[2:]))
    sums = partial.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in names[2:]])

    n = F.col("n")
    spread_a = F.col("square_a") - F.try_divide(F.col("sum_a") * F.col("sum_a"), n)
    spread_b = F.col("square_b") - F.try_divide(F.col("sum_b") * F.col("sum_b"), n)
    shared = F.col("product") - F.try_divide(F.col("sum_a") * F.col("sum_b"), n)
    # Spread at rounding level means a constant over the shared rows.
    spreads = (spread_a > F.col("square_a") * 1e-14) & (spread_b > F.col("square_b") * 1e-14)
    r = F.try_divide(shared, F.sqrt(spread_a) * F.sqrt(spread_b))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    varies = F.array(*[F.lit(bool(first[f"varies_{i}"])) for i in range(count)])
    usable = spreads & F.get(varies, F.col("i")) & F.get(varies, F.col("j"))
    found = sums.select("i", "j", F.when(usable, F.when(F.col("i") == F.col("j"), 1.0).otherwise(bounded)).alias("r"))

    labels = F.array(*map(F.lit, features))
    grid = df.sparkSession.range(count * count).select(
        F.get(labels, F.floor(F.col("id") / count).cast("int")).alias("a"),
        F.get(labels, (F.col("id") % count).cast("int")).alias("b"),
        F.least(F.floor(F.col("id") / count), F.col("id") % count).alias("i"),
        F.greatest(F.floor(F.col("id") / count), F.col("id") % count).alias("j"),
    )
    return grid.join(found, ["i", "j"], "left").select("a", "b", "r")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the observed range: ``bin, low, high, count``; the last bin is closed.

    Values that are all equal get a range of width one around them, as the plots do.
    """
    values = df.select(without_nan(df, column).alias("_value")).where(F.col("_value").isNotNull())
    low, high = values.agg(F.min("_value"), F.max("_value")).first()
    spark = df.sparkSession
    grid = spark.range(1, bins + 1).select(F.col("id").alias("bin"))
    if low is None:
        return grid.where("false").selectExpr("bin", "0D AS low", "0D AS high", "0L AS count")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.floor((F.col("_value") - F.lit(low)) / F.lit(high - low) * F.lit(bins)) + 1
    counts = (
        values.select(F.least(place, F.lit(bins)).cast("long").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    edge = lambda step: F.lit(low) + step * F.lit(width)
    return grid.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin") - 1).alias("low"),
        edge(F.col("bin")).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def lifetime_histogram(df: DataFrame, bins: int = 20, keys=KEYS, time=TIME) -> DataFrame:
    """Histogram of engine lifetimes."""
    return histogram(engine_lifetimes(df, keys, time, "max_cycle"), "max_cycle", bins)


def engine_sample(df: DataFrame, k: int = 5, keys=KEYS) -> DataFrame:
    """All readings of the ``k`` engines with the smallest keys."""
    chosen = engines(df, keys).orderBy(*keys).limit(k)
    return match(df, F.broadcast(chosen), keys, "left_semi")
