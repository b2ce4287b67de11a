"""Exact order statistics without sorting a whole group in one task."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.operators.series import ascending, long_series, split_long
from fleetspan.shared import accumulated, match, settle

# Only one number per row is held, so a task takes more of them than of whole readings.
ROWS_PER_TASK = 1_000_000


def _known(df: DataFrame, column: str) -> Column:
    known = F.col(column).isNotNull()
    if df.schema[column].dataType.typeName() in ("double", "float"):
        known = known & ~F.isnan(column)
    return known


def _values_at_ranks(df: DataFrame, column: str, keys, ranks: Callable[[Column], Column]) -> DataFrame:
    """Per key the map ``_found``: 0-based rank -> value, for the ranks asked for.

    Equal values are counted before the shuffle; the distinct ones are ranked together by ranges of their
    own type, and each takes as many ranks as it was counted.
    """
    counted = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_copies"))
    placed = accumulated(counted, [*ascending(keys), F.col(column).asc_nulls_last()], "_copies")
    totals = settle(placed.groupBy(*keys).agg(F.min("_index").alias("_start"), F.sum("_copies").alias("_total")))
    rows = match(placed, totals.side, keys, "inner").withColumn("_first", F.col("_index") - F.col("_start"))
    hits = F.filter(
        F.array_distinct(ranks(F.col("_total"))),
        lambda rank: (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_copies")),
    )
    found = rows.select(*keys, "_total", F.explode(hits).alias("_rank"), F.col(column).alias("_value"))
    return found.groupBy(*keys, "_total").agg(
        F.map_from_entries(F.collect_set(F.struct("_rank", "_value"))).alias("_found")
    )


def percentiles(
    df: DataFrame, column: str, shares, keys=(), name="percentiles", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Exact percentiles with linear interpolation: ``keys`` and the array ``name``.

    Missing values are left out.
    """
    keys = list(keys)
    shares = [float(share) for share in shares]
    rows = df.where(_known(df, column)).select(*keys, F.col(column).cast("double").alias(column))

    def plain(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(F.percentile(column, F.array(*map(F.lit, shares))).alias(name))

    long = long_series(rows, keys, rows_per_task)
    if long is None:
        return plain(rows)
    ordinary, hot = split_long(rows, keys, long)

    def positions(total: Column) -> list[Column]:
        return [F.lit(share) * (total - 1) for share in shares]

    def ranks(total: Column) -> Column:
        return F.array(
            *[edge(place).cast("long") for place in positions(total) for edge in (F.floor, F.ceil)]
        )

    found = _values_at_ranks(hot, column, keys, ranks)
    values = []
    for place in positions(F.col("_total")):
        low = F.element_at("_found", F.floor(place).cast("long"))
        high = F.element_at("_found", F.ceil(place).cast("long"))
        values.append(low + (high - low) * (place - F.floor(place)))
    done = found.select(*keys, F.array(*values).alias(name))
    return plain(ordinary).unionByName(done) if keys else done


def value_at(df: DataFrame, column: str, rank: int, rows_per_task: int = ROWS_PER_TASK):
    """The ``rank``-th smallest value (1-based) of a column without missing values."""
    rows = df.select(column)
    long = long_series(rows, [], rows_per_task)
    if long is None:
        return rows.orderBy(column).limit(rank).agg(F.max(column)).first()[0]
    found = _values_at_ranks(rows, column, [], lambda total: F.array(F.lit(rank - 1).cast("long")))
    return found.select(F.element_at("_found", F.lit(rank - 1).cast("long"))).first()[0]
