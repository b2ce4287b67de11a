"""Engineered features and repair of missing values, per engine in the order of the cycles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.operators.layout import StoredSeries, pieces_of
from fleetspan.operators.quantiles import percentiles
from fleetspan.operators.scaling import without_nan
from fleetspan.operators.series import (
    ROWS_PER_TASK,
    long_series,
    moment,
    number_long,
    split_long,
    tie_break,
)
from fleetspan.schema import KEYS, TIME, feature_columns
from fleetspan.shared import attach, match, settle

STRATEGIES = ("drop", "interpolate", "fill_mean", "fill_median")


def engineered_features(
    df: DataFrame | StoredSeries,
    features=None,
    rolling: int | None = 5,
    lags=(1, 2, 3),
    diff: bool = True,
    keys=KEYS,
    time=TIME,
    ties=(),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add rolling mean, deviation, minimum and maximum, lagged values and first differences.

    All of them share one shuffle and one sort; from :class:`StoredSeries` no reading is shuffled.
    """
    features = list(features or feature_columns(df))

    def columns(series):
        made = {}
        for name in features:
            value = F.col(name)
            if rolling:
                frame = series.rowsBetween(1 - rolling, 0)
                made[f"{name}_mean_{rolling}"] = F.avg(value).over(frame)
                made[f"{name}_std_{rolling}"] = F.stddev_pop(value).over(frame)
                made[f"{name}_min_{rolling}"] = F.min(value).over(frame)
                made[f"{name}_max_{rolling}"] = F.max(value).over(frame)
            for step in lags:
                made[f"{name}_lag_{step}"] = F.lag(value, step).over(series)
            if diff:
                made[f"{name}_diff"] = value - F.lag(value, 1).over(series)
        return made

    reach = max([rolling - 1 if rolling else 0, *lags, 1 if diff else 0])
    return pieces_of(df, list(df.columns), keys, [time, *ties], reach, 0, rows_per_task).over(columns)


def rolling_features(df: DataFrame, features=None, rolling: int = 5, **options) -> DataFrame:
    """Rolling statistics over the last ``rolling`` readings."""
    return engineered_features(df, features, rolling, (), False, **options)


def lag_features(df: DataFrame, features=None, lags=(1, 2, 3), **options) -> DataFrame:
    """The values some readings earlier."""
    return engineered_features(df, features, None, lags, False, **options)


def diff_features(df: DataFrame, features=None, **options) -> DataFrame:
    """The change since the reading before."""
    return engineered_features(df, features, None, (), True, **options)


def _interpolate(df: DataFrame, features, keys, time, ties, rows_per_task: int) -> DataFrame:
    order = [time, *ties]
    df = df.withColumns({name: without_nan(df, name) for name in features})
    at = moment(df, time)

    def known(name):
        return F.when(F.col(name).isNotNull(), F.struct(at.alias("at"), F.col(name).alias("value")))

    def fill(rows: DataFrame, group, carried: bool) -> DataFrame:
        # The backward look runs over the reversed order: a frame that only ever grows is linear.
        along = [F.col("_rn")] if carried else [*map(F.col, order), tie_break(df)]
        upward = Window.partitionBy(*group).orderBy(*[column.asc_nulls_last() for column in along])
        downward = Window.partitionBy(*group).orderBy(*[column.desc_nulls_first() for column in along])
        grown = (Window.unboundedPreceding, Window.currentRow)
        made = {}
        for i, name in enumerate(features):
            earlier = F.last(known(name), ignorenulls=True).over(upward.rowsBetween(*grown))
            later = F.last(known(name), ignorenulls=True).over(downward.rowsBetween(*grown))
            if carried:
                earlier, later = F.coalesce(earlier, f"_earlier_{i}"), F.coalesce(later, f"_later_{i}")
            made[f"_from_{i}"], made[f"_to_{i}"] = earlier, later
        rows = rows.withColumns(made)
        values = {}
        for i, name in enumerate(features):
            start, end = F.col(f"_from_{i}"), F.col(f"_to_{i}")
            way = F.try_divide(at - start["at"], end["at"] - start["at"])
            between = start["value"] + (end["value"] - start["value"]) * way
            values[name] = F.coalesce(F.col(name), between, start["value"])
        return rows.withColumns(values).select(*df.columns)

    long = long_series(df, keys, rows_per_task)
    if long is None:
        return fill(df, keys, False)
    ordinary, hot = split_long(df, keys, long)
    numbered = number_long(hot, keys, order, long.rows_per_piece).withColumn(
        "_chunk", F.floor((F.col("_rn") - 1) / long.rows_per_piece)
    )
    # What a chunk can see of its neighbours: the last value known before it, the first after it.
    edges = numbered.groupBy(*keys, "_chunk").agg(
        *[F.max_by(known(name), F.when(F.col(name).isNotNull(), F.col("_rn"))).alias(f"_last_{i}") for i, name in enumerate(features)],
        *[F.min_by(known(name), F.when(F.col(name).isNotNull(), F.col("_rn"))).alias(f"_first_{i}") for i, name in enumerate(features)],
    )
    upward = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    downward = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(
        edges.select(
            *keys,
            "_chunk",
            *[F.last(f"_last_{i}", ignorenulls=True).over(upward).alias(f"_earlier_{i}") for i in range(len(features))],
            *[F.last(f"_first_{i}", ignorenulls=True).over(downward).alias(f"_later_{i}") for i in range(len(features))],
        )
    )
    chunks = match(numbered, carried.side, [*keys, "_chunk"], "left")
    return fill(ordinary, keys, False).unionByName(fill(chunks, [*keys, "_chunk"], True))


def repair_missing(
    df: DataFrame,
    strategy: str = "interpolate",
    features=None,
    keys=KEYS,
    time=TIME,
    ties=(),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Deal with missing feature values, engine by engine.

    ``drop`` removes the readings; ``interpolate`` draws a line between the neighbours, holds
    the last value at the end and leaves the start missing; ``fill_mean`` and ``fill_median``
    put in the value of the engine.
    """
    features = list(features or feature_columns(df))
    if strategy == "interpolate":
        return _interpolate(df, features, keys, time, ties, rows_per_task)
    clean = df.withColumns({name: without_nan(df, name) for name in features})
    if strategy == "drop":
        return clean.dropna(subset=features)
    if strategy == "fill_mean":
        fills = clean.groupBy(*keys).agg(
            *[F.avg(name).alias(f"_fill_{i}") for i, name in enumerate(features)], F.count(F.lit(1)).alias("_rows")
        )
    elif strategy == "fill_median":
        cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(name).alias("value")) for i, name in enumerate(features)])
        medians = percentiles(
            clean.select(*keys, F.inline(cells)), "value", [0.5], [*keys, "at"], rows_per_task=rows_per_task
        )
        fills = medians.groupBy(*keys).agg(
            *[F.max(F.when(F.col("at") == i, F.element_at("percentiles", 1))).alias(f"_fill_{i}") for i in range(len(features))]
        )
        fills = match(fills, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "left")
    else:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    joined = attach(clean, fills, keys, "_rows", rows_per_task)
    return joined.withColumns(
        {name: F.coalesce(name, f"_fill_{i}") for i, name in enumerate(features)}
    ).select(*df.columns)
