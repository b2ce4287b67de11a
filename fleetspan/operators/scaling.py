"""Fitting and applying feature scalers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.quantiles import ROWS_PER_TASK, percentiles
from fleetspan.schema import feature_columns

METHODS = ("minmax", "standard", "robust")


def without_nan(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as missing."""
    column = F.col(name).cast("double")
    return F.when(~F.isnan(column), column)


def _long_form(row: DataFrame, features, parts) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("feature"), *[F.col(f"{part}_{i}").alias(part) for part in parts])
        for i, name in enumerate(features)
    ]
    return row.select(F.inline(F.array(*cells)))


def fit_minmax(df: DataFrame, features=None) -> DataFrame:
    """Smallest and largest value of every feature: ``feature, min, max``."""
    features = features or feature_columns(df)
    row = df.agg(
        *[
            extreme(without_nan(df, name)).alias(f"{part}_{i}")
            for i, name in enumerate(features)
            for part, extreme in (("min", F.min), ("max", F.max))
        ]
    )
    return _long_form(row, features, ["min", "max"])


def _scaled(value: Column, centre: Column, spread: Column) -> Column:
    # A feature without spread becomes 0.0; missing values stay missing.
    return F.coalesce(F.try_divide(value - centre, spread), F.when(value.isNotNull(), F.lit(0.0)))


def _bounds(scaler: DataFrame, parts) -> dict[str, tuple]:
    # One row per feature: as many rows as the readings have columns.
    return {row["feature"]: tuple(row[part] for part in parts) for row in scaler.collect()}


def apply_minmax(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Scale each fitted feature to ``(x - min) / (max - min)``; values outside the fit stay outside."""
    return df.withColumns(
        {
            name: _scaled(without_nan(df, name), F.lit(low).cast("double"), F.lit(high).cast("double") - F.lit(low).cast("double"))
            for name, (low, high) in _bounds(scaler, ["min", "max"]).items()
        }
    )


def fit_scaler(
    df: DataFrame, features=None, method="minmax", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``feature, centre, spread`` for one of the scaling methods.

    ``minmax``: minimum and range; ``standard``: mean and population deviation; ``robust``:
    median and interquartile range.
    """
    features = features or feature_columns(df)
    if method == "minmax":
        return fit_minmax(df, features).select(
            "feature", F.col("min").alias("centre"), (F.col("max") - F.col("min")).alias("spread")
        )
    if method == "standard":
        row = df.agg(
            *[F.avg(without_nan(df, name)).alias(f"centre_{i}") for i, name in enumerate(features)],
            *[F.stddev_pop(without_nan(df, name)).alias(f"spread_{i}") for i, name in enumerate(features)],
        )
        return _long_form(row, features, ["centre", "spread"])
    if method == "robust":
        cells = F.array(
            *[F.struct(F.lit(name).alias("feature"), without_nan(df, name).alias("value")) for name in features]
        )
        quartiles = percentiles(
            df.select(F.inline(cells)), "value", [0.25, 0.5, 0.75], ["feature"], rows_per_task=rows_per_task
        )
        return quartiles.select(
            "feature",
            F.element_at("percentiles", 2).alias("centre"),
            (F.element_at("percentiles", 3) - F.element_at("percentiles", 1)).alias("spread"),
        )
    raise ValueError(f"unknown scaling method {method!r}, expected one of {METHODS}")


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Scale each fitted feature to ``(x - centre) / spread``."""
    return df.withColumns(
        {
            name: _scaled(without_nan(df, name), F.lit(centre).cast("double"), F.lit(spread).cast("double"))
            for name, (centre, spread) in _bounds(scaler, ["centre", "spread"]).items()
        }
    )
