"""Feature importance from attribution weights or from predictions."""

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.functions.formulas import TINY
from fleetspan.shared import numbered, shared_folder

# Windows handed to the model at a time.
WINDOWS_AT_ONCE = 512


def feature_importance(df: DataFrame) -> DataFrame:
    """Mean weight per feature over samples and steps, ranked from the highest."""
    means = df.groupBy("feature").agg(F.avg("weight").alias("importance"))
    return rank_features(means)


def rank_features(means: DataFrame) -> DataFrame:
    """Add the 1-based ``rank``; ties go by feature name.  One row per feature comes in."""
    order = Window.orderBy(F.col("importance").desc(), "feature")
    return means.withColumn("rank", F.row_number().over(order).cast("long"))


def sample_importance(df: DataFrame) -> DataFrame:
    """Mean weight per sample and feature over the steps."""
    return df.groupBy("sample_id", "feature").agg(F.avg("weight").alias("importance"))


def top_features(ranked: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most important features."""
    return ranked.orderBy("rank").limit(k)


def bottom_features(ranked: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` least important features, still from the higher to the lower."""
    return ranked.orderBy(F.col("rank").desc()).limit(k).orderBy("rank")


def normalised_importance(means: DataFrame) -> DataFrame:
    """Importance divided by its sum.  One row per feature comes in."""
    whole = Window.partitionBy()
    return means.withColumn("importance", F.col("importance") / (F.sum("importance").over(whole) + TINY))


def importance_summary(means: DataFrame) -> DataFrame:
    """Entropy, extremes, deviation and utilisation of the normalised importance."""
    share = F.col("importance")
    summary = normalised_importance(means).agg(
        F.coalesce(-F.sum(F.when(share > 0, share * F.ln(share))), F.lit(0.0)).alias("importance_entropy"),
        F.max(share).alias("max_importance"),
        F.min(share).alias("min_importance"),
        F.stddev_pop(share).alias("importance_std"),
        F.avg((share > 0.01).cast("double")).alias("utilization_ratio"),
    )
    ratio = F.col("utilization_ratio")
    return summary.withColumn(
        "utilization_warning",
        F.when(ratio < 0.3, F.concat(F.lit("Low feature utilization ("), F.format_string("%.1f", ratio * 100), F.lit("%)")))
        .when(ratio > 0.9, F.concat(F.lit("Very high feature utilization ("), F.format_string("%.1f", ratio * 100), F.lit("%)"))),
    )


def ranking_lines(ranked: DataFrame) -> DataFrame:
    """The ranking as text lines ``rank | feature | score``."""
    line = F.concat(
        F.lpad(F.col("rank").cast("string"), 4, " "),
        F.lit(" | "),
        F.when(F.length("feature") < 12, F.rpad("feature", 12, " ")).otherwise(F.col("feature")),
        F.lit(" | "),
        F.format_string("%.6f", F.col("importance")),
    )
    return ranked.select("rank", line.alias("line"))


def _kept_with_ids(windows: DataFrame) -> DataFrame:
    """Windows with a number each, written once so that the numbers stay."""
    spark = windows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    windows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _cells(stored: DataFrame, identity, count: int, hashed, *more: str) -> DataFrame:
    """A row per feature and window with its place's hash; nothing of the windows but their keys."""
    places = [F.struct(F.lit(i).alias("feature"), hashed(i).cast("long").alias("order")) for i in range(count)]
    return stored.select("_id", *identity, *more, F.inline(F.array(*places)))


def _donors(stored: DataFrame, identity, count: int, hashed) -> DataFrame:
    """``feature, donor, recipient``: who passes its series on to whom."""
    rows = stored.count()
    placed = numbered(_cells(stored, identity, count, hashed), ["feature", "order", *identity])
    # Every feature has as many places as there are windows, so that its first place is known.
    first = F.col("feature") * rows
    after = (first + (F.col("_index") - first + 1) % max(1, rows)).alias("_index")
    passed = placed.select("feature", F.col("_id").alias("donor"), after)
    return passed.join(placed.select("_index", F.col("_id").alias("recipient")), "_index").drop("_index")


def _donors_in_blocks(stored: DataFrame, identity, count: int, hashed, rows_per_block: int) -> DataFrame:
    blocks = max(1, stored.count() // rows_per_block)
    dealt = stored.withColumn("_block", F.pmod(hashed(-1), F.lit(blocks)))
    places = Window.partitionBy("feature", "_block").orderBy("order", *identity)
    everyone = places.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_id").over(places), F.first("_id").over(everyone))
    return _cells(dealt, identity, count, hashed, "_block").select("feature", F.col("_id").alias("donor"), after.alias("recipient"))


def _exchanged(stored: DataFrame, donors: DataFrame, count: int) -> DataFrame:
    """``y``, the own readings (``own``) and the series got for each feature (``series``), flat, of every window."""
    sends = donors.groupBy("donor").agg(F.collect_list(F.struct("feature", "recipient")).alias("_sends"))
    own = F.struct(F.col("_id").alias("recipient"), F.lit(-1).alias("feature"), F.col("y"), F.flatten("x").alias("values"))
    series = lambda at: F.transform("x", lambda row: F.get(row, at))
    sent = F.transform(
        "_sends",
        lambda to: F.struct(to["recipient"].alias("recipient"), to["feature"].alias("feature"), F.lit(None).cast("double").alias("y"), series(to["feature"]).alias("values")),
    )
    parcels = stored.join(sends, F.col("_id") == F.col("donor")).select(F.inline(F.concat(F.array(own), sent)))
    met = parcels.groupBy("recipient").agg(F.max("y").alias("y"), F.sort_array(F.collect_list(F.struct("feature", "values"))).alias("_parts"))
    return met.select(
        "y", F.col("_parts")[0]["values"].alias("own"), F.flatten(F.transform(F.slice("_parts", 2, count), lambda part: part["values"])).alias("series"))


def permutation_importance(
    windows: DataFrame,
    features,
    predict: Callable[[np.ndarray], np.ndarray],
    keys,
    rows_per_block: int | None = None,
    order: Callable[[int], Column] | None = None,
) -> DataFrame:
    """How much the RMSE of ``predict`` grows when one feature's series is exchanged among windows.

    ``windows`` holds ``keys``, ``window_end``, ``x`` and ``y``.  Each feature is passed on by one
    place in an order of its own over all windows, the last one's to the first.  ``order(i)`` replaces the
    hash of the key that gives the order of feature ``i``.

    Only keys are put in order: one numbering of all features' keys gives a map of donors, then every window
    sends each of its series to the window that gets it.  Windows are shuffled twice, whatever the number of features.

    With ``rows_per_block`` windows are dealt into random blocks of about that size (``order(-1)``) and
    exchanged inside them, which gives another figure, by the number of blocks.
    """
    features = list(features)
    count = len(features)
    identity = [*keys, "window_end"]
    hashed = order or (lambda i: F.xxhash64(*identity, F.lit(i)))
    chosen = windows.where(F.col("y").isNotNull()).select(*identity, "x", F.col("y").cast("double").alias("y"))
    stored = _kept_with_ids(chosen)
    if rows_per_block is None:
        donors = _donors(stored, identity, count, hashed)
    else:
        donors = _donors_in_blocks(stored, identity, count, hashed, rows_per_block)
    exchanged = _exchanged(stored, donors, count)

    def squared_errors(batches):
        for batch in batches:
            sums, rows = np.zeros(count + 1), 0
            for start in range(0, len(batch), WINDOWS_AT_ONCE):
                part = batch.iloc[start : start + WINDOWS_AT_ONCE]
                truth = part["y"].to_numpy(dtype=float)
                series = np.stack(part["series"].to_numpy()).astype(float).reshape(len(part), count, -1)
                x = np.stack(part["own"].to_numpy()).astype(float).reshape(len(part), series.shape[2], -1)
                rows += len(part)
                sums[0] += float(((predict(x) - truth) ** 2).sum())
                for i in range(count):
                    kept = x[:, :, i].copy()
                    x[:, :, i] = series[:, i]
                    sums[i + 1] += float(((predict(x) - truth) ** 2).sum())
                    x[:, :, i] = kept
            if rows:
                yield pd.DataFrame({"rows": [rows], "sums": [sums.tolist()]})

    schema = T.StructType(
        [T.StructField("rows", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]
    )
    errors = exchanged.mapInPandas(squared_errors, schema).agg(
        *[F.sqrt(F.sum(F.col("sums")[i]) / F.sum("rows")).alias(f"rmse_{i}") for i in range(count + 1)]
    )
    cells = [
        F.struct(F.lit(name).alias("feature"), (F.col(f"rmse_{i + 1}") - F.col("rmse_0")).alias("importance"))
        for i, name in enumerate(features)
    ]
    return rank_features(errors.select(F.inline(F.array(*cells))))
