"""Judging predictions of remaining useful life.  Every operator takes an optional ``by`` list."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.functions.formulas import TINY, prediction_grade, ratio_or_zero
from fleetspan.operators.profiling import histogram
from fleetspan.operators.quantiles import ROWS_PER_TASK, percentiles
from fleetspan.schema import ALERT_THRESHOLD
from fleetspan.shared import match


def _true() -> Column:
    return F.col("y_true")


def _predicted() -> Column:
    return F.col("y_pred")


def judged(df: DataFrame) -> DataFrame:
    """``df`` with ``y_true`` and ``y_pred`` both missing where either is: one mask for every measure.

    ``_unpredicted`` marks rows with a true value whose prediction is missing.
    """

    def present(name):
        known = F.col(name).isNotNull()
        return known & ~F.isnan(name) if df.schema[name].dataType.typeName() in ("double", "float") else known

    both = present("y_true") & present("y_pred")
    return df.withColumns(
        {
            "y_true": F.when(both, F.col("y_true")),
            "y_pred": F.when(both, F.col("y_pred")),
            "_unpredicted": present("y_true") & ~present("y_pred"),
        }
    )


def _miss() -> Column:
    return F.abs(_true() - _predicted())


def _regression(total: Column) -> dict[str, Column]:
    squares = F.sum((_true() - _predicted()) * (_true() - _predicted()))
    spread = F.var_pop(_true()) * total
    return {
        "mse": F.avg((_true() - _predicted()) * (_true() - _predicted())),
        "rmse": F.sqrt(F.avg((_true() - _predicted()) * (_true() - _predicted()))),
        "mae": F.avg(_miss()),
        # Without spread in the truth: 1 for perfect predictions, else 0.
        "r2_score": F.when(spread > 0, 1 - F.try_divide(squares, spread))
        .when(squares == 0, F.lit(1.0))
        .otherwise(F.lit(0.0)),
        "mape": F.avg(F.abs(F.try_divide(_true() - _predicted(), _true() + TINY))) * 100,
    }


def _errors() -> dict[str, Column]:
    error = _true() - _predicted()
    return {
        "error_mean": F.avg(error),
        "error_std": F.stddev_pop(error),
        "error_skewness": F.coalesce(F.when(F.stddev_pop(error) > 0, F.skewness(error)), F.lit(0.0)),
        "error_kurtosis": F.coalesce(F.when(F.stddev_pop(error) > 0, F.kurtosis(error)), F.lit(0.0)),
    }


def _ranges() -> dict[str, Column]:
    predicted = F.max(_predicted()) - F.min(_predicted())
    true = F.max(_true()) - F.min(_true())
    return {
        "bias_score": F.abs(F.avg(_true() - _predicted())) / (F.stddev_pop(_true()) + TINY),
        "prediction_range": predicted,
        "true_range": true,
        "range_ratio": predicted / (true + TINY),
    }


def _missing() -> dict[str, Column]:
    return {"missing_predictions": F.count_if("_unpredicted")}


def _collect(df: DataFrame, by, columns: dict[str, Column]) -> DataFrame:
    return judged(df).groupBy(*by).agg(*[column.alias(name) for name, column in columns.items()])


def _warnings(df: DataFrame) -> DataFrame:
    ratio = F.col("range_ratio")
    return df.withColumns(
        {"bias_warning": F.col("bias_score") > 0.1, "range_warning": (ratio < 0.5) | (ratio > 2.0)}
    )


def regression_metrics(df: DataFrame, by=()) -> DataFrame:
    """``mse, rmse, mae, r2_score, mape`` of ``y_true`` against ``y_pred``."""
    return _collect(df, by, _regression(F.count(_true())))


def error_distribution(df: DataFrame, by=()) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis of true minus predicted."""
    return _collect(df, by, _errors())


def error_centre(df: DataFrame, by=(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Mean, median and deviation of predicted minus true."""
    errors = judged(df).select(*by, (_predicted() - _true()).alias("_error"))
    centre = errors.groupBy(*by).agg(
        F.avg("_error").alias("mean_error"), F.stddev_pop("_error").alias("std_error")
    )
    middle = percentiles(errors, "_error", [0.5], by, rows_per_task=rows_per_task)
    joined = _beside(centre, middle, by)
    return joined.withColumn("median_error", F.element_at("percentiles", 1)).drop("percentiles")


def _beside(left: DataFrame, right: DataFrame, by) -> DataFrame:
    # Both tables hold one row per group; without groups one row each.
    return match(left, right, list(by), "left")


def error_percentiles(
    df: DataFrame, by=(), shares=(0.95, 0.99), exact=True, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Percentiles of the absolute error as columns ``error_95th_percentile`` and so on.

    ``exact=False`` reads one sketch per group instead of locating the exact values.
    """
    errors = judged(df).select(*by, _miss().alias("_error"))
    if exact:
        found = percentiles(errors, "_error", shares, by, rows_per_task=rows_per_task)
    else:
        found = errors.groupBy(*by).agg(
            F.percentile_approx("_error", F.array(*map(F.lit, shares)), 10_000).alias("percentiles")
        )
    return found.select(
        *by,
        *[
            F.element_at("percentiles", i + 1).alias(f"error_{round(share * 100):d}th_percentile")
            for i, share in enumerate(shares)
        ],
    )


def bias_and_range(df: DataFrame, by=()) -> DataFrame:
    """Bias and range scores with their warnings."""
    return _warnings(_collect(df, by, _ranges()))


def prediction_analysis(df: DataFrame, by=(), exact=True, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All prediction measures in one row (per group), with grade and warnings."""
    measures = _collect(df, by, {**_regression(F.count(_true())), **_errors(), **_ranges(), **_missing()})
    graded = _warnings(measures).withColumn("prediction_quality", prediction_grade(F.col("r2_score")))
    return _beside(graded, error_percentiles(df, by, exact=exact, rows_per_task=rows_per_task), by)


def within_horizon(df: DataFrame, horizon: float = ALERT_THRESHOLD, by=()) -> DataFrame:
    """Share of predictions that miss by at most ``horizon`` cycles."""
    return _collect(df, by, {"horizon_accuracy": F.avg((_miss() <= horizon).cast("double"))})


def critical_failure_metrics(
    df: DataFrame, threshold: float = ALERT_THRESHOLD, horizon: float = ALERT_THRESHOLD, by=()
) -> DataFrame:
    """Confusion counts, precision, recall, F1 and horizon accuracy of "RUL is at most threshold"."""
    actual, flagged = _true() <= threshold, _predicted() <= threshold
    counts = _collect(
        df,
        by,
        {
            # Rows that can be judged; the four cells sum to them.
            "total_samples": F.count(_true()),
            **_missing(),
            "actual_critical": F.count_if(actual),
            "predicted_critical": F.count_if(flagged),
            "true_positives": F.count_if(actual & flagged),
            "false_positives": F.count_if(~actual & flagged),
            "false_negatives": F.count_if(actual & ~flagged),
            "true_negatives": F.count_if(~actual & ~flagged),
            "horizon_accuracy": F.avg((_miss() <= horizon).cast("double")),
        },
    )
    hits = F.col("true_positives")
    return counts.withColumns(
        {
            "precision": ratio_or_zero(hits, hits + F.col("false_positives")),
            "recall": ratio_or_zero(hits, hits + F.col("false_negatives")),
            "f1_score": ratio_or_zero(2 * hits, 2 * hits + F.col("false_positives") + F.col("false_negatives")),
        }
    )


# Targets of the critical-failure evaluation.
TARGETS = {"precision": 0.90, "recall": 0.80, "horizon_accuracy": 0.85}


def target_check(metrics: DataFrame) -> DataFrame:
    """Add ``<measure>_target_met`` for every measure with a target."""
    return metrics.withColumns(
        {f"{name}_target_met": F.col(name) >= bound for name, bound in TARGETS.items()}
    )


def error_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of predicted minus true."""
    return histogram(df.select((_predicted() - _true()).alias("error")), "error", bins)


def sorted_predictions(df: DataFrame) -> DataFrame:
    """Predictions in order of the true value."""
    return df.orderBy("y_true", "y_pred")


def recommendations(
    predictions: DataFrame | None = None, training: DataFrame | None = None, importance: DataFrame | None = None
) -> DataFrame:
    """Advice ``area, advice`` drawn from rows of the three analyses; ``run_id`` stays where one has it.

    The bounds are fixed values of the analysis.
    """
    found = []
    if training is not None:
        found.append(
            (
                training,
                [
                    ("training", F.col("overfitting_score") > 0.3, "overfitting: regularise, stop earlier or add data"),
                    ("training", F.col("early_stopping_opportunity"), "stop earlier: the best epoch lies well before the end"),
                    ("training", F.col("val_stability") < 0.5, "unstable validation loss: schedule the learning rate or change the optimiser"),
                ],
            )
        )
    if predictions is not None:
        found.append(
            (
                predictions,
                [
                    ("prediction", F.col("r2_score") < 0.7, "low r2: improve features, model or data"),
                    ("prediction", F.col("bias_warning"), "biased predictions: balance samples or correct the bias"),
                    ("prediction", F.col("range_warning"), "prediction range is off: scale outputs or change the loss"),
                ],
            )
        )
    if importance is not None:
        found.append(
            (
                importance,
                [
                    ("architecture", F.col("utilization_ratio") < 0.3, "many unused features: select features"),
                    ("architecture", F.col("utilization_ratio") > 0.9, "nearly all features used: watch for fitted noise"),
                ],
            )
        )
    result = None
    named = any("run_id" in df.columns for df, _ in found)
    for df, rules in found:
        keep = [F.col("run_id").cast("string").alias("run_id") if "run_id" in df.columns else F.lit(None).cast("string").alias("run_id")]
        if len(found) == 1 or not named:
            keep = ["run_id"] if "run_id" in df.columns else []
        cells = F.array_compact(
            F.array(
                *[
                    F.when(test, F.struct(F.lit(area).alias("area"), F.lit(advice).alias("advice")))
                    for area, test, advice in rules
                ]
            )
        )
        made = df.select(*keep, F.inline(cells))
        result = made if result is None else result.unionByName(made)
    return result
