"""Scoring windows with a model, and fitting one."""

import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.functions.payloads import window_error
from fleetspan.operators.scaling import _bounds
from fleetspan.schema import SEED, WINDOW

Predict = Callable[[np.ndarray], np.ndarray]

SCORE = T.StructType([T.StructField("rul", T.DoubleType()), T.StructField("error", T.StringType())])
# Windows handed to the model at a time.
MODEL_BATCH = 1024
# The seconds that a scoring call may take, and the error of one that took longer.
DEADLINE = 10.0
TIMEOUT = "timeout"
# Calls of a batch that may run out of time: that of the batch, and one for each hanging window in it.
TRIES = 12


def scale_windows(df: DataFrame, scaler: DataFrame, features) -> DataFrame:
    """Apply a fitted min-max scaler to the matrices in ``x``."""
    bounds = _bounds(scaler, ["min", "max"])
    pairs = F.array(
        *[
            F.struct(
                F.lit(bounds[name][0]).cast("double").alias("low"),
                (F.lit(bounds[name][1]).cast("double") - F.lit(bounds[name][0]).cast("double")).alias("spread"),
            )
            for name in features
        ]
    )

    def scaled(value, pair):
        moved = F.try_divide(value - pair["low"], pair["spread"])
        return F.coalesce(moved, F.when(value.isNotNull(), F.lit(0.0)))

    return df.withColumn("x", F.transform("x", lambda row: F.zip_with(row, pairs, scaled)))


@contextmanager
def time_limit(seconds: float | None):
    """Raise :class:`TimeoutError` in the block once its time is up.  For the main thread, where tasks run their Python."""
    if seconds is None:
        yield
        return

    def stop(*_):
        raise TimeoutError(TIMEOUT)

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def score_windows(
    df: DataFrame,
    load: Callable[[], Predict],
    width: int,
    window: int = WINDOW,
    output: str = "rul",
    deadline: float | None = None,
    tries: int = TRIES,
) -> DataFrame:
    """Add the predicted RUL of every window in ``x`` and an ``error`` where there is none.

    ``load`` runs once per task and returns a function from an array ``[n, window, width]`` to
    ``n`` numbers.  Only the windows travel to Python, flattened; all other columns stay in the
    JVM.  A batch on which the model fails is scored window by window, so that one bad window
    costs only its own score.  Works on streams as well.

    ``deadline`` limits the seconds of a call of the model.  A batch that takes longer is scored window by window, too:
    every window on which the model hangs is waited for once, after the once for their batch.  After ``tries`` calls
    that ran out of time the rest of the batch is given up.  Windows without a score for that reason have the error
    ``timeout``.
    """

    @F.pandas_udf(SCORE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        left = tries

        def attempt(values) -> tuple[list, list]:
            nonlocal left
            if left <= 0:
                return [None] * len(values), [TIMEOUT] * len(values)
            try:
                matrix = np.stack(values).astype(float).reshape(-1, window, width)
                with time_limit(deadline):
                    found = np.asarray(predict(matrix), dtype=float).reshape(-1)
                if len(found) != len(values):
                    raise ValueError(f"{len(found)} predictions for {len(values)} windows")
                return list(found), [None] * len(values)
            except Exception as problem:
                if isinstance(problem, TimeoutError):
                    left -= deadline is not None
                if len(values) == 1:
                    return [None], [str(problem)]
                pairs = [attempt([value]) for value in values]
                return [pair[0][0] for pair in pairs], [pair[1][0] for pair in pairs]

        for batch in batches:
            rul = np.full(len(batch), None, dtype=object)
            error = np.full(len(batch), None, dtype=object)
            present, given = np.flatnonzero(batch.notna().to_numpy()), batch.to_numpy()
            for start in range(0, len(present), MODEL_BATCH):
                places, left = present[start : start + MODEL_BATCH], tries
                rul[places], error[places] = attempt([given[i] for i in places])
            yield pd.DataFrame({"rul": pd.Series(rul, dtype="Float64"), "error": error})

    shape = window_error(F.col("x"), window, width)
    earlier = [F.col("error")] if "error" in df.columns else []
    checked = df.withColumn("error", F.coalesce(*earlier, shape))
    flat = F.when(F.col("error").isNull(), F.flatten("x"))
    return (
        # Not to be evaluated again where a later filter asks for the score.
        checked.withColumn("_score", score.asNondeterministic()(flat))
        .withColumns({output: F.col("_score.rul"), "error": F.coalesce("error", "_score.error")})
        .drop("_score")
    )


def fit_rul_regressor(
    summaries: DataFrame, features, model: str = "linear", target: str = "y", seed: int = SEED
) -> PipelineModel:
    """Fit a regressor on the rows of ``summaries`` that lie in the training split.

    ``features`` are columns of :func:`fleetspan.operators.windows.window_summaries`; a ``split``
    column, where there is one, keeps validation and test rows out of the fit.
    """
    rows = summaries.where(F.col(target).isNotNull()).dropna(subset=list(features))
    if "split" in rows.columns:
        rows = rows.where(F.col("split") == "train")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    shared = {"featuresCol": "_features", "labelCol": target, "predictionCol": "y_pred"}
    if model == "linear":
        regressor = LinearRegression(solver="normal", **shared)
    elif model == "trees":
        regressor = GBTRegressor(seed=seed, **shared)
    else:
        raise ValueError(f"unknown model {model!r}")
    return Pipeline(stages=[assembler, regressor]).fit(rows)


def predict_rul(summaries: DataFrame, model: PipelineModel, target: str = "y") -> DataFrame:
    """``summaries`` with ``y_true`` and ``y_pred``, which is null where a feature is missing."""
    made = model.transform(summaries).drop("_features")
    known = F.lit(True)
    for name in model.stages[0].getInputCols():
        known = known & F.col(name).isNotNull() & ~F.isnan(name)
    return made.withColumns({"y_true": F.col(target), "y_pred": F.when(known, F.col("y_pred"))})
