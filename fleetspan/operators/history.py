"""Loss histories of training runs, and choosing runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.functions.formulas import training_grade
from fleetspan.operators.series import ROWS_PER_TASK, number_rows

# Fixed value: the message of a run that can't be analysed.
TOO_SHORT = "Insufficient training data for analysis"


def _slope(loss: str, recent: Column, place: Column) -> Column:
    # One point has no line; the least-squares answer of smallest norm is loss / (2 * epoch).
    lone = F.max(F.when(recent, F.col(loss) / (2 * place)))
    line = F.regr_slope(F.when(recent, F.col(loss)), F.when(recent, place.cast("double")))
    return F.when(F.count_if(recent) > 1, line).otherwise(lone)


def training_history(df: DataFrame, run="run_id", epoch="epoch", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per run of ``run, epoch, train_loss, val_loss``: convergence, stability, overfitting.

    Epochs count by their order.  Runs with a single epoch carry an ``error`` and no measures.
    """
    rows = number_rows(df.select(run, epoch, "train_loss", "val_loss"), [run], [epoch], "_at", "_n", rows_per_task)
    place, length = F.col("_at"), F.col("_n")
    recent = place > length - F.floor(length / 5)
    last_ten = place > length - 10
    measures = rows.groupBy(run).agg(
        F.max("_n").alias("epochs"),
        F.min_by("train_loss", "_at").alias("_first_loss"),
        F.max_by("train_loss", "_at").alias("final_train_loss"),
        F.max_by("val_loss", "_at").alias("final_val_loss"),
        F.min(F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "_at"))).alias("_best"),
        F.var_pop(F.when(last_ten, F.col("train_loss"))).alias("_train_variance"),
        F.var_pop(F.when(last_ten, F.col("val_loss"))).alias("_val_variance"),
        _slope("train_loss", recent, place).alias("_train_slope"),
        _slope("val_loss", recent, place).alias("_val_slope"),
    )
    overfits = (F.col("epochs") > 5) & (F.col("_train_slope") < -0.001) & (F.col("_val_slope") > 0.001)
    score = F.when(
        overfits,
        F.least(F.lit(1.0), F.try_divide(F.abs("_val_slope"), F.abs("_train_slope"))),
    ).otherwise(F.lit(0.0))
    first = F.col("_first_loss")
    convergence = F.when(first > 0, F.try_divide(first - F.col("final_train_loss"), first)).otherwise(F.lit(0.0))
    made = measures.select(
        run,
        "epochs",
        "final_train_loss",
        "final_val_loss",
        F.col("_best.val_loss").alias("best_val_loss"),
        F.col("_best._at").alias("best_epoch"),
        score.alias("overfitting_score"),
        convergence.alias("convergence_rate"),
        (1 / (1 + F.col("_train_variance"))).alias("train_stability"),
        (1 / (1 + F.col("_val_variance"))).alias("val_stability"),
    ).withColumns(
        {
            "early_stopping_opportunity": F.col("best_epoch") < F.col("epochs") * 0.8,
            "training_quality": training_grade(
                F.col("overfitting_score"), F.col("convergence_rate"), F.col("final_val_loss"), F.col("best_val_loss")
            ),
        }
    )
    enough = F.col("epochs") >= 2
    return made.select(
        run,
        "epochs",
        *[F.when(enough, F.col(name)).alias(name) for name in made.columns if name not in (run, "epochs")],
        F.when(~enough, F.lit(TOO_SHORT)).alias("error"),
    )


def val_loss_of(name: Column) -> Column:
    """The validation loss written into a checkpoint name, null where there is none."""
    return F.regexp_extract(name, r"val_loss=(.*?)\.ckpt", 1).try_cast("double")


def best_runs(df: DataFrame, k: int = 1, by=(), loss="val_loss", name="name") -> DataFrame:
    """The ``k`` runs of smallest loss per group, with ``rank``; runs without a loss are left out."""
    known = df.where(F.col(loss).isNotNull())
    if not by:
        best = known.orderBy(loss, name).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(loss, name)).cast("long"))
    order = Window.partitionBy(*by).orderBy(loss, name)
    ranked = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def latest_run(df: DataFrame, by=(), name="name", modified="modified") -> DataFrame:
    """The newest run per group."""
    newest = F.max(F.struct(modified, name)).alias("_newest")
    return df.groupBy(*by).agg(newest).select(*by, f"_newest.{name}", f"_newest.{modified}")
