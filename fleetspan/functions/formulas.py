"""Column formulas shared by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keeps divisions by (almost) zero finite.
TINY = 1e-8


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# Thresholds and labels of the quality grades.
R2_GRADES = [(0.9, "Excellent"), (0.8, "Good"), (0.6, "Fair")]
R2_LOWEST = "Poor"
OVERFITTING = "Poor - Significant overfitting"
NO_CONVERGENCE = "Poor - Poor convergence"
STOP_EARLIER = "Fair - Could benefit from early stopping"
CONVERGED = "Good - Well converged"


def prediction_grade(r2: Column) -> Column:
    grade = F.lit(R2_LOWEST)
    for bound, label in reversed(R2_GRADES):
        grade = F.when(r2 > bound, label).otherwise(grade)
    return grade


def training_grade(overfitting: Column, convergence: Column, final_loss: Column, best_loss: Column) -> Column:
    return (
        F.when(overfitting > 0.5, OVERFITTING)
        .when(convergence < 0.3, NO_CONVERGENCE)
        .when(final_loss > best_loss * 1.1, STOP_EARLIER)
        .otherwise(CONVERGED)
    )
