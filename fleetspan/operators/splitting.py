"""Splitting a fleet so that every engine lies on one side."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.quantiles import ROWS_PER_TASK, value_at
from fleetspan.schema import KEYS, SEED, VALIDATION_SHARE
from fleetspan.shared import settle


def engines(df: DataFrame, keys=KEYS) -> DataFrame:
    """The distinct engines."""
    return df.select(*keys).distinct()


def split_by_engine(
    df: DataFrame,
    share: float = VALIDATION_SHARE,
    seed: int = SEED,
    keys=KEYS,
    order: Callable[..., Column] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``split``: ``val`` for exactly ``int(engines * share)`` engines, ``train`` for the rest.

    The engines with the smallest hash of key and seed (or smallest ``order`` of their key
    columns) form the validation side.  The hash at
    the cut is looked up once; after that a reading is assigned by its own hash, without a
    join or a shuffle of the readings.
    """
    return df.withColumn("split", engine_side(engines(df, keys), share, seed, keys, order, rows_per_task))


def engine_side(
    fleet: DataFrame,
    share: float = VALIDATION_SHARE,
    seed: int = SEED,
    keys=KEYS,
    order: Callable[..., Column] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> Column:
    """``train`` or ``val`` for the readings of a fleet whose engines are given, one row each."""
    hashed = F.xxhash64(*keys, F.lit(seed)) if order is None else order(*map(F.col, keys))
    schema = fleet.schema
    fleet = settle(fleet.withColumn("_hash", hashed))
    wanted = int(fleet.rows * share)
    if wanted == 0:
        return F.lit("train")
    cut = value_at(fleet.df, "_hash", wanted, rows_per_task)
    inside = F.col("_hash") < F.lit(cut)
    below = fleet.df.where(inside).count()
    # Engines that share the hash at the cut are taken in key order until the side is full.
    same = fleet.df.where(F.col("_hash") == F.lit(cut)).orderBy(*keys).limit(wanted - below)
    last = same.orderBy(*[F.col(key).desc() for key in keys]).first()
    place = F.struct(*[F.lit(last[key]).cast(schema[key].dataType).alias(key) for key in keys])
    chosen = (hashed < F.lit(cut)) | ((hashed == F.lit(cut)) & (F.struct(*keys) <= place))
    return F.when(chosen, F.lit("val")).otherwise(F.lit("train"))


def split_by_share(
    df: DataFrame,
    share: float = VALIDATION_SHARE,
    seed: int = SEED,
    keys=KEYS,
    order: Callable[..., Column] | None = None,
) -> DataFrame:
    """Add ``split`` with an expected rather than exact share; also fits streams."""
    fine = 1_000_000
    hashed = F.xxhash64(*keys, F.lit(seed)) if order is None else order(*map(F.col, keys))
    chosen = F.pmod(hashed, F.lit(fine)) < F.lit(int(share * fine))
    return df.withColumn("split", F.when(chosen, F.lit("val")).otherwise(F.lit("train")))


def side(df: DataFrame, name: str) -> DataFrame:
    """The rows of one side of a split."""
    return df.where(F.col("split") == name).drop("split")
