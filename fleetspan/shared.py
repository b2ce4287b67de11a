"""Small tables: kept once in the shared folder, counted, and only then broadcast."""

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table above this size, by its rows and the widths of its columns, is never broadcast.
BROADCAST_BYTES = 128 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="fleetspan-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def width(kind: T.DataType) -> int:
    """Bytes that a value of a type takes in a broadcast table, strings and arrays by a usual length."""
    if isinstance(kind, T.StructType):
        return 16 + sum(8 + width(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return 16 + 16 * width(kind.elementType)
    if isinstance(kind, T.MapType):
        return 32 + 16 * (width(kind.keyType) + width(kind.valueType))
    return 48 if isinstance(kind, (T.StringType, T.BinaryType, T.VariantType)) else 8


@dataclass(frozen=True)
class SmallTable:
    """A checkpointed table with its row count."""

    df: DataFrame
    rows: int

    @property
    def fits(self) -> bool:
        """Whether the table may be broadcast."""
        return self.rows * width(self.df.schema) <= BROADCAST_BYTES

    @property
    def side(self) -> DataFrame:
        """The table as a join side: broadcast while small, shuffled beyond the bound."""
        return self.hint(self.df)

    def hint(self, part: DataFrame) -> DataFrame:
        """The same choice for rows selected from the table."""
        return F.broadcast(part) if self.fits else part


def settle(df: DataFrame) -> SmallTable:
    """Compute ``df`` once, keep it in the shared folder and count it."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    return SmallTable(kept, kept.count())


def match(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Join on ``keys`` with null equal to null; the key columns come from ``left``.

    Without keys ``right`` holds one row, whose values are added as constants.
    """
    if not keys:
        if how == "left_anti":
            return left.where(F.lit(False))
        row = right.first()
        extra = {} if how == "left_semi" else row.asDict()
        types = {field.name: field.dataType for field in right.schema}
        return left.withColumns({name: F.lit(value).cast(types[name]) for name, value in extra.items()})
    names = [f"_match_{i}" for i in range(len(keys))]
    right = right.select(
        *[F.col(key).alias(name) for key, name in zip(keys, names)],
        *[name for name in right.columns if name not in keys],
    )
    condition = None
    for key, name in zip(keys, names):
        same = left[key].eqNullSafe(F.col(name))
        condition = same if condition is None else condition & same
    return left.join(right, condition, how).drop(*names)


def attach(df: DataFrame, table: DataFrame, keys, rows_per_key: str, crowded: int) -> DataFrame:
    """Add the columns of ``table`` (one row per key) to every row of ``df``.

    ``table`` is computed once and broadcast while it is small.  Beyond that the join shuffles,
    except for the keys with more than ``crowded`` rows (column ``rows_per_key``): these are few
    by their size, so they are broadcast and their rows stay where they are.
    """
    kept = settle(table)
    plain = kept.df.drop(rows_per_key)
    if kept.fits:
        return match(df, F.broadcast(plain), keys, "left")
    hot = settle(kept.df.where(F.col(rows_per_key) > crowded))
    if hot.rows == 0 or not hot.fits:
        return match(df, plain, keys, "left")
    ids = F.broadcast(hot.df.select(*keys))
    ordinary = match(match(df, ids, keys, "left_anti"), plain, keys, "left")
    return ordinary.unionByName(match(df, F.broadcast(hot.df.drop(rows_per_key)), keys, "inner"))


def _in_ranges(df: DataFrame, order) -> tuple[DataFrame, Column, Column]:
    """``df`` sorted by ranges and kept once, with the number of the range and the place in it."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    path = f"{shared_folder(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    ranges.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored, F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))


def numbered(df: DataFrame, order) -> DataFrame:
    """Rows with ``_index``, their place in ``order`` over the whole table, from 0.

    Spark ranges the rows by the columns' own types and sorts each range by itself; the ranges are kept once
    in the shared folder, counted, and shifted by the counts before them.  Only one count per range meets
    in one task.
    """
    return _shifted(*_in_ranges(df, order), F.lit(1))


def accumulated(df: DataFrame, order, weight: str) -> DataFrame:
    """Rows with ``_index``, the sum of ``weight`` over all rows before them in ``order``."""
    stored, piece, place = _in_ranges(df, order)
    inside = Window.partitionBy("_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = stored.withColumn("_piece", piece).withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return _shifted(summed.drop("_piece"), piece, F.col("_inside"), F.col(weight)).drop("_inside")


def _shifted(stored: DataFrame, piece: Column, place: Column, weight: Column) -> DataFrame:
    counts = stored.groupBy(piece.alias("_piece")).agg(F.sum(weight).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_piece", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        stored.withColumn("_at", place)
        .join(F.broadcast(starts), piece == F.col("_piece"))
        .withColumn("_index", (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_piece", "_place", "_start", "_at")
    )
