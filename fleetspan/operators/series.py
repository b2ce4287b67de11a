"""Row numbers and row frames per engine that stay balanced when one engine is huge.

A plain window puts all rows of one key into one task.  Here the rows per key are counted
first (map-side combined, keys only).  Keys within the bound take the plain window: one
shuffle.  Rows of longer series are numbered by ranges of their keys and order, whatever the
types, and framed in chunks of bounded size.

Rows that are equal in their order columns follow each other by a hash of their content, in short
and in long series alike, so that neither partitioning nor size decides between them.
"""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.shared import SmallTable, accumulated, match, numbered, settle

# A series with more rows than this is cut into pieces.
ROWS_PER_TASK = 250_000

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


@dataclass(frozen=True)
class LongSeries:
    """Keys with too many rows for one task (``_n`` rows each) and the size to cut them to."""

    table: SmallTable
    rows_per_piece: int


def ascending(order) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in order]


def long_series(df: DataFrame, keys, rows_per_task: int = ROWS_PER_TASK) -> LongSeries | None:
    """Keys with more than ``rows_per_task`` rows, or None when there is no such key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    longest = counts.agg(F.max("_n")).first()[0]
    if longest is None or longest <= rows_per_task:
        return None
    return LongSeries(settle(counts.where(F.col("_n") > rows_per_task)), rows_per_task)


def split_long(df: DataFrame, keys, long: LongSeries) -> tuple[DataFrame, DataFrame]:
    """The rows of the ordinary keys and the rows of the long ones."""
    ids = long.table.df.select(*keys)
    side = long.table.hint(ids)
    return match(df, side, keys, "left_anti"), match(df, side, keys, "left_semi")


def moment(df: DataFrame, name: str) -> Column:
    """A time column as a number of seconds or cycles; times without zone count on the wall clock."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double") * 86400
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(F.col(name).cast("date")).cast("double") * 86400
        return day + F.hour(name) * 3600 + F.minute(name) * 60 + F.extract(F.lit("SECOND"), name).cast("double")
    return F.col(name).cast("double")


def content(df: DataFrame) -> list[str]:
    """The columns that can be grouped and hashed."""
    return [field.name for field in df.schema if not isinstance(field.dataType, (T.MapType, T.VariantType))]


def tie_break(df: DataFrame) -> Column:
    """What comes last in the order of a series' rows."""
    return F.xxhash64(*content(df))


def in_order(df: DataFrame, order) -> list[Column]:
    """The order of a series' rows: order columns, then content."""
    return [*ascending(order), tie_break(df).asc()]


def number_long(df: DataFrame, keys, order, rows_per_piece: int) -> DataFrame:
    """``df`` with ``_rn`` (1-based position in the series) and ``_n`` (length).

    All rows are numbered together in the order of keys, order columns and content, by ranges of the columns'
    own types; a series' positions count from its smallest number.  Where a reading has very many copies they
    are counted first, numbered as one weighted row, and written out again in blocks.
    """
    plain = content(df)
    along = [*ascending(keys), *in_order(df, order)]
    copied = df.groupBy(F.xxhash64(*plain)).count().agg(F.max("count")).first()[0] or 0
    if copied > rows_per_piece and len(plain) == len(df.columns):
        counted = accumulated(df.groupBy(*plain).agg(F.count(F.lit(1)).alias("_copies")), along, "_copies")
        last = F.floor((F.col("_copies") - 1) / rows_per_piece)
        blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        first = F.col("_block") * rows_per_piece
        stop = F.least(F.col("_copies"), first + rows_per_piece)
        spread = blocks.repartition("_index", "_block").withColumn("_copy", F.explode(F.sequence(first, stop - 1)))
        rows = spread.withColumn("_index", F.col("_index") + F.col("_copy")).drop("_copies", "_block", "_copy")
    else:
        rows = numbered(df, along)
    starts = settle(rows.groupBy(*keys).agg(F.min("_index").alias("_start"), F.count(F.lit(1)).alias("_n")))
    placed = match(rows, starts.side, keys, "inner")
    return placed.withColumn("_rn", F.col("_index") - F.col("_start") + 1).drop("_index", "_start")


def number_rows(
    df: DataFrame, keys, order, number="_rn", length: str | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add the 1-based position of every row within its key, and optionally the row count."""
    wanted = [number] + ([length] if length else [])

    def named(rows: DataFrame) -> DataFrame:
        renamed = rows.withColumn(number, F.col("_rn").cast("long"))
        if length:
            renamed = renamed.withColumn(length, F.col("_n").cast("long"))
        return renamed.select(*df.columns, *wanted)

    series = Window.partitionBy(*keys).orderBy(*in_order(df, order))

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "_rn": F.row_number().over(series),
                "_n": F.count(F.lit(1)).over(series.rowsBetween(*WHOLE)),
            }
        )

    long = long_series(df, keys, rows_per_task)
    if long is None:
        return named(plain(df))
    ordinary, hot = split_long(df, keys, long)
    return named(plain(ordinary)).unionByName(named(number_long(hot, keys, order, long.rows_per_piece)))


@dataclass(frozen=True)
class Pieces:
    """Series ready for frames: ordinary ones whole, long ones in chunks that overlap.

    ``ordinary`` is in the order of ``along`` within ``keys``; where ``numbered``, it has ``_rn`` (position in the
    series) and ``_n`` (series length).  ``chunks``, if there are any, has both, ``_chunk`` (the chunk that a row
    belongs to) and ``_copy`` (the chunk that this copy serves).
    """

    keys: list[str]
    ordinary: DataFrame
    along: list[Column]
    numbered: bool = False
    chunks: DataFrame | None = None

    def select(self, *columns) -> "Pieces":
        """The same series with other columns; the ones for places stay."""
        own = ["_rn", "_n"] if self.numbered else []
        chunks = None if self.chunks is None else self.chunks.select(*columns, "_rn", "_n", "_chunk", "_copy")
        return replace(self, ordinary=self.ordinary.select(*columns, *own), chunks=chunks)

    def over(self, columns: Callable[[WindowSpec], dict[str, Column]], keep: Column | None = None) -> DataFrame:
        """Add ``columns(window)``; ``keep`` may filter on ``_rn`` and ``_n``."""
        keep = F.lit(True) if keep is None else keep
        series = Window.partitionBy(*self.keys).orderBy(*self.along)
        places = {} if self.numbered else {
            "_rn": F.row_number().over(series),
            "_n": F.count(F.lit(1)).over(series.rowsBetween(*WHOLE)),
        }
        whole = self.ordinary.withColumns({**places, **columns(series)}).where(keep).drop("_rn", "_n")
        if self.chunks is None:
            return whole
        piece = Window.partitionBy(*self.keys, "_copy").orderBy("_rn")
        done = self.chunks.withColumns(columns(piece)).where(keep & (F.col("_copy") == F.col("_chunk")))
        return whole.unionByName(done.drop("_chunk", "_copy", "_rn", "_n"))

    def sorted(self) -> list[DataFrame]:
        """Every part with its series together and in order: ``_series`` tells them apart, ``_own`` marks no copies.

        It is a window that asks for both, so that Spark can't take either away; its order lasts in what follows
        row by row.
        """
        series = Window.partitionBy(*self.keys).orderBy(*self.along)
        made = [self.ordinary.withColumns({"_series": F.xxhash64(*self.keys), "_own": F.row_number().over(series) > 0})]
        if self.chunks is not None:
            piece = Window.partitionBy(*self.keys, "_copy").orderBy("_rn")
            own = (F.col("_copy") == F.col("_chunk")) & (F.row_number().over(piece) > 0)
            made.append(self.chunks.withColumns({"_series": F.xxhash64(*self.keys, "_copy"), "_own": own}))
        return made


def overlapping(numbered_rows: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Numbered rows with ``_chunk``, and a copy for every chunk whose frames reach them (``_copy``)."""
    size = max(size, before + after)
    place = (F.col("_rn") - 1) % size
    chunk = F.floor((F.col("_rn") - 1) / size)
    copies = F.array_compact(
        F.array(
            F.col("_chunk"),
            F.when(place >= size - before, F.col("_chunk") + 1),
            F.when((place < after) & (F.col("_chunk") > 0), F.col("_chunk") - 1),
        )
    )
    return numbered_rows.withColumn("_chunk", chunk).withColumn("_copy", F.explode(copies))


def in_pieces(df: DataFrame, keys, order, before: int = 0, after: int = 0, rows_per_task: int = ROWS_PER_TASK) -> Pieces:
    """Series of ``df`` for frames that reach at most ``before`` rows back and ``after`` ahead."""
    along = in_order(df, order)
    long = long_series(df, keys, rows_per_task)
    if long is None:
        return Pieces(list(keys), df, along)
    ordinary, hot = split_long(df, keys, long)
    chunks = overlapping(number_long(hot, keys, order, long.rows_per_piece), long.rows_per_piece, before, after)
    return Pieces(list(keys), ordinary, along, chunks=chunks)


def over_series(
    df: DataFrame,
    keys,
    order,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    keep: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``columns(window)`` whose frames reach at most ``before`` rows back and ``after`` ahead.

    ``keep`` may filter on ``_rn`` (position in the series) and ``_n`` (series length).
    """
    return in_pieces(df, keys, order, before, after, rows_per_task).over(columns, keep)


def last_rows(df: DataFrame, keys, order, k: int) -> DataFrame:
    """The last ``k`` rows per key, with ``_back`` = 1 for the newest.

    The filter on the row number lets Spark cut every map task to ``k`` rows per key before the
    shuffle, so the length of a series does not matter.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(name).desc_nulls_first() for name in order], tie_break(df).desc())
    return df.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= k)
