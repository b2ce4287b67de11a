"""Readings stored once by engine: labels, windows and features from them need no shuffle.

Ordinary engines lie in one bucketed table, each whole in one bucket, with its place in the series, the series'
length and its last cycle beside every reading.  Engines that are too long for one task lie in a second table, cut into
chunks that are dealt over the buckets; a chunk also holds copies of the neighbouring readings that its frames
reach.  Writing takes one shuffle of the readings; whatever is derived later reads the buckets as they lie.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.operators.series import (
    ROWS_PER_TASK,
    WHOLE,
    Pieces,
    in_order,
    in_pieces,
    long_series,
    number_long,
    overlapping,
    split_long,
)
from fleetspan.schema import HORIZON, KEYS, TARGET, TIME, WINDOW
from fleetspan.shared import shared_folder

PLACES = ["_rn", "_n", "_end", "_left"]


@dataclass(frozen=True)
class StoredSeries:
    """Readings laid out by engine, for :mod:`windows` and :mod:`features` in place of a DataFrame.

    ``before`` and ``after`` say how far the frames of a chunk may reach.
    """

    keys: list[str]
    time: str
    before: int
    after: int
    ordinary: DataFrame
    chunks: DataFrame | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([field for field in self.ordinary.schema if field.name not in PLACES])

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def map(self, change: Callable[[DataFrame], DataFrame]) -> "StoredSeries":
        """The same layout with columns added or changed row by row."""
        return replace(self, ordinary=change(self.ordinary), chunks=None if self.chunks is None else change(self.chunks))

    def _rows(self) -> DataFrame:
        if self.chunks is None:
            return self.ordinary
        own = self.chunks.where(F.col("_copy") == F.col("_chunk")).drop("_copy", "_chunk")
        return self.ordinary.unionByName(own)

    def readings(self) -> DataFrame:
        """All readings, each once."""
        return self._rows().select(*self.columns)

    def lifetimes(self, name: str = "max_cycle") -> DataFrame:
        """Last cycle of every engine: one row is looked up in each series, nothing is grouped."""
        return self._rows().where(F.col("_rn") == F.col("_n")).select(*self.keys, F.col("_end").alias(name))

    def tail(self, k: int) -> DataFrame:
        """The last ``k`` readings of every engine with their places; each row is picked by itself."""
        return self._rows().where(F.col("_rn") > F.col("_n") - k)

    def engines(self) -> DataFrame:
        return self._rows().where(F.col("_rn") == 1).select(*self.keys)

    def labelled(self, target: str = TARGET, truncated: Column | None = None) -> "StoredSeries":
        """Add the cycles left at each reading.

        ``truncated`` tells the rows of engines that did not run to failure: what was left after their last reading
        comes from the list given when the layout was written, null where the list lacks the engine.
        """
        left = F.lit(0.0)
        if truncated is not None:
            left = F.when(truncated, F.col("_left")).otherwise(F.lit(0.0))
        return self.map(lambda rows: rows.withColumn(target, left + (F.col("_end") - F.col(self.time))))

    def pieces(self, before: int, after: int) -> Pieces:
        """The series for frames; an error where these reach further than the chunks' copies."""
        if self.chunks is not None and (before > self.before or after > self.after):
            raise ValueError(f"frames of {before} rows back and {after} ahead; the layout was written for {self.before} and {self.after}")
        return Pieces(self.keys, self.ordinary, [F.col("_rn").asc()], True, self.chunks)


def pieces_of(
    df: DataFrame | StoredSeries, wanted: list, keys, order, before: int, after: int, rows_per_task: int = ROWS_PER_TASK
) -> Pieces:
    """The series of a table or of a layout with the columns ``wanted``."""
    if not isinstance(df, StoredSeries):
        return in_pieces(df.select(*wanted), keys, order, before, after, rows_per_task)
    if list(keys) != df.keys or order[0] != df.time:
        raise ValueError(f"the layout is by {df.keys} and {df.time}, not by {list(keys)} and {order[0]}")
    return df.pieces(before, after).select(*wanted)


def _bucketed(df: DataFrame, path: str, buckets: int, by: list[str], sort: list[str]) -> None:
    """Write a table whose buckets a later session can name again."""
    name = f"series_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, *by).sortBy(*sort).option("path", path)
    writer.saveAsTable(name)
    # The files stay: the table is an external one.
    df.sparkSession.sql(f"DROP TABLE {name}")


def _named(spark: SparkSession, path: str, schema: str, buckets: int, by: list[str], sort: list[str]) -> DataFrame:
    name = f"series_{uuid.uuid4().hex}"
    quoted = lambda names: ", ".join(f"`{name}`" for name in names)
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in T.StructType.fromJson(json.loads(schema)))
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY ({quoted(by)}) SORTED BY ({quoted(sort)}) INTO {buckets} BUCKETS"
    )
    return spark.table(name)


def store_series(
    df: DataFrame,
    path: str | None = None,
    keys=KEYS,
    time=TIME,
    ties=(),
    rul_at_end: DataFrame | None = None,
    before: int = WINDOW - 1,
    after: int = HORIZON,
    rows_per_task: int = ROWS_PER_TASK,
    buckets: int | None = None,
) -> StoredSeries:
    """Write ``df`` by engine below ``path`` and open it.

    Readings follow each other by ``time``, ``ties`` and content.  ``rul_at_end`` (``keys`` plus ``rul_at_end``, one row
    an engine) is joined while the readings are shuffled for the layout.  ``before`` and ``after`` are the furthest
    that frames will reach over long series.  Without ``path`` the layout goes to a new place in the shared folder.
    Complex columns are stored as they are; a column may not be named like one of the layout's own.
    """
    spark = df.sparkSession
    clash = {*PLACES, "_chunk", "_copy"} & set(df.columns)
    if clash:
        raise ValueError(f"columns clash with those of the layout: {sorted(clash)}")
    path = path or f"{shared_folder(spark).rstrip('/')}/series-{uuid.uuid4().hex}"
    keys, order = list(keys), [time, *ties]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = long_series(df, keys, rows_per_task)
    ordinary, hot = (df, None) if long is None else split_long(df, keys, long)

    def with_left(rows: DataFrame) -> DataFrame:
        if rul_at_end is None:
            return rows.withColumn("_left", F.lit(None).cast("double"))
        return rows.join(rul_at_end.select(*keys, F.col("rul_at_end").cast("double").alias("_left")), keys, "left")

    series = Window.partitionBy(*keys)
    along = series.orderBy(*in_order(df, order))
    placed = ordinary.repartition(buckets, *keys).withColumns(
        {"_rn": F.row_number().over(along), "_n": F.count(F.lit(1)).over(along.rowsBetween(*WHOLE)), "_end": F.max(time).over(along.rowsBetween(*WHOLE))}
    )
    columns = [*df.columns, F.col("_rn").cast("long").alias("_rn"), F.col("_n").cast("long").alias("_n"), "_end", "_left"]
    _bucketed(with_left(placed).select(*columns), f"{path}/ordinary", buckets, keys, [*keys, "_rn"])
    if hot is not None:
        ends = hot.groupBy(*keys).agg(F.max(time).alias("_end"))
        if rul_at_end is not None:
            ends = with_left(ends)
        else:
            ends = ends.withColumn("_left", F.lit(None).cast("double"))
        # Few engines are that long: as many as rows fit the bound.
        same = [F.col(f"_end_{key}").eqNullSafe(F.col(key)) for key in keys]
        named = ends.select(*[F.col(key).alias(f"_end_{key}") for key in keys], "_end", "_left")
        condition = same[0]
        for one in same[1:]:
            condition = condition & one
        numbered = number_long(hot, keys, order, long.rows_per_piece)
        numbered = numbered.join(long.table.hint(named), condition).drop(*[f"_end_{key}" for key in keys])
        dealt = overlapping(numbered, long.rows_per_piece, before, after).repartition(buckets, *keys, "_copy")
        _bucketed(dealt.select(*columns, F.col("_chunk").cast("long").alias("_chunk"), F.col("_copy").cast("long").alias("_copy")), f"{path}/long", buckets, [*keys, "_copy"], [*keys, "_copy", "_rn"])
    stored = placed.withColumns({"_left": F.lit(0.0)}).select(*columns).schema
    note = {"keys": keys, "time": time, "before": before, "after": after, "buckets": buckets, "long": hot is not None, "schema": stored.json()}
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(f"{path}/layout")
    return open_series(spark, path)


def open_series(spark: SparkSession, path: str) -> StoredSeries:
    """A layout written earlier; its tables are named in this session's catalogue."""
    note = json.loads(spark.read.text(f"{path}/layout").first()[0])
    keys, buckets = note["keys"], note["buckets"]
    ordinary = _named(spark, f"{path}/ordinary", note["schema"], buckets, keys, [*keys, "_rn"])
    chunks = None
    if note["long"]:
        wider = T.StructType.fromJson(json.loads(note["schema"])).add("_chunk", "long").add("_copy", "long")
        chunks = _named(spark, f"{path}/long", wider.json(), buckets, [*keys, "_copy"], [*keys, "_copy", "_rn"])
    return StoredSeries(keys, note["time"], note["before"], note["after"], ordinary, chunks)
