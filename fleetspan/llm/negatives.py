"""Hard negatives by inner product, found through length buckets and sorted coordinates.

Rows are sorted by length over all tasks.  A bucket is some thousand rows that follow each other, so their lengths
are close.  For each coordinate a bucket holds its rows in the order of that coordinate of their directions.  An
anchor that looks for products from a bound on passes over a bucket whose longest row can't reach it.  In any other
bucket the bound becomes a smallest cosine, and for the coordinates in which the anchor's direction is largest this
gives ranges that a row has to lie in.  Rows in all ranges are candidates; their products are taken exactly.

The bounds come from the anchors themselves, as they are rows, too: the fifth best of those with the same label is
one that the fifth best of all rows can't fall below.  They rise as a task goes through its buckets.

Anchors are taken in blocks of bounded size, each broadcast once to all buckets.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import kept
from fleetspan.shared import numbered

# Rows of one bucket, and bytes of the anchors of one block.
BUCKET_ROWS = 2048
ANCHOR_BYTES = 32 << 20
# Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
# A range is this much wider than computed, for rounding.
SLACK = 1e-9
LARGEST = 1 << 24
NONE = np.iinfo(np.int64).min


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    if rows.shape[1] * np.abs(vector).max(initial=0) * np.abs(rows).max(initial=0) < 1 << 53:
        return (rows.astype(float) @ vector.astype(float)).astype(np.int64)
    return rows @ vector


def vectors_of(column: pa.Array) -> np.ndarray:
    """Arrays of whole numbers as a matrix, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    made = np.zeros((len(column), width), np.int64)
    made[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return made


@dataclass
class Anchors:
    """A block of anchors: ids, labels, vectors and what is known of each."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))
        directions = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
        self.angles = np.arccos(np.clip(np.take_along_axis(directions, self.focus, axis=1), -1, 1))


class Bucket:
    """Rows of about one length, each coordinate of their directions in order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.shortest, self.longest = norms.min(), norms.max()
        directions = (vectors / np.maximum(norms, 1e-300)[:, None]).T
        self.order = np.argsort(directions, axis=1, kind="stable")
        self.values = np.take_along_axis(directions, self.order, axis=1)

    def candidates(self, anchors: Anchors, at: int, bound: int) -> np.ndarray:
        """Places of all rows whose product with an anchor may reach ``bound``."""
        everything = np.arange(len(self.ids))
        norm = anchors.norms[at]
        if bound > norm * self.longest * (1 + SLACK):
            return everything[:0]
        length = norm * (self.longest if bound >= 0 else self.shortest)
        if bound <= -length or length == 0:
            return everything
        reach = np.arccos(min(1.0, bound / length))
        hits = np.zeros(len(self.ids), np.int8)
        known = 0
        for coordinate, angle in zip(anchors.focus[at], anchors.angles[at]):
            if coordinate >= len(self.values):
                continue
            low, high = np.cos(min(np.pi, angle + reach)) - SLACK, np.cos(max(0.0, angle - reach)) + SLACK
            values = self.values[coordinate]
            start, stop = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if stop - start < len(values):
                hits[self.order[coordinate, start:stop]] += 1
                known += 1
        return np.flatnonzero(hits == known)


def _buckets(batch: pa.RecordBatch, rows: int) -> Iterator[Bucket]:
    for start in range(0, len(batch), rows):
        part = batch.slice(start, rows)
        vectors = vectors_of(part.column("_vector"))
        yield Bucket(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), vectors)


def _fitted(bucket: Bucket, width: int) -> np.ndarray:
    """The vectors of a bucket in the anchors' number of coordinates; further ones meet zeros."""
    vectors = bucket.vectors
    if vectors.shape[1] >= width:
        return vectors[:, :width]
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def _best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:count]


class _Tops:
    """The best ids and scores of each list, as far as they were seen."""

    def __init__(self, lists: int, count: int):
        self.count = count
        self.ids = [np.zeros(0, np.int64)] * lists
        self.scores = [np.zeros(0, np.int64)] * lists

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[at], ids]), np.concatenate([self.scores[at], scores])
        best = _best(ids, scores, self.count)
        self.ids[at], self.scores[at] = ids[best], scores[best]

    def bound(self, at: int) -> int:
        """What a row needs at least to enter a list that is full."""
        return int(self.scores[at][-1]) if len(self.scores[at]) == self.count else NONE

    def rows(self, keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        sizes = [len(ids) for ids in self.ids]
        columns = [np.repeat(key, sizes) for key in keys]
        columns += [np.concatenate([*part, np.zeros(0, np.int64)]) for part in (self.ids, self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names=names)


def _positives(block, count: int, bucket_rows: int):
    """Per task: the best rows of the same label of every anchor."""

    def run(batches):
        anchors, least = block.value
        tops, width = _Tops(len(anchors.ids), count), anchors.vectors.shape[1]
        for batch in batches:
            for bucket in _buckets(batch, bucket_rows):
                vectors = _fitted(bucket, width)
                for label in np.unique(bucket.labels):
                    for at in np.flatnonzero(anchors.labels == label):
                        bound = max(int(least[at]), tops.bound(at))
                        found = bucket.candidates(anchors, at, bound)
                        found = found[(bucket.labels[found] == label) & (bucket.ids[found] != anchors.ids[at])]
                        if len(found):
                            scores = products(vectors[found], anchors.vectors[at])
                            good = scores >= bound
                            tops.add(at, bucket.ids[found[good]], scores[good])
        yield tops.rows([anchors.ids], ["anchor_id", "positive_id", "score"])

    return run


def _negatives(block, count: int, low: int, high: int, bucket_rows: int):
    """Per task: for every anchor and positive, the best rows of other labels in the positive's range of scores."""

    def run(batches):
        anchors, owners, positives, scores = block.value
        # low * score <= 100 * other <= high * score in whole numbers.
        floors, ceilings = -((-low * scores) // 100), (high * scores) // 100
        tops, width = _Tops(len(owners), count), anchors.vectors.shape[1]
        starts = np.searchsorted(owners, np.arange(len(anchors.ids) + 1))
        for batch in batches:
            for bucket in _buckets(batch, bucket_rows):
                vectors = _fitted(bucket, width)
                for at in range(len(anchors.ids)):
                    lists = [i for i in range(starts[at], starts[at + 1]) if floors[i] <= ceilings[i]]
                    if not lists:
                        continue
                    bounds = {i: max(int(floors[i]), tops.bound(i)) for i in lists}
                    found = bucket.candidates(anchors, at, min(bounds.values()))
                    found = found[bucket.labels[found] != anchors.labels[at]]
                    if not len(found):
                        continue
                    made = products(vectors[found], anchors.vectors[at])
                    for i in lists:
                        good = (made >= bounds[i]) & (made <= ceilings[i])
                        if good.any():
                            tops.add(i, bucket.ids[found[good]], made[good])
        yield tops.rows([anchors.ids[owners], positives], ["anchor_id", "positive_id", "negative_id", "negative_score"])

    return run


def _first(df: DataFrame, keys, score: str, other: str, count: int, rank: str) -> DataFrame:
    """The best ``count`` rows of each key out of those that the tasks found."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(other))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= count)


def _gathered(rows: list) -> Anchors:
    vectors = vectors_of(pa.array([row["_vector"] for row in rows], pa.list_(pa.int64())))
    return Anchors(np.array([row["vec_id"] for row in rows]), np.array([row["label"] for row in rows]), vectors)


def prepared_vectors(vectors: DataFrame, label: Column, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id``, ``label`` and the vector in whole numbers ``floor(scale * x)``, sorted by length over all tasks.

    Rows without id or label, without vector, or with a component that is null or not finite take no part.  Of
    several rows with one id, that with the smallest label, then the smallest vector, stands for it.
    """
    number = lambda x: x.cast("double")
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    too_large = F.raise_error(F.lit(f"a vector has a component of {LARGEST} or more after scaling")).cast("long")
    whole = lambda x: F.floor(F.lit(float(scale)) * number(x))
    bounded = lambda x: F.when(F.abs(F.lit(float(scale)) * number(x)) < LARGEST, whole(x)).otherwise(too_large)
    fit = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col(vector).isNotNull()).where(~unfit)
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector, bounded).alias("_vector"))
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "_vector")).alias("_row")).select("vec_id", "_row.*")
    square = F.aggregate("_vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    ranged = once.withColumn("_square", square)
    order = [F.col("_square").desc(), F.col("vec_id")]
    return kept(ranged.repartitionByRange(*order).sortWithinPartitions(*order), "vectors-by-length")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    anchor_bytes: int = ANCHOR_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, a label (column ``label``, or the expression given) and a vector; ``is_anchor`` picks
    anchors by ``vec_id``.  Vectors count as whole numbers ``floor(scale * x)``, a row's score is its inner product with
    the anchor, higher ones come first, ties by smaller id.  An anchor's positives are its first ``positives`` other rows
    of the same label.  For each of them the first ``negatives`` rows of another label are returned whose score is
    ``low`` to ``high`` percent of the positive's; below zero that range is empty unless ``low >= high``.

    :func:`prepared_vectors` says which rows take part and what repeated ids give.  A shorter vector counts as filled up
    with zeros, an empty or zero one scores 0.  Anchors without positives, positives without negatives, and empty tables
    give no rows.  Further columns are left out, whatever their names.  A scaled component of 2^24 or more is an error.
    """
    rows = prepared_vectors(vectors, F.col("label") if label is None else label, vector, scale)
    width = rows.agg(F.max(F.size("_vector"))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    anchors = rows.where(is_anchor).select("vec_id", "label", "_vector")
    per_block = max(1, anchor_bytes // (8 * (width + 2) * 2))
    placed = kept(numbered(anchors, ["vec_id"]).withColumn("_block", F.floor(F.col("_index") / per_block)), "anchors")
    last = placed.agg(F.max("_block")).first()[0]
    if last is None:
        return vectors.sparkSession.createDataFrame([], schema)
    made = [_block_negatives(rows, placed, block, positives, negatives, low, high, bucket_rows) for block in range(last + 1)]
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole


def _block_negatives(rows, placed, block, positives, negatives, low, high, bucket_rows) -> DataFrame:
    """The negatives of one block of anchors, kept; the block is what the driver and the workers hold."""
    spark = rows.sparkSession
    own = placed.where(F.col("_block") == block).select("vec_id", "label", "_vector")
    anchors = _gathered(own.orderBy("vec_id").collect())

    def search(source: DataFrame, least: np.ndarray) -> list:
        shared = spark.sparkContext.broadcast((anchors, least))
        found = source.mapInArrow(_positives(shared, positives, bucket_rows), "anchor_id long, positive_id long, score long")
        best = _first(found, ["anchor_id"], "score", "positive_id", positives, "_place").collect()
        shared.unpersist()
        return sorted((row["anchor_id"], row["_place"], row["positive_id"], row["score"]) for row in best)

    # A first bound from the anchors, which are rows as well.
    least = np.full(len(anchors.ids), NONE)
    for anchor_id, place, _, score in search(own, least):
        if place == positives:
            least[np.searchsorted(anchors.ids, anchor_id)] = score
    best = search(rows, least)
    owners = np.searchsorted(anchors.ids, np.array([row[0] for row in best], np.int64))
    ids, scores = (np.array([row[i] for row in best], np.int64) for i in (2, 3))
    shared = spark.sparkContext.broadcast((anchors, owners, ids, scores))
    pairs = rows.mapInArrow(
        _negatives(shared, negatives, low, high, bucket_rows), "anchor_id long, positive_id long, negative_id long, negative_score long")
    ranked = _first(pairs, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank")
    known = spark.createDataFrame(
        pa.table({"anchor_id": pa.array([row[0] for row in best], pa.int64()), "positive_id": pa.array(ids), "positive_score": pa.array(scores)}))
    # At most a few rows for each anchor of the block.
    joined = ranked.join(F.broadcast(known), ["anchor_id", "positive_id"])
    made = kept(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    shared.unpersist()
    return made
