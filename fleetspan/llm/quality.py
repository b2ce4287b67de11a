"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a text (lengths, letters, symbols, repetition) are standardised and mapped by random
Fourier features, which approximate a Gaussian kernel.  Every partition sums its part of the normal
equations, tasks add up these parts one row of the equations at a time, and ridge regression gives raw
scores.  Isotonic regression on binned raw scores turns them into probabilities of label 1.

Labels with null quality or null id are left out, several labels of one id count by the highest, and
ids without a document are ignored.  A null text counts as empty.  Without any label every score is 0.5;
with one class only, every score is that class.  Rows are judged by themselves, repeated or not, and by
their whole texts, however long.  An empty table gives an empty result.  ``good_documents`` keeps further
columns of any name.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fleetspan.llm.common import free, kept, small

THRESHOLD = 0.3
FEATURES = 256
LENGTH_SCALE = 6.0
RIDGE = 1e-3
SEED = 20_240_229
# Bins of the raw scores for the calibration.
BINS = 400
STATISTICS = 22
TEXTS_AT_ONCE = 256


def text_statistics(text) -> list:
    """``STATISTICS`` numbers that describe one text; zeros for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = counts / size
    present = share[share > 0]
    used = Counter(words)
    windows = n - 4
    if windows > 1:
        repeated = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / windows
    else:
        repeated = 0.0
    lines = [line for line in data.split(b"\n") if line.strip()]
    ends = Counter(word[-1] for word in words)
    heads = Counter(word[0] for word in words)
    letters = share[65:91].sum() + share[97:123].sum()
    symbols = share[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    return [
        np.log1p(n),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        letters,
        share[65:91].sum() / max(letters, 1e-9),
        share[48:58].sum(),
        share[128:].sum(),
        symbols,
        share[33] + share[63],
        share[44] + share[46],
        share[124],
        -(present * np.log2(present)).sum(),
        len(used) / n,
        max(used.values()) / n,
        repeated,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(ends[c] for c in b"#*$%&|<>!") / n,
        sum(heads[c] for c in range(65, 91)) / n,
        (ends[44] + ends[46]) / n,
        n / max(len(lines), 1) / 100,
    ]


def _measured(texts: pa.Array) -> Iterator[np.ndarray]:
    """Statistics of some texts at a time: only so many are Python strings at once."""
    for start in range(0, len(texts), TEXTS_AT_ONCE):
        part = texts.slice(start, TEXTS_AT_ONCE).to_pylist()
        yield np.array([text_statistics(text) for text in part], float).reshape(-1, STATISTICS)


@F.arrow_udf(ArrayType(DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    flat = np.concatenate([np.zeros((0, STATISTICS)), *_measured(texts)]).reshape(-1)
    ends = np.arange(len(texts) + 1, dtype=np.int32) * STATISTICS
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def statistics(text: Column) -> Column:
    return _statistics(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0, 1)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means per bin made non-decreasing by pooling neighbours."""
    pools: list = []
    for total, count in zip(sums, counts):
        pools.append([total, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total_, count_, bins = pools.pop()
            pools[-1][0] += total_
            pools[-1][1] += count_
            pools[-1][2] += bins
    return np.concatenate([np.full(bins, total / count) for total, count, bins in pools])


def _matrix(batch, name="_stats") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


EQUATIONS = "i int, part int, terms binary"


def _sums(model: QualityModel):
    """A partition's part of the normal equations: a row for each of them, its right side last."""

    def run(batches):
        width, seen = len(model.phases) + 1, 0
        sums = np.zeros((width, width + 1))
        for batch in batches:
            if len(batch):
                waves, label = model.features(_matrix(batch)), batch.column("_label").to_numpy()
                sums += waves.T @ np.column_stack([waves, label])
                seen += len(batch)
        if seen:
            part = TaskContext.get().partitionId()
            yield _equations(list(range(width)), [part] * width, [row.tobytes() for row in sums])

    return run


def _equations(i: list, part: list, terms: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(part, pa.int32()), pa.array(terms, pa.binary())], names=["i", "part", "terms"])


def _added(batches):
    """Each equation summed over all parts; rows come sorted by equation and part, one sum is held."""
    current, total = None, np.zeros(0)
    for batch in batches:
        for i, terms in zip(batch.column("i").to_pylist(), batch.column("terms")):
            own = np.frombuffer(terms.as_buffer())
            if i == current:
                total = total + own
                continue
            if current is not None:
                yield _equations([current], [0], [total.tobytes()])
            current, total = i, own
    if current is not None:
        yield _equations([current], [0], [total.tobytes()])


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """The square and the right side over rows ``_stats, _label``; the driver gets their sums only."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.mapInArrow(_sums(model), EQUATIONS).repartition(count, "i").sortWithinPartitions("i", "part")
    found = parts.mapInArrow(_added, EQUATIONS).orderBy("i").collect()
    sums = np.stack([np.frombuffer(row["terms"]) for row in found])
    return sums[:, :-1], sums[:, -1]


def _bins(model: QualityModel, low: float, high: float):
    def run(batches):
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch)), low, high)
            at = np.minimum(((raw - low) / (high - low) * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("_label")], names=["bin", "label"])

    return run


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on rows ``doc_id, _stats`` that have a label and are not held out."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("_label"))
    rows = stats.select("doc_id", "_stats").where(~held_out(F.col("doc_id"))).join(marks, "doc_id")
    # Dealt and sorted by content, so that a rerun sums in the same order.
    count = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(count, "doc_id").sortWithinPartitions("doc_id", "_stats").select("_stats", "_label")
    column = lambda i: F.col("_stats")[i]
    sizes = rows.agg(
        F.count("*"), F.avg("_label"), *[f(column(i)) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    draw = np.random.default_rng(SEED)
    directions = draw.normal(0, 1 / LENGTH_SCALE, (STATISTICS, FEATURES))
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    level = 0.5 if not sizes[0] else sizes[1]
    moments = np.array([x or 0.0 for x in sizes[2:]]).reshape(STATISTICS, 2)
    # Rounding takes out what the order of a sum may change.
    mean, spread = np.round(moments[:, 0], 9), np.maximum(np.round(moments[:, 1], 9), 1e-6)
    model = QualityModel(mean, spread, directions, phases, np.append(np.zeros(FEATURES), level), np.array([0.0, 1.0]), np.array([level] * 2))
    if not sizes[0] or level in (0.0, 1.0):
        return model
    square, right = normal_equations(rows, model)
    penalty = RIDGE * sizes[0] * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(square + penalty, right)
    model = QualityModel(mean, spread, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    low, high = -0.5, 1.5
    found = rows.mapInArrow(_bins(model, low, high), "bin long, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).orderBy("bin").collect()
    centres = low + (np.array([r[0] for r in found]) + 0.5) * (high - low) / BINS
    levels = isotonic(np.array([r[1] for r in found]), np.array([r[2] for r in found]))
    return QualityModel(mean, spread, directions, phases, weights, centres, levels)


def _scorer(model: QualityModel, from_text: bool):
    if from_text:

        @F.arrow_udf(DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0), *map(model.score, _measured(texts))]))

        return score

    @F.arrow_udf(DoubleType())
    def score_statistics(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)))

    return score_statistics


def quality_scores(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of rows ``doc_id, _stats``; fitted on their labels."""
    model = fit_quality(stats, labels)
    scored = stats.withColumn("score", _scorer(model, False)(F.col("_stats")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_column(model: QualityModel, text: Column) -> Column:
    """The score of a text, computed from the text itself."""
    return _scorer(model, True)(text)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; it is fitted on the labels of these rows."""
    (own,) = free(docs, "_id")
    ids = kept(labels.where("doc_id is not null").select(F.col("doc_id").alias(own)).distinct(), "quality-ids")
    marked = docs.join(small(ids, 16), F.col("doc_id") == F.col(own), "left_semi")
    stats = kept(marked.select("doc_id", statistics(F.col("text")).alias("_stats")), "quality-statistics")
    model = fit_quality(stats, labels)
    return docs.where(score_column(model, F.col("text")) >= THRESHOLD)
