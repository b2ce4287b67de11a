"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Tokens are words (A-Z in lower case) and one end per text; a begin serves as context only.  Map tasks count
tokens and neighbouring pairs by sorted arrays and send them compressed to shards; a shard adds them up and
stores sorted arrays in the shared folder.  A token's id is its place in the sorted hashes of all tokens, a
pair is stored as two ids in one number, so up to 2^32 distinct tokens are told apart.  Pairs are dealt by
their first token, and those of frequent first tokens by both, so no token's pairs must fit one task.
Nothing but one row of sums per shard comes to the driver.

Scoring maps the arrays into memory, looks sorted queries up, and adds log10 probabilities of every token.
Files are written under names of the attempt and renamed, with equal content for every attempt.

A null text is empty: it has its end as only token.  Rows with null ids are held out.  Without training
text every token has probability 1.  Repeated rows count and score as often as they occur.
"""

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import kept, new_folder

CHUNK_TOKENS = 1_000_000
FLUSH_PAIRS = 6_000_000
END = b"\n"  # no word holds white space
TOP = 16


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


# Arrays: packed for the way between tasks, files in the shared folder.


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which sorted numbers compress well."""
    raw = np.ascontiguousarray(values)
    return zstandard.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), 1) if len(raw) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _local(folder: str) -> str | None:
    """The path of a folder that the machine itself sees."""
    path = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
    return None if "://" in path else path


def store(folder: str, name: str, values: np.ndarray) -> None:
    from pyarrow.fs import FileSystem

    system, root = FileSystem.from_uri(f"file://{_local(folder)}" if _local(folder) else folder)
    system.create_dir(root, recursive=True)
    draft = f"{root}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(draft, f"{root}/{name}")


def mapped(folder: str, name: str, kind) -> np.ndarray:
    """A stored array: mapped from a mounted folder, read from any other file system."""
    if _local(folder):
        path = os.path.join(_local(folder), name)
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow.fs import FileSystem

    system, root = FileSystem.from_uri(folder)
    with system.open_input_file(f"{root}/{name}") as file:
        return np.frombuffer(file.read(), kind)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


# Tokens


def hashes_of(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def chunks_of(batches, size: int = CHUNK_TOKENS):
    """Groups of rows as ``(batch, first row, hashes of distinct tokens, codes, ends)``; a text ends with END."""
    for batch in batches:
        texts, at = batch.column("text"), 0
        while at < len(batch):
            words, ends, begin = [], [], at
            while at < len(batch) and (len(words) < size or at == begin):
                words += (texts[at].as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                ends.append(len(words))
                at += 1
            coded = pa.array(words, pa.binary()).dictionary_encode()
            yield batch, begin, hashes_of(coded.dictionary), coded.indices.to_numpy(), np.array(ends)


@dataclass
class Layout:
    """Where the arrays are, and what the driver knows of them."""

    folder: str
    shards: int
    starts: np.ndarray | None = None  # first id of every token shard, and their number in the end
    tokens: int = 0
    vocabulary: int = 0
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    discounts: tuple = ()
    low_discounts: tuple = ()
    continuations: int = 0
    low_rest: float = 1.0
    opened: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def array(self, name: str, kind) -> np.ndarray:
        if name not in self.opened:
            self.opened[name] = mapped(self.folder, name, kind)
        return self.opened[name]

    def token_shard(self, hashes: np.ndarray) -> np.ndarray:
        """Shards are equal ranges of hashes, so ids in shard order are in hash order."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def pair_shard(self, pairs: np.ndarray) -> np.ndarray:
        first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        odd = np.uint64(0x9E3779B97F4A7C15)
        spread = np.where(np.isin(first, self.frequent), second * odd, np.uint64(0))
        mixed = (first * odd + spread) >> np.uint64(32)
        return (mixed * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for tokens that training did not have."""
        found = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        shards = self.token_shard(hashes[order])
        for shard, at in _runs(shards):
            known = self.array(f"hash-{shard}", np.uint64)
            wanted = hashes[order[at]]
            place = np.searchsorted(known, wanted)
            inside = place < len(known)
            hit = inside.copy()
            hit[inside] = known[place[inside]] == wanted[inside]
            found[order[at][hit]] = place[hit] + self.starts[shard]
        return found

    def of_tokens(self, name: str, kind, ids: np.ndarray) -> np.ndarray:
        """Values stored per token, 0 for unknown ones."""
        values = np.zeros(len(ids), kind)
        order = np.argsort(ids, kind="stable")
        order = order[np.searchsorted(ids[order], 0) :]
        shards = np.minimum(np.searchsorted(self.starts, ids[order], side="right") - 1, self.shards - 1)
        for shard, at in _runs(shards):
            values[order[at]] = self.array(f"{name}-{shard}", kind)[ids[order[at]] - self.starts[shard]]
        return values

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(pairs), np.int64)
        shards = self.pair_shard(pairs)
        order = np.lexsort((pairs, shards))
        for shard, at in _runs(shards[order]):
            known = self.array(f"pair-{shard}", np.uint64)
            wanted = pairs[order[at]]
            place = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
            if len(known):
                hit = known[place] == wanted
                counts[order[at][hit]] = self.array(f"paircount-{shard}", np.uint32)[place[hit]]
        return counts


def _runs(values: np.ndarray):
    """Runs of equal values in a sorted array as ``(value, slice)``."""
    if len(values):
        edges = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        for begin, end in zip(edges, np.append(edges[1:], len(values))):
            yield int(values[begin]), slice(int(begin), int(end))


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray):
    """Record batches with one packed row per shard."""
    order = np.lexsort((keys, shards))
    rows = [(shard, pack(keys[order[at]]), pack(counts[order[at]])) for shard, at in _runs(shards[order])]
    for row in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary())], names=["shard", "keys", "counts"])


BLOB = "shard int, keys binary, counts binary"


def _token_counts(layout: Layout):
    def run(batches):
        keys, counts, size = [], [], 0
        for _, _, hashes, codes, _ in chunks_of(batches):
            keys.append(hashes)
            counts.append(np.bincount(codes, minlength=len(hashes)).astype(np.uint64))
            size += len(hashes)
            if size > FLUSH_PAIRS:
                keys, counts = map(lambda x: [x], summed(np.concatenate(keys), np.concatenate(counts)))
                if len(keys[0]) > FLUSH_PAIRS // 2:
                    yield from _blobs(keys[0], counts[0], layout.token_shard(keys[0]))
                    keys, counts = [], []
                size = sum(map(len, keys))
        if keys:
            total, sums = summed(np.concatenate(keys), np.concatenate(counts))
            yield from _blobs(total, sums, layout.token_shard(total))

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack(x.as_py(), np.uint64) for x in table.column("keys")])
    counts = np.concatenate([unpack(x.as_py(), np.uint64) for x in table.column("counts")])
    return summed(keys, counts)


def _token_shard(layout: Layout):
    def run(key, table):
        shard = key[0].as_py()
        hashes, counts = _merged(table)
        store(layout.folder, f"hash-{shard}", hashes)
        store(layout.folder, f"count-{shard}", counts)
        top = np.argsort(counts)[::-1][:TOP]
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(hashes)], "total": [int(counts.sum())],
                         "places": [top.tolist()], "counts": [counts[top].astype(np.int64).tolist()]})

    return run


def _pair_counts(layout: Layout):
    def run(batches):
        parts, size = [], 0

        def flushed():
            pairs, counts = summed(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
            yield from _blobs(pairs, counts, layout.pair_shard(pairs))

        for _, _, hashes, codes, ends in chunks_of(batches):
            second = layout.ids(hashes)[codes]
            first = np.append(layout.vocabulary, second[:-1])
            first[ends[:-1]] = layout.vocabulary
            pairs = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
            parts.append(summed(pairs, np.ones(len(pairs), np.uint64)))
            size += len(parts[-1][0])
            if size > FLUSH_PAIRS:
                yield from flushed()
                parts, size = [], 0
        if parts:
            yield from flushed()

    return run


SUMS = "n1 long, n2 long, n3 long, n4 long"
STATS = f"shard int, ids binary, n_one binary, n_two binary, n_more binary, before binary, {SUMS}"


def _pair_shard(layout: Layout):
    """Store a shard of pairs; send what it knows of its tokens to the shards of the tokens."""

    def run(key, table):
        shard = key[0].as_py()
        pairs, counts = _merged(table)
        store(layout.folder, f"pair-{shard}", pairs)
        store(layout.folder, f"paircount-{shard}", np.minimum(counts, 2**32 - 1).astype(np.uint32))
        first, second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids = np.concatenate([first, second])
        zero = np.zeros(len(pairs), np.uint32)
        marks = [np.concatenate([(counts == 1).astype(np.uint32), zero]), np.concatenate([(counts == 2).astype(np.uint32), zero]),
                 np.concatenate([(counts > 2).astype(np.uint32), zero]), np.concatenate([zero, zero + 1])]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sums = [np.add.reduceat(m[order], begin).astype(np.uint32) for m in marks]
        ids = ids[begin]
        to = np.minimum(np.searchsorted(layout.starts, ids, side="right") - 1, layout.shards - 1)
        rows = [[s, pack(ids[at]), *(pack(m[at]) for m in sums)] for s, at in _runs(to)]
        seen = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        columns = [list(c) for c in zip(*rows)]
        extra = [[n] + [0] * (len(rows) - 1) for n in seen]
        names = [part.split()[0] for part in STATS.split(", ")]
        return pa.table(dict(zip(names, [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:]), *(pa.array(e, pa.int64()) for e in extra)])))

    return run


def _stats_shard(layout: Layout):
    def run(key, table):
        shard = key[0].as_py()
        begin = int(layout.starts[shard])
        size = int(layout.starts[shard + 1]) - begin + (shard == layout.shards - 1)  # the begin has the last id
        arrays = {}
        for name in ("n_one", "n_two", "n_more", "before"):
            arrays[name] = np.zeros(size, np.int64)
            for ids, values in zip(table.column("ids"), table.column(name)):
                arrays[name][unpack(ids.as_py(), np.int64) - begin] += unpack(values.as_py(), np.uint32)
            store(layout.folder, f"{name}-{shard}", arrays[name].astype(np.uint32))
        before = arrays["before"]
        found = [int((before == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"total": [int(before.sum())], "distinct": [int((before > 0).sum())], **{f"n{k}": [found[k - 1]] for k in (1, 2, 3, 4)}})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple:
    """Discounts for counts 1, 2 and more; half a count where a corpus is too small to tell."""
    if not (n1 and n2 and n3 and n4):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), most) for d, most in zip(found, (0.95, 1.95, 2.95)))


def _discounted(counts: np.ndarray, given: tuple) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *given])[np.minimum(counts, 3)], 0.0)


def fit(docs: DataFrame) -> Layout:
    """Count the texts of ``docs`` (``text``) and store the model in a fresh folder of the shared one."""
    spark = docs.sparkSession
    texts = docs.select("text")
    layout = Layout(new_folder(spark, "kneser-ney"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "shard int, size long, total long, places array<long>, counts array<long>"
    tokens = kept(texts.mapInArrow(_token_counts(layout), BLOB).groupBy("shard").applyInArrow(_token_shard(layout), schema), "kn-tokens").collect()
    sizes = np.zeros(layout.shards, np.int64)
    for row in tokens:
        sizes[row["shard"]] = row["size"]
    layout.starts = np.append(0, np.cumsum(sizes))
    layout.vocabulary, layout.tokens = int(sizes.sum()), sum(row["total"] for row in tokens)
    if not tokens:
        return layout
    if layout.vocabulary >= 2**32 - 1:
        raise ValueError("more than 2^32 distinct tokens")
    often = [layout.starts[r["shard"]] + p for r in tokens for p, c in zip(r["places"], r["counts"]) if c * 2 * layout.shards > layout.tokens]
    layout.frequent = np.array(sorted([*often, layout.vocabulary]), np.uint64)
    pairs = texts.mapInArrow(_pair_counts(layout), BLOB).groupBy("shard").applyInArrow(_pair_shard(layout), STATS)
    pairs = kept(pairs, "kn-pairs")
    layout.discounts = discounts(*pairs.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first())
    low = kept(pairs.groupBy("shard").applyInArrow(_stats_shard(layout), f"total long, distinct long, {SUMS}"), "kn-stats")
    total, distinct, *seen = low.agg(*[F.sum(c) for c in ("total", "distinct", "n1", "n2", "n3", "n4")]).first()
    layout.low_discounts, layout.continuations = discounts(*seen), total
    d1, d2, d3 = layout.low_discounts
    layout.low_rest = (d1 * seen[0] + d2 * seen[1] + d3 * (distinct - seen[0] - seen[1])) / total
    return layout


def token_scores(layout: Layout, hashes: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple:
    """Per token: known or not, log10 of the add-one unigram, and of the model."""
    n, v = layout.tokens, layout.vocabulary
    if v == 0:
        zero = np.zeros(len(codes))
        return zero.astype(bool), zero, zero
    of_word = layout.ids(hashes)
    counts = layout.of_tokens("count", np.uint64, of_word).astype(np.float64)
    before = layout.of_tokens("before", np.uint32, of_word).astype(np.int64)
    low = _discounted(before, layout.low_discounts) / layout.continuations + layout.low_rest / (v + 1)
    known = np.array([layout.of_tokens(name, np.uint32, of_word) for name in ("n_one", "n_two", "n_more")], np.float64)
    d = np.array(layout.discounts)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(counts > 0, d @ known / counts, 1.0)
    begin = np.array([v])
    at_begin = np.array([layout.of_tokens(name, np.uint32, begin)[0] for name in ("n_one", "n_two", "n_more")], np.float64)
    texts = float(counts_of_begin(layout))
    first = np.append(0, codes[:-1])
    starts = np.append(0, ends[:-1])
    is_start = np.zeros(len(codes), bool)
    is_start[starts] = True
    context = np.where(is_start, v, of_word[first])
    weight = np.where(is_start, d @ at_begin / texts, rest[first])
    size = np.where(is_start, texts, counts[first])
    second = of_word[codes]
    both = (context >= 0) & (second >= 0)
    pairs = context[both].astype(np.uint64) << np.uint64(32) | second[both].astype(np.uint64)
    high = np.zeros(len(codes))
    high[both] = _discounted(layout.pair_counts(pairs), layout.discounts) / size[both]
    base = np.log10((counts + 1) / (n + (v + 1)))
    return of_word[codes] >= 0, base[codes], np.log10(high + weight * low[codes])


def counts_of_begin(layout: Layout) -> int:
    """How many texts training had: every text has one end."""
    if "texts" not in layout.opened:
        end = layout.ids(np.array([xxhash.xxh64_intdigest(END)], np.uint64))
        layout.opened["texts"] = int(layout.of_tokens("count", np.uint64, end)[0])
    return layout.opened["texts"]


def _scores(layout: Layout):
    def run(batches):
        for batch, begin, hashes, codes, ends in chunks_of(batches):
            known, base, model = token_scores(layout, hashes, codes, ends)
            starts = np.append(0, ends[:-1])
            rows = batch.slice(begin, len(ends))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(ends - starts), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                 pa.array(np.full(len(ends), layout.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, layout: Layout) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        _scores(layout), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, score all."""
    return score(docs, fit(docs.where(~held_out(F.col("doc_id")))))
