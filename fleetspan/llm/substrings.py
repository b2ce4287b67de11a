"""Exact removal of repeated 400-byte strings by bucket refinement over sampled suffixes.

Every 400-byte window names one of its positions by the smallest hash of a 64-byte gram (winnowing), so equal
windows name the same place in themselves.  Neighbouring windows with one named position make a block; its
first bucket is the gram there.  Buckets with one block are done: nothing in it occurs elsewhere.  Blocks
of a bucket with equal bytes repeat as a whole.  What is left, one block per distinct content, is refined:
windows are sorted by the identifier of their first 25 bytes, and buckets that still hold several by the
identifier at offset 25, 50, 100 and 200, each round doubling what an identifier stands for and reusing
those of the round before, until they stand for 400 bytes.

A bucket with very many contents is not gathered: its blocks are cut into shorter runs of windows, whose
common bytes make new, longer first buckets, and the same steps are taken again on these, down to single
windows, whose buckets need no refinement.  Counts are pre-aggregated everywhere; repeated contents are
compared by 128 bits of hash.

Null texts count as empty.  Equal texts lose the same spans.  Ids may be null or repeated.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import kept, small

LENGTH = 400
GRAM = 64
WINDOW = LENGTH - GRAM + 1
FIRST = 25
PIECE = 1 << 19
GATHER_BYTES = 12 << 20
# Buckets with more contents are cut into runs of so many windows.
CONTENTS = 4000
RUNS = (48, 7, 1)

_DRAW = np.random.default_rng(400)
_LETTERS = _DRAW.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_LOW = 21


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


class Hasher:
    """Hashes of all substrings of a byte array, by two sums of letters times powers."""

    def __init__(self, data: np.ndarray, powers: list, inverse: list):
        self.inverse = inverse
        self.sums = []
        for letters, power in zip(_LETTERS, powers):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(letters[data] * power[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def between(self, begin, end, which: int) -> np.ndarray:
        sums = self.sums[which]
        return (sums[end] - sums[begin]) * self.inverse[which][begin]


_TABLES: dict = {}


def hasher(data: np.ndarray) -> Hasher:
    size = _TABLES.get("size", 0)
    if size <= len(data):
        size = 1 << max(20, int(len(data)).bit_length())  # no more than a piece needs: every worker keeps four such tables
        _TABLES["size"] = size
        _TABLES["powers"] = [_powers(b, size) for b in _BASES]
        _TABLES["inverse"] = [_powers(pow(b, -1, 2**64), size) for b in _BASES]
    return Hasher(data, _TABLES["powers"], _TABLES["inverse"])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def blocks_of(data: np.ndarray, piece: np.ndarray):
    """Blocks of concatenated pieces: first window, number of windows, named position, and the hashes.

    ``piece`` is the number of the piece that a byte belongs to; windows do not leave their piece.
    """
    if len(data) < LENGTH:
        return None
    sums = hasher(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _mixed(sums.between(at, at + GRAM, 0))
    mask = np.uint64((1 << _LOW) - 1)
    keys = (grams & ~mask) | (mask - at.astype(np.uint64))  # the rightmost of equals is the smallest
    named = (mask - (_window_minimum(keys, WINDOW) & mask)).astype(np.int64)
    windows = np.arange(len(named))
    whole = piece[windows] == piece[windows + LENGTH - 1]
    fresh = np.append(True, (named[1:] != named[:-1]) | (piece[1 : len(named)] != piece[: len(named) - 1]) | ~whole[:-1]) & whole
    first = np.flatnonzero(fresh)
    if not len(first):
        return None
    edge = np.flatnonzero(~whole)
    after = np.append(first[1:], len(named))
    stop = np.append(edge, len(named))[np.searchsorted(edge, first)]
    count = np.minimum(after, stop) - first
    end = first + count - 1 + LENGTH
    core = grams[named[first]].view(np.int64)
    shape = (named[first] - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64)
    content = [_mixed(sums.between(first, end, w) ^ shape).view(np.int64) for w in (0, 1)]
    return first, count, named[first] - first, core, content


BLOCKS = "text_key binary, ticket long, core long, c1 long, c2 long, start long, windows int, lead int"


def _block_rows(batches):
    names = [part.split()[0] for part in BLOCKS.split(", ")]

    def made(group):
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        sizes = np.array([len(g[2]) for g in group])
        begins = np.cumsum(sizes) - sizes
        found = blocks_of(data, np.repeat(np.arange(len(group)), sizes))
        if found is None:
            return
        first, count, lead, core, content = found
        owner = np.searchsorted(begins, first, side="right") - 1
        start = first - begins[owner] + np.array([g[1] for g in group])[owner]
        key = pa.array([g[0][0] for g in group], pa.binary()).take(pa.array(owner))
        ticket = pa.array(np.array([g[0][1] for g in group], np.int64)[owner])
        yield pa.RecordBatch.from_arrays(
            [key, ticket, *map(pa.array, (core, content[0], content[1], start)), pa.array(count, pa.int32()), pa.array(lead, pa.int32())], names=names)

    for batch in batches:
        group, size = [], 0
        for key, ticket, text in zip(*(batch.column(n) for n in ("text_key", "ticket", "text"))):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for begin in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
                part = data[begin : begin + PIECE + LENGTH - 1]
                if size + len(part) > PIECE + LENGTH and group:
                    yield from made(group)
                    group, size = [], 0
                group.append(((key.as_py(), ticket.as_py()), begin, part))
                size += len(part)
        if group:
            yield from made(group)


# Blocks with their bytes

BYTES = "core long, flag boolean, text_key binary, start long, windows int, lead int, data binary"


def _cut_out(batches):
    names = [part.split()[0] for part in BYTES.split(", ")]
    for batch in batches:
        for key, text, blocks in zip(*(batch.column(n) for n in ("text_key", "text", "_blocks"))):
            data = text.as_py().encode("utf-8", "surrogatepass")
            rows = blocks.as_py()
            cut = [data[b["start"] : b["start"] + b["windows"] - 1 + LENGTH] for b in rows]
            columns = [[b["core"] for b in rows], [b["flag"] for b in rows], [key.as_py()] * len(rows), *([b[c] for b in rows] for c in ("start", "windows", "lead")), cut]
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def repeated_windows(data: np.ndarray, begins: np.ndarray, windows: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For each window of the blocks whether its 400 bytes are found in another window or in a flagged block."""
    at = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    flag = np.repeat(flags, windows)
    names = [letters[data] for letters in _LETTERS]  # identifiers of one byte, for the whole array
    length, repeated = 1, np.zeros(len(at), bool)
    alive = np.arange(len(at))
    for step in (1, 2, 4, 8, 9, FIRST, 2 * FIRST, 4 * FIRST, 8 * FIRST):
        for which, base in enumerate(_BASES):
            power = np.uint64(pow(base, length, 2**64) | 1)
            names[which] = _mixed(names[which][:-step] * power + names[which][step:] + np.uint64(length))
        length += step
        if length < FIRST:
            continue
        # Buckets of windows with equal identifiers; those with one window are done.
        ids = names[0][at[alive]]
        order = np.argsort(ids, kind="stable") if length < LENGTH else np.lexsort((names[1][at[alive]], ids))
        ids = ids[order]
        change = ids[1:] != ids[:-1]
        if length == LENGTH:
            second = names[1][at[alive]][order]
            change |= second[1:] != second[:-1]
        edge = np.flatnonzero(np.append(True, change)) if len(ids) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(ids)))
        several = np.repeat(size > 1, size)
        alive = np.sort(alive[order[several]]) if length < LENGTH else alive[order[several]]
    repeated[alive] = True
    return repeated & ~flag


SPANS = "text_key binary, start long, stop long"


def _spans(keys: list, starts: np.ndarray, windows: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """Removed bytes for runs of repeated windows within blocks."""
    block = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
    hits = np.flatnonzero(repeated)
    new = np.append(True, (np.diff(hits) != 1) | (block[hits[1:]] != block[hits[:-1]])) if len(hits) else np.zeros(0, bool)
    first = hits[new]
    last = hits[np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)] if len(hits) else hits
    owner = block[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()).take(pa.array(owner)), pa.array(starts[owner] + place[first]), pa.array(starts[owner] + place[last] + LENGTH)],
        names=["text_key", "start", "stop"])


def _refine(batches):
    """Blocks sorted by bucket; some whole buckets are refined at a time."""

    def flushed(rows):
        seen, unique = set(), []
        for row in rows:  # rows that are equal in all columns come from one text
            if (row[2], row[3]) not in seen:
                seen.add((row[2], row[3]))
                unique.append(row)
        data = np.frombuffer(b"".join(r[5] for r in unique), np.uint8)
        sizes = np.array([len(r[5]) for r in unique])
        windows = np.array([r[4] for r in unique])
        repeated = repeated_windows(data, np.cumsum(sizes) - sizes, windows, np.array([r[1] for r in unique]))
        return _spans([r[2] for r in unique], np.array([r[3] for r in unique]), windows, repeated)

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("core", "flag", "text_key", "start", "windows", "data"))):
            if size > GATHER_BYTES and rows[-1][0] != row[0]:
                yield flushed(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        yield flushed(rows)


def _cut_runs(run: int):
    """Cut blocks into runs of ``run`` windows, aligned to the named position, with new first buckets."""
    names = [part.split()[0] for part in f"{BYTES}, c1 long, c2 long".split(", ")]
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def cut(batches):
        import xxhash

        for batch in batches:
            rows = []
            for flag, key, start, windows, lead, data in zip(*(batch.column(n).to_pylist() for n in ("flag", "text_key", "start", "windows", "lead", "data"))):
                for part in range((lead - windows + 1) // run, lead // run + 1):
                    low, high = max(0, lead - part * run - run + 1), min(windows - 1, lead - part * run)
                    common = data[lead - part * run : lead - part * run - run + 1 + LENGTH]
                    content = data[low : high + LENGTH]
                    shape = f"{part},{lead - low},{high - low}".encode()
                    digest = xxhash.xxh3_128_digest(content + shape)
                    rows.append((int.from_bytes(xxhash.xxh3_64_digest(common + str(part).encode()), "big", signed=True), flag, key, start + low, high - low + 1, lead - low, content,
                                 int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return cut


def _crowded(blocks: DataFrame) -> DataFrame:
    """Blocks of buckets with too many contents to gather, all of them already distinct."""
    crowded = kept(blocks.groupBy("core").count().where(F.col("count") > CONTENTS).select("core"), "substring-crowded")
    return small(crowded, 16)


def _resolved(blocks: DataFrame) -> list:
    """Spans of repeated windows among distinct contents: tables ``text_key, start, stop``."""
    spans = []
    for run in (*RUNS, None):
        crowded = _crowded(blocks)
        gathered = blocks.join(crowded, "core", "left_anti")
        count = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = gathered.repartition(count, "core").sortWithinPartitions("core", "text_key", "start")
        spans.append(ordered.mapInArrow(_refine, SPANS))
        held = blocks.join(crowded, "core", "left_semi")
        if run is None or crowded.isEmpty():
            break
        cut = kept(held.mapInArrow(_cut_runs(run), f"{BYTES}, c1 long, c2 long"), "substring-runs")
        keys = ["core", "c1", "c2"]
        contents = cut.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("flag").alias("_flag"), F.min(F.struct("text_key", "start")).alias("_first"))
        contents = kept(contents, "substring-contents")
        again = contents.where("_n > 1 or _flag").select(*keys)
        # Whole runs that repeat; what witnesses them is not theirs alone.
        spans.append(cut.where("not flag").join(again, keys, "left_semi").select("text_key", "start", (F.col("start") + F.col("windows") - 1 + LENGTH).alias("stop")))
        mixed = contents.groupBy("core").agg(F.count("*").alias("_contents")).where("_contents > 1").select("core")
        open_ = contents.join(mixed, "core", "left_semi").select(*keys, ((F.col("_n") > 1) | F.col("_flag")).alias("_again"), "_first")
        blocks = cut.join(open_, keys).where((F.col("text_key") == F.col("_first.text_key")) & (F.col("start") == F.col("_first.start")))
        blocks = blocks.dropDuplicates([*keys]).select("core", F.col("_again").alias("flag"), "text_key", "start", "windows", "lead", "data")
        blocks = kept(blocks, "substring-blocks")
    return spans


def text_key(text: Column) -> Column:
    return F.unhex(F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(32)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``text_key, spans``: the bytes to remove from every text that has some, as sorted disjoint ranges."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(text_key(F.col("text")).alias("text_key"), F.xxhash64(F.lit(1), *others).alias("ticket"), "text")
    long_ones = rows.where(F.octet_length("text") >= LENGTH)
    blocks = kept(long_ones.mapInArrow(_block_rows, BLOCKS), "substring-sampled")
    buckets = blocks.groupBy("core").agg(F.count("*").alias("_n"), F.min("c1").alias("_a"), F.max("c1").alias("_b")).where("_n > 1")
    buckets = kept(buckets.select("core", (F.col("_a") != F.col("_b")).alias("mixed")), "substring-buckets")
    several = blocks.join(small(buckets, 24), "core")
    keys = ["core", "c1", "c2"]
    first = F.min(F.struct("text_key", "ticket", "start", "windows", "lead")).alias("_first")
    contents = kept(several.groupBy(*keys, "mixed").agg(F.count("*").alias("_n"), first), "substring-contents")
    again = kept(contents.where("_n > 1").select(*keys), "substring-again")
    whole = blocks.join(small(again, 40), keys).select("text_key", "start", (F.col("start") + F.col("windows") - 1 + LENGTH).alias("stop"))
    per_text = contents.where("mixed").select(F.col("_first.text_key").alias("_key"), F.col("_first.ticket").alias("_ticket"), F.struct(
        "core", F.col("_first.start").alias("start"), F.col("_first.windows").alias("windows"), F.col("_first.lead").alias("lead"), (F.col("_n") > 1).alias("flag")).alias("_block"))
    per_text = kept(per_text.groupBy("_key", "_ticket").agg(F.collect_list("_block").alias("_blocks")), "substring-mixed")
    width = per_text.agg(F.avg(F.size("_blocks"))).first()[0] or 0
    met = long_ones.join(small(per_text, int(64 + 40 * width)), (F.col("text_key") == F.col("_key")) & (F.col("ticket") == F.col("_ticket")))
    open_blocks = kept(met.select("text_key", "text", "_blocks").mapInArrow(_cut_out, BYTES), "substring-bytes")
    spans = whole
    for part in _resolved(open_blocks):
        spans = spans.unionByName(part)
    listed = spans.distinct().groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_parts"))
    return kept(listed.mapInArrow(_joined, "text_key binary, spans array<struct<start:bigint,stop:bigint>>"), "substring-spans")


def _joined(batches):
    """Overlapping and touching ranges made one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        made = []
        for parts in batch.column("_parts").to_pylist():
            runs: list = []
            for part in parts:
                if runs and part["start"] <= runs[-1]["stop"]:
                    runs[-1]["stop"] = max(runs[-1]["stop"], part["stop"])
                else:
                    runs.append(dict(part))
            made.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(made, kind)], names=["text_key", "spans"])


def _keep(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            parts, at = [], 0
            for span in spans.as_py() or []:
                parts.append(data[at : span["start"]])
                at = span["stop"]
            out.append((len(data), spans.as_py() or [], b"".join(parts) + data[at:]))
        sizes, spans, rest = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_bytes, spans`` (removed byte ranges) and ``kept``, the bytes that are left."""
    spans = repeated_spans(docs)
    width = spans.agg(F.avg(F.size("spans"))).first()[0] or 0
    found = spans.withColumnRenamed("text_key", "_key")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("_text"))
    joined = rows.join(small(found, int(64 + 24 * width)), F.col("_text") == F.col("_key"), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_keep, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
