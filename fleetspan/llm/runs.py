"""Periodic runs of words, found in tiles per octave of periods and stitched by document and period.

A run is a stretch of words with smallest period ``q`` and length of at least ``max(6, 4 q)`` that no neighbour
extends.  Words ``q`` apart are equal over a stretch of at least ``3 q`` places; this stretch is what is looked for.

1.  Texts become numbers, one per different word.  For every octave of periods ``B`` to ``2 B - 1`` the places at
    multiples of ``B`` are boundaries.  A run of that octave holds two neighbouring boundaries whose blocks of ``B``
    words come again ``q`` words later.  Hashes of blocks, doubled from octave to octave, leave out boundaries where
    this can't be; equal blocks have equal hashes, so none is lost.  The rest is exploded into overlapping tiles.
2.  Tiles are dealt over all tasks and solved by themselves.  At each boundary two Z-functions tell, for all periods
    of the octave at once, how far equality reaches forward and back.  Periods that are multiples of a shorter one
    at a boundary are so in the whole run; they are left to the shorter one.
3.  Fragments are shuffled by document and period and joined where they touch.

A document of n words takes O(n log n) steps, whatever it repeats.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetspan.llm.common import kept

# Bytes of text that are numbered at a time; a longer text is taken by itself.
SLICE_BYTES = 2 << 20
# Words between the first and the last boundary of a tile, where blocks are shorter than that.
TILE_WORDS = 4096
MIN_LENGTH, MIN_PERIODS = 6, 4

RUN = "start long, length long, period long"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Numbers of all words in a row, where each text ends in it, and the words."""
    split = [text.split() for text in texts]
    ends = np.cumsum([len(words) for words in split], dtype=np.int64)
    flat = pa.array([word for words in split for word in words], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
    return codes.astype(np.int32), ends, split


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    return (x ^ (x >> np.uint64(29))) * MIX[1]


def _candidates(hashes: np.ndarray, bounds: np.ndarray, stop: np.ndarray, block: int) -> np.ndarray:
    """Boundaries at which two neighbouring blocks may come again at one distance of the octave."""
    found = np.zeros(len(bounds), bool)
    step = max(2, (1 << 20) // block)
    for at in range(0, len(bounds), step - 1):
        part = bounds[at : at + step]
        places = part[:, None] + np.arange(block, 2 * block)[None, :]
        inside = places + block <= stop[at : at + step, None]
        same = inside & (hashes[np.minimum(places, len(hashes) - 1)] == hashes[part][:, None])
        both = same[1:] & same[:-1] & (np.diff(part) == block)[:, None]
        hit = both.any(axis=1)
        found[at : at + len(part) - 1] |= hit
        found[at + 1 : at + len(part)] |= hit
    return bounds[found]


def tiles(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``(text, block, first place, words, boundaries)`` for all octaves, as far as a run may be there.

    Places and boundaries count from the text's first word; words reach from one block before the first boundary
    to four blocks after the last.
    """
    if not len(codes):
        return
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    hashes = _mixed(codes.astype(np.uint64) + MIX[2])
    block = 1
    while 4 * block <= lengths.max():
        texts = np.flatnonzero((lengths >= MIN_PERIODS * block) & (lengths >= MIN_LENGTH))
        counts = lengths[texts] // block
        text_of = np.repeat(texts, counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        bounds = starts[text_of] + within * block
        chosen = _candidates(hashes, bounds, ends[text_of], block)
        if len(chosen):
            owner = np.searchsorted(ends, chosen, side="right")
            local = chosen - starts[owner]
            cut = local // max(block, TILE_WORDS)
            changes = np.flatnonzero((np.diff(owner) != 0) | (np.diff(cut) != 0)) + 1
            for group in np.split(np.arange(len(chosen)), changes):
                text, first, last = owner[group[0]], local[group[0]], local[group[-1]]
                low, high = max(0, first - block), min(lengths[text], last + 4 * block)
                words = codes[starts[text] + low : starts[text] + high]
                yield int(text), block, int(low), words, local[group]
        # A block of twice the size is two blocks; one that would leave the array is never compared.
        after = np.concatenate([hashes[block:], np.zeros(min(block, len(hashes)), np.uint64)])
        hashes = _mixed(hashes * MIX[2] + after)
        block *= 2


def z_function(word: list) -> list[int]:
    """For each place, how many items from there on equal those from the start."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_parts(number: int) -> list[int]:
    """``number`` divided by each of its prime factors."""
    parts, rest, p = [], number, 2
    while p * p <= rest:
        if rest % p == 0:
            parts.append(number // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return parts + [number // rest] if rest > 1 else parts


def solve_tile(words: np.ndarray, bounds: np.ndarray, block: int) -> dict[int, list[list[int]]]:
    """Stretches of places whose word comes again ``q`` places later, by primitive period ``q`` of the octave.

    ``bounds`` and places count from the tile's first word.  A stretch reaches at most one block before a boundary
    and two behind it; longer ones are joined from their boundaries.
    """
    found: dict[int, list[list[int]]] = {}
    items = words.tolist()
    for b in bounds.tolist():
        forward = z_function(items[b : b + 4 * block])
        periods = [q for q in range(block, min(2 * block, len(forward))) if forward[q] >= block]
        if not periods:
            continue
        before = items[max(0, b - block) : b][::-1]
        behind = items[max(0, b - block) : b + 2 * block - 1][::-1]
        back = z_function([*before, None, *behind])
        for q in periods:
            ahead = min(forward[q], 2 * block)
            # The place before b + q, counted from the end of what lies behind.
            at = len(before) + 1 + (len(behind) - (len(before) + q))
            past = back[at] if before else 0
            if ahead < 2 * block and past < block:
                continue
            if any(forward[r] >= q - r for r in _prime_parts(q)):
                continue
            spans = found.setdefault(q, [])
            if spans and b - past <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b + ahead)
            else:
                spans.append([b - past, b + ahead])
    return found


def _exploded(keep: list[T.StructField], kind: pa.Schema) -> Callable:
    """Texts to document rows and tile rows in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(batch):
                stop, size = at + 1, int(sizes[at])
                while stop < len(batch) and size + sizes[stop] <= SLICE_BYTES:
                    size += int(sizes[stop])
                    stop += 1
                yield from slice_rows(batch.slice(at, stop - at))
                at = stop

    def slice_rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [text or b"" for text in part.column("_text").cast(pa.binary()).to_pylist()]
        codes, ends, split = word_numbers(texts)
        made = list(tiles(codes, ends))
        repeating = {tile[0] for tile in made}
        own = [part.column(field.name) for field in keep]
        rows = part.column("_row")
        counts = np.diff(ends, prepend=0)
        joined = [None if i in repeating else b" ".join(words).decode("utf-8", "replace") for i, words in enumerate(split)]
        n = len(texts)
        text = part.column("_text").take(pa.array([i if i in repeating else None for i in range(n)], pa.int64()))
        nothing = [pa.nulls(n, kind.field(name).type) for name in ("_block", "_first", "_words", "_bounds")]
        yield pa.RecordBatch.from_arrays(
            [*own, rows, pa.array(counts), pa.array(joined, pa.string()), text, *nothing], schema=kind)
        for start in range(0, len(made), 256):
            group = made[start : start + 256]
            n = len(group)
            nothing = [pa.nulls(n, kind.field(field.name).type) for field in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    *nothing,
                    rows.take(pa.array([tile[0] for tile in group])),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.string()),
                    pa.nulls(n, pa.string()),
                    pa.array([tile[1] for tile in group], pa.int64()),
                    pa.array([tile[2] for tile in group], pa.int64()),
                    pa.array([tile[3].astype("<i4").tobytes() for tile in group], pa.binary()),
                    pa.array([(tile[4] - tile[2]).astype("<i8").tobytes() for tile in group], pa.binary()),
                ],
                schema=kind,
            )

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, periods, lows, highs = [], [], [], []
        for tile in batch.to_pylist():
            words, bounds = np.frombuffer(tile["_words"], "<i4"), np.frombuffer(tile["_bounds"], "<i8")
            for q, spans in solve_tile(words, bounds, tile["_block"]).items():
                for low, high in spans:
                    rows.append(tile["_row"])
                    periods.append(q)
                    lows.append(tile["_first"] + low)
                    highs.append(tile["_first"] + high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (rows, periods, lows, highs)], names=["_row", "period", "_low", "_high"])


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs ``_row, start, length, period`` from the fragments of all tiles; what touches is one stretch."""
    order = Window.partitionBy("_row", "period").orderBy("_low", "_high")
    earlier = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(earlier.isNull() | (F.col("_low") > earlier), 1).otherwise(0)
    piece = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = (
        fragments.withColumn("_opens", opens)
        .withColumn("_piece", piece)
        .groupBy("_row", "period", "_piece")
        .agg(F.min("_low").alias("start"), (F.max("_high") - F.min("_low") + F.col("period")).alias("length"))
    )
    return joined.where(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), MIN_PERIODS * F.col("period"))).drop("_piece")


@F.pandas_udf(T.StringType())
def _collapse(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """Words of a text without those that a run holds after its first period."""
    made = []
    for text, found in zip(texts, runs):
        words = text.encode("utf-8").split()
        change = np.zeros(len(words) + 1, np.int64)
        for run in found:
            change[run["start"] + run["period"]] += 1
            change[run["start"] + run["length"]] -= 1
        stays = np.cumsum(change[:-1]) == 0
        made.append(b" ".join(words[i] for i in np.flatnonzero(stays)).decode("utf-8"))
    return pd.Series(made, index=texts.index)


def periodic_runs(docs: DataFrame, text: str = "text", keep=("doc_id",), collapsed: str = "text") -> DataFrame:
    """``keep``, ``n_words``, ``runs`` and ``collapsed`` of every row.

    ``runs`` holds ``start, length, period`` of every run by start, then period.  ``collapsed`` are the words outside
    of what runs repeat, joined by one space; ``collapsed="sha256"`` gives its digest instead, which keeps texts
    without runs out of the stored table.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Rows stand for themselves, whatever
    their id: repeated rows and null ids each give a row.  Ties don't arise, since a stretch has one smallest period.
    A very long text is numbered in one task, as its row is read there, but its tiles are solved in many.  Columns
    not in ``keep`` are left out; ``keep`` can't name one of the three answers.
    """
    clash = {"n_words", "runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep clash with the answers: {sorted(clash)}")
    if collapsed not in ("text", "sha256"):
        raise ValueError(f"unknown form of collapsed texts {collapsed!r}")
    own = [T.StructField(f"_keep_{i}", docs.schema[name].dataType) for i, name in enumerate(keep)]
    rows = docs.select(
        *[F.col(name).alias(field.name) for name, field in zip(keep, own)], F.monotonically_increasing_id().alias("_row"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*own]).add("_row", "long").add("n_words", "long").add("_joined", "string").add("_text", "string")
    schema = schema.add("_block", "long").add("_first", "long").add("_words", "binary").add("_bounds", "binary")
    exploded = rows.mapInArrow(_exploded(own, to_arrow_schema(schema)), schema)
    form = (lambda column: F.sha2(column, 256)) if collapsed == "sha256" else (lambda column: column)
    # Written once: row numbers and tiles stay the same in whatever is computed from them later.
    stored = kept(exploded.withColumn("_joined", form(F.col("_joined"))), "runs-tiles")
    dealt = stored.where("_block is not null").select("_row", "_block", "_first", "_words", "_bounds")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, "_row", "_block", "_first")
    fragments = dealt.mapInArrow(_solved, "_row long, period long, _low long, _high long")
    runs = stitched(fragments).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    names = [F.col(field.name).alias(name) for name, field in zip(keep, own)]
    whole = stored.where("_block is null")
    plain = whole.where("_text is null").select(
        *names, "n_words", F.array().cast(f"array<struct<{RUN.replace(' ', ':')}>>".replace(",:", ",")).alias("runs"), F.col("_joined").alias("collapsed"))
    ordered = F.transform(F.col("_runs"), lambda run: F.struct(run["start"].alias("start"), run["length"].alias("length"), run["period"].alias("period")))
    some = whole.where("_text is not null").join(runs, "_row", "left").withColumn(
        "_runs", F.coalesce(ordered, F.array().cast(f"array<struct<{RUN.replace(' ', ':')}>>".replace(",:", ","))))
    repeating = some.select(*names, "n_words", F.col("_runs").alias("runs"), form(_collapse("_text", "_runs")).alias("collapsed"))
    return plain.unionByName(repeating)


def with_planted_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every tenth text, by the checksum of its id, made periodic from some word on.

    Of ``n`` words those from ``a = g % n`` on repeat with period ``1 + (n - a) // (3 + g % 8)``, where ``g`` is the
    checksum divided by ten.  Null ids have no checksum, and texts without words stay as they are.
    """
    check = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(check / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("_w")
    a = F.pmod(g, n)
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, period))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_w", place(i).cast("int"))), " ")
    marked = docs.withColumn("_w", F.when((check % 10 == 0) & F.col(text).isNotNull(), words))
    return marked.withColumn(text, F.when(F.size("_w") > 0, planted).otherwise(F.col(text))).drop("_w")
