"""Winnowed fingerprints with positions (DataFrame functions only).

A text's words (pieces of at most ``PIECE`` characters of longer ones) are hashed, and ``K`` neighbouring
hashes make a cyclic-polynomial gram hash, built by doubling.  Of every ``W`` neighbouring grams the
smallest hash is chosen, the rightmost of equals; chosen grams keep their positions.  Two texts that share
``K + W - 1`` consecutive words therefore share a chosen gram.  A text with fewer than ``K`` words has one
gram over all its words, a text without words or a null text an empty fingerprint.

All arrays stay within their row, so nothing is shuffled for a fingerprint.  Equal texts have equal
fingerprints.  Likeness is the share of common gram hashes among all, 1 if both fingerprints are empty.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import kept, small
from fleetspan.shared import numbered

K = 8
W = 16
PIECE = 24
# Neighbours are found within blocks of so many consecutive ids.
BLOCK = 256


def _rotated(value: Column, by: int) -> Column:
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _joined(hashes: Column, step: int):
    return lambda h, i: _rotated(h, step).bitwiseXOR(F.coalesce(F.get(hashes, i + step), h))


def _rightmost_smaller(at: Column, hashes: Column, step: int):
    """Of the choices of two neighbouring windows the one with the smaller hash, the right one of equals."""

    def choose(p, i):
        right = F.get(at, i + step)
        return F.when(F.get(hashes, right) <= F.get(hashes, p), right).otherwise(p)

    return choose


def fingerprints(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``{name}_at`` (positions in words) and ``{name}_grams`` (hashes) of the column ``text``.

    Every array is a column of its own and used at least twice in the next step: Spark then computes it
    once per row instead of once per element.
    """
    words, grams, chosen = (f"_{name}_{part}" for part in ("words", "hashes", "chosen"))
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn(words, pieces)
    df = df.withColumn(grams, F.when(F.size(words) == 0, F.array().cast("array<bigint>"))
                       .when(F.size(words) < K, F.array(F.xxhash64(words)))
                       .otherwise(F.transform(words, lambda word: F.xxhash64(word))))
    step = 1
    while step < K:
        wide = F.col(grams)
        joined = F.transform(wide, _joined(wide, step))
        df = df.withColumn(grams, F.when(F.size(wide) > 1, joined).otherwise(wide))
        step *= 2
    full = F.col(grams)
    df = df.withColumn(grams, F.when(F.size(full) > 1, F.slice(full, 1, F.greatest(F.size(full) - (K - 1), F.lit(1)))).otherwise(full)).drop(words)
    hashes = F.col(grams)
    df = df.withColumn(chosen, F.transform(hashes, lambda _, i: i)).withColumn(f"_{name}_n", F.size(hashes))
    step = 1
    while step < W:
        at = F.col(chosen)

        df = df.withColumn(chosen, F.transform(at, _rightmost_smaller(at, hashes, step)))
        step *= 2
    at = F.col(chosen)
    windows = F.greatest(F.col(f"_{name}_n") - (W - 1), F.least(F.col(f"_{name}_n"), F.lit(1)))
    df = df.withColumn(f"{name}_at", F.array_distinct(F.slice(at, 1, windows))).drop(chosen)
    picked = F.transform(f"{name}_at", lambda p: F.get(hashes, p))
    df = df.withColumn(f"{name}_grams", F.when(F.size(hashes) > 0, picked).otherwise(hashes))
    return df.drop(grams, f"_{name}_n")


def fingerprint_text(name: str) -> Column:
    """``position:hash`` pairs in the order of the text."""
    pairs = F.zip_with(F.col(f"{name}_at"), F.col(f"{name}_grams"), lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.hex(h))))
    return F.array_join(pairs, " ")


def likeness(left: Column, right: Column) -> Column:
    either = F.size(F.array_union(left, right))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / either)


def with_next(docs: DataFrame, columns: list) -> DataFrame:
    """``docs`` with ``next_{column}`` of the row with the next smaller ``doc_id``, of the first after the last.

    Ids are dealt in blocks of ``BLOCK`` consecutive numbers; the largest id of each block is sent to the
    block before it, too.  Rows that share an id meet in one task, ordered by text; rows without id come
    last and are followed by the row with the largest id.
    """
    block = F.floor(F.col("doc_id") / BLOCK) if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte") else F.expr(f"(doc_id - pmod(doc_id, {BLOCK})) div {BLOCK}")
    named = docs.where("doc_id is not null")
    tops = numbered(named.groupBy(block.cast("long").alias("_block")).agg(F.max("doc_id").alias("_top")), [F.col("_block").desc()])
    tops = kept(tops, "neighbour-blocks")
    count = tops.count()
    if count == 0:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before = tops.select(F.col("_block").alias("_to"), F.col("_index").alias("_at"))
    sends = tops.join(before, F.pmod(F.col("_index") - 1, F.lit(count)) == F.col("_at")).select("_top", "_to")
    sends = small(kept(sends, "neighbour-sends"), 24, count)
    own = named.withColumn("_block", block.cast("long")).withColumn("_guest", F.lit(False))
    guests = named.join(sends, F.col("doc_id") == F.col("_top")).withColumn("_block", F.col("_to")).withColumn("_guest", F.lit(True))
    rows = own.unionByName(guests.select(*own.columns))
    order = Window.partitionBy("_block").orderBy("_guest", F.col("doc_id").desc(), "text")
    met = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    met = met.where(~F.col("_guest")).drop("_block", "_guest")
    nameless = docs.where("doc_id is null")
    if nameless.select("doc_id").isEmpty():
        return met
    largest = tops.where("_index = 0").select("_top").first()[0]
    first = named.where(F.col("doc_id") == F.lit(largest)).orderBy("text").limit(1).select(*[F.col(c).alias(f"next_{c}") for c in columns])
    return met.unionByName(nameless.join(F.broadcast(first), F.lit(True)))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has its last half replaced by the beginning of the next document.  Null texts count as
    empty; other columns of ``docs`` are left out.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprints(rows, "text", "own"), ["text", "own_grams"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = fingerprints(rows.drop("text", "next_text"), "edited", "edited")
    return rows.withColumn("near_edited", likeness(F.col("own_grams"), F.col("edited_grams"))).withColumn(
        "near_next", likeness(F.col("own_grams"), F.col("next_own_grams")))
