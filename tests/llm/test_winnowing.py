"""Winnowed fingerprints against brute force over the gram hashes, neighbours and edited texts."""

import hashlib
import random

import pyspark.sql.functions as F

from fleetspan.llm.queries import op5_winnowing
from fleetspan.llm.winnowing import K, W, edited_fingerprints, fingerprints

SCHEMA = "doc_id long, text string, own_at string, next_text string"


def rows():
    draw = random.Random(5)
    texts = [None, "", "  \n", "one", "one two three", "z" * 100, "é ü ñ " * 3, "same " * 60, "a b " * 50]
    for n in (K - 1, K, K + 1, K + W - 2, K + W - 1, K + W, 90, 300):
        texts.append(" ".join(draw.choice("abcdefghij") + str(draw.randrange(30)) for _ in range(n)))
    texts += texts[-3:]
    ids = draw.sample(range(-2000, 3000), len(texts) - 2) + [7_000_000_000, -5_000_000_000]
    return list(zip(ids, texts, ["x"] * len(texts), ["y"] * len(texts)))


def test_windows_and_rightmost_minimum(spark):
    made = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text")
    for row in fingerprints(made, "text", "own").collect():
        words = [w[i : i + 24] for w in (row["text"] or "").encode().decode().split() for i in range(0, len(w), 24)]
        if len(words) < K:
            assert row["own_at"] == [0] * bool(words)
            continue
        hashed = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", F.xxhash64("w").alias("h"))
        one = [r["h"] for r in hashed.orderBy("i").collect()]
        mask = (1 << 64) - 1
        turn = lambda v, n: ((v << n) | (v >> (64 - n))) & mask
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        grams = []
        for i in range(len(one) - K + 1):
            value = 0
            for j in range(K):
                value ^= turn(one[i + j] & mask, K - 1 - j)
            grams.append(signed(value))
        want = []
        for i in range(max(1, len(grams) - W + 1)):
            window = range(i, min(len(grams), i + W))
            best = min(window, key=lambda p: (grams[p], -p))
            want += [best] if best not in want else []
        assert row["own_at"] == want
        assert row["own_grams"] == [grams[p] for p in want]


def test_edited_texts_and_likeness(spark):
    given = rows() + [(None, "no id at all", "x", "y"), (None, None, "x", "y")]
    found = edited_fingerprints(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    assert len(found) == len(given)
    order = sorted([r for r in given if r[0] is not None], key=lambda r: -r[0])
    after = {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}
    grams = {r["doc_id"]: set(r["own_grams"]) for r in found}
    for row in found:
        text = next((r[1] or "" for r in given if r[0] == row["doc_id"]), "") if row["doc_id"] is not None else None
        if text is None:
            continue
        half = len(text) // 2
        assert row["n_chars"] == len(text)
        assert row["edited"] == text[: len(text) - half] + after[row["doc_id"]][:half]
        own, other = grams[row["doc_id"]], set(row["next_own_grams"])
        assert row["near_next"] == (len(own & other) / len(own | other) if own | other else 1.0)
        other = set(row["edited_grams"])
        assert row["near_edited"] == (len(own & other) / len(own | other) if own | other else 1.0)


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    after = {d: docs[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    prints = {}
    for row in op5_winnowing(spark, folder).collect():
        text = docs[row["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[row["doc_id"]][:half]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]


def test_empty_table(spark):
    assert edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
