"""The quality classifier: calibration, held-out accuracy, and odd inputs."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fleetspan.llm.quality import (
    BINS, FEATURES, RIDGE, STATISTICS, fit_quality, good_documents, isotonic, quality_scores, statistics, text_statistics)

SCHEMA = "doc_id long, text string, quality string, score string"


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9)))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(draw.randrange(20, 200))]
        good = draw.random() < 0.7
        text = " ".join(words) if good else draw.choice([" ".join(w.upper() + "!!" for w in words), " ".join(words[:5] * 20)])
        rows.append((i, text, "clash", "clash"))
        labels.append((i, int(good)))
    labels += [(3, None), (None, 1), (10**9, 0), (5, labels[5][1])]
    return rows + [(600, None, "", ""), (601, "", "", ""), (None, "no id here", "", ""), (602, "x" * 100_000, "", ""), rows[7]], labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    stats = docs.select("doc_id", statistics(F.col("text")).alias("_stats"))
    found = quality_scores(stats, marks).collect()
    assert len(found) == len(rows)
    truth, right = dict(labels), []
    for row in found:
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
        out = row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        assert row["held_out"] == out
        if out and truth.get(row["doc_id"]) is not None:
            right.append(row["predicted"] == truth[row["doc_id"]])
    assert np.mean(right) > 0.97 and len(right) > 50
    kept = good_documents(docs, marks)
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in found if not r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found} - gone


def test_fit_equals_brute_force(spark):
    """Ridge and pooled levels over all rows at once, whatever the number of parts and tasks."""
    rows, labels = corpus()
    marks = {d: q for d, q in sorted(labels, key=str) if q is not None}
    used = [(text, marks[d]) for d, text, _, _ in rows if d is not None and d in marks and zlib.crc32(str(d).encode()) % 5]
    numbers, truth = np.array([text_statistics(t) for t, _ in used]), np.array([float(q) for _, q in used])
    stats = spark.createDataFrame(rows, SCHEMA).select("doc_id", statistics(F.col("text")).alias("_stats"))
    for parts in ("1", "8", "700"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            model = fit_quality(stats.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert np.allclose(model.mean, numbers.mean(axis=0), atol=1e-8) and np.allclose(model.spread, np.maximum(numbers.std(axis=0), 1e-6), atol=1e-8)
        waves = model.features(numbers)
        penalty = np.diag([RIDGE * len(used)] * FEATURES + [0.0])
        weights = np.linalg.solve(waves.T @ waves + penalty, waves.T @ truth)
        assert np.allclose(model.weights, weights, atol=1e-6)
        bins = np.clip(((waves @ model.weights + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        some = np.unique(bins)
        means = np.array([truth[bins == b].mean() for b in some])
        sizes = np.array([(bins == b).sum() for b in some])
        # The level of a bin by the min-max formula: over stretches that begin at or before and end at or after it.
        level = [max(min(np.average(means[i : j + 1], weights=sizes[i : j + 1]) for j in range(k, len(some))) for i in range(k + 1)) for k in range(len(some))]
        assert np.allclose(model.levels, level)


def test_further_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a few words in a row", 7, 8), (2, "more words in a row", 7, 8)], "doc_id long, text string, _id int, _stats int")
    marks = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, good_documents(docs, marks).collect())) == sorted(map(tuple, docs.collect()))
    assert good_documents(docs.limit(0), marks).count() == 0


def test_isotonic_pools():
    sums, counts = np.array([1.0, 3.0, 1.0, 4.0]), np.array([4.0, 4.0, 4.0, 4.0])
    assert isotonic(sums, counts).tolist() == [0.25, 0.5, 0.5, 1.0]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "")], SCHEMA)
    stats = docs.select("doc_id", statistics(F.col("text")).alias("_stats"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(stats, none).first()["score"] == 0.5
    only = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality_scores(stats, only).first()["score"] == 0.0
    assert quality_scores(stats.limit(0), none).count() == 0
    assert text_statistics(None) == text_statistics(" \n") == [0.0] * STATISTICS
