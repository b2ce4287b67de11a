"""Hard negatives against products of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.llm.negatives import Anchors, Bucket, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, _vector string, score int"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    once = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        once[vec_id] = min(once.get(vec_id, (label, whole)), (label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(once[a][1], once[b][1]))
    answer = []
    for a in filter(is_anchor, once):
        ordered = sorted((-score(a, b), b) for b in once if b != a)
        same = [(b, -s) for s, b in ordered if once[b][0] == once[a][0]][:positives]
        for p, of_p in same:
            fit = [(b, -s) for s, b in ordered if once[b][0] != once[a][0] and low * of_p <= -100 * s <= high * of_p]
            answer += [(a, p, rank, b, of_p, s) for rank, (b, s) in enumerate(fit[:negatives], 1)]
    return sorted(answer)


def vectors(draw, n, width=8, labels=4, spread=1.0):
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    made = []
    for i in range(n):
        label = draw.randrange(labels)
        size = math.exp(draw.gauss(0, spread))
        made.append((i, label, [size * (draw.gauss(0, 1) + centres[label][k]) / 4 for k in range(width)]))
    return made


def check(spark, rows, divisor=10, **more):
    docs = spark.createDataFrame([(*row, "clash", 1) for row in rows], SCHEMA).repartition(3)
    limits = {k: v for k, v in more.items() if k in ("positives", "negatives", "low", "high")}
    got = hard_negatives(docs, F.col("vec_id") % divisor == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % divisor == 0, **limits)


def test_random_vectors_ties_and_odd_rows(spark):
    draw = random.Random(8)
    rows = vectors(draw, 500)
    rows += [(500 + i, i % 3, [0.25] * 8) for i in range(60)]
    rows += [(600, None, [1.0] * 8), (610, 1, None), (620, 1, [1.0] * 7 + [None]), (630, 2, [float("nan")] * 8), (640, 2, [float("-inf")] * 8)]
    rows += [(None, 1, [1.0] * 8), (650, 0, []), (660, 1, [0.0] * 8), (670, 1, [9.0, 1.0]), (680, 2, [-0.001] * 8)]
    rows += [(20, 3, [9.0] * 8), rows[30], rows[31]]
    check(spark, rows, bucket_rows=64)


def test_lengths_far_apart_other_limits_and_blocks(spark):
    draw = random.Random(9)
    rows = vectors(draw, 400, width=16, spread=2.0)
    check(spark, rows, 25, positives=3, negatives=7, low=50, high=120, bucket_rows=50, anchor_bytes=1500)


def test_few_rows_and_one_label(spark):
    check(spark, [])
    check(spark, [(1, 0, [1.0])])
    check(spark, [(10, 0, [1.0]), (20, 0, [1.0]), (30, 1, [0.9])])
    check(spark, [(10 * i, 0, [float(i)]) for i in range(7)])


def test_a_long_vector_and_too_large_numbers(spark):
    draw = random.Random(1)
    check(spark, [(i, i % 2, [draw.gauss(0, 1) for _ in range(3000)]) for i in range(40)])
    docs = spark.createDataFrame([(10, 0, [1e30], "", 1)], SCHEMA)
    with pytest.raises(Exception, match="component of"):
        hard_negatives(docs, F.col("vec_id") % 10 == 0).collect()


def test_ranges_of_coordinates_leave_rows_out_but_none_that_reach_the_bound():
    draw = np.random.default_rng(3)
    rows = np.floor(draw.normal(0, 60, (2000, 6))).astype(np.int64)
    bucket = Bucket(np.arange(2000), np.zeros(2000, int), rows)
    anchors = Anchors(np.arange(40), np.zeros(40, int), rows[:40])
    left_out = 0
    for at in range(40):
        scores = rows @ rows[at]
        for bound in np.quantile(scores, [0.0, 0.3, 0.9, 0.99, 1.0]).astype(int):
            found = bucket.candidates(anchors, at, int(bound))
            assert set(np.flatnonzero(scores >= bound)) <= set(found)
            left_out += 2000 - len(found)
    assert left_out > 40 * 5 * 2000 * 0.2
