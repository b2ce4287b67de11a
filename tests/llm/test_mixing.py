"""Mixing: targets by water filling, rates, copies, and reruns."""

import random
from collections import defaultdict

import pytest

from fleetspan.llm import mixing
from fleetspan.llm.mixing import mix_sources, mixed_corpus

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def rows(seed=1, n=400):
    draw = random.Random(seed)
    sources = ["b", "a", "é", "Z", "", None, "only empty"]
    made = []
    for i in range(n):
        source = "b" if draw.random() < 0.4 else draw.choice(sources)
        text = None if source == "only empty" else draw.choice([None, "", " ", " ".join(["w"] * draw.randrange(1, 60))])
        made.append((i if i % 9 else None, text, source, "clash", "clash"))
    return made + made[:5]


def targets(sizes):
    """Shares by weight, with the excess over twice a source dealt again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("per_task", [20_000, 5])
def test_targets_and_copies(spark, monkeypatch, per_task):
    monkeypatch.setattr(mixing, "ROWS_PER_TASK", per_task)
    given = rows()
    sizes = defaultdict(int)
    for _, text, source, *_ in given:
        sizes[source] += len((text or "").split())
    wanted = targets(sizes)
    frame = spark.createDataFrame(given, SCHEMA)
    found = mix_sources(frame.repartition(3)).collect()
    assert len(found) == len(given)
    taken = defaultdict(int)
    for row in found:
        assert row["size"] == len((row["text"] or "").split())
        assert row["source_size"] == sizes[row["source"]] and row["target"] == pytest.approx(wanted[row["source"]])
        assert row["taken"] == row["copies"] * row["size"] and 0 <= row["copies"] <= 2
        taken[row["source"]] += row["taken"]
    # What is left can't be mended by one document: some dozens of documents a source, of 60 words at most.
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= max(0.01 * target, 15), source
    again = mix_sources(frame.repartition(5), slim=True).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_corpus_repeats_documents(spark):
    frame = spark.createDataFrame(rows(2, 100), SCHEMA)
    dealt = mix_sources(frame)
    made = mixed_corpus(frame)
    assert made.columns == frame.columns
    assert made.count() == sum(r["copies"] for r in dealt.collect())


def test_empty_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = mix_sources(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).first()
    assert (nothing["size"], nothing["target"], nothing["taken"]) == (0, 0.0, 0)
