"""The Jaccard join against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetspan.llm import jaccard
from fleetspan.llm.jaccard import (
    jaccard_components, least_difference, overlap_needed, shingles, signature, similar, tree_overlaps, without_near_copies)

SCHEMA = "doc_id long, text string, node string, n string"


def words(text):
    return [w.lower() for w in (text or "").encode().split()]


def brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    draw = random.Random(seed)
    new = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    passage = new(60)
    texts = [None, "", "  ", "one two", "One TWO", "a b c d", "a b c d e", "É é x", "é é x", "z " * 90]
    for _ in range(14):
        base = new(draw.randrange(5, 220))
        texts.append(" ".join(base))
        for _ in range(draw.randrange(6)):  # a star of edits, and chains of edits
            edited = list(base)
            for _ in range(draw.randrange(1, 4 + len(base) // 30)):
                edited[draw.randrange(len(edited))] = new(1)[0]
            texts.append(draw.choice([" ", "\n"]).join(edited))
            if draw.random() < 0.4:
                base = edited
    texts += [" ".join(new(draw.randrange(30)) + passage + new(draw.randrange(40))) for _ in range(25)]
    texts += draw.sample(texts, 15)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)] + [(None, texts[12]), (None, "alone in the null world here"), (7000, texts[13]), (7000, texts[13])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block, often", [(1, 3000, 4), (2, 3, 1), (3, 3000, 10**9)])
def test_components_match_brute_force(spark, monkeypatch, seed, block, often):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "PARTNERS", block)
    rows = corpus(seed)
    made = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    found = jaccard_components(made).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_tree_and_bounds():
    draw = np.random.default_rng(0)
    for _ in range(60):
        probe = np.unique(draw.integers(0, 400, draw.integers(1, 300)).astype(np.uint64))
        others = []
        for _ in range(12):
            own = np.unique(np.append(draw.choice(probe, draw.integers(1, len(probe) + 1)), draw.integers(0, 2000, draw.integers(0, 40)).astype(np.uint64)))
            others.append(own)
        for own, found in zip(others, tree_overlaps(probe, others, step=7)):
            overlap = len(np.intersect1d(probe, own))
            enough = overlap >= overlap_needed(len(probe), len(own))
            assert enough == similar(overlap, len(probe), len(own))
            assert found == (overlap if enough else -1)
            assert least_difference(signature(probe), signature(own)) <= len(probe) + len(own) - 2 * overlap


def test_shingles_of_short_texts():
    assert len(shingles(np.zeros(0, np.uint64))) == 0
    assert len(shingles(np.array([1, 2], np.uint64))) == 1
    assert len(shingles(np.array([1, 1, 1, 1, 1, 1, 1], np.uint64))) == 1


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_go_and_further_columns_of_any_name_stay(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, 5, 6), (2, long + " more", 5, 6), (3, "", 5, 6), (4, "quite another text of words", 5, 6)] + [(7, "one row that comes twice", 5, 6)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own int, _ticket int")
    found = without_near_copies(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == sorted([rows[0], *rows[2:5]])


def test_classes_under_one_shingle_fall_apart_by_size():
    draw = np.random.default_rng(1)
    tokens = np.repeat(np.arange(1, 40, dtype=np.uint64), 25)
    sizes = np.exp(draw.uniform(0, 9, len(tokens))).astype(np.int64) + 1
    order = np.lexsort((sizes, tokens))
    tokens, sizes = tokens[order], sizes[order]
    part = jaccard.size_parts(tokens, sizes)
    for i in range(len(tokens)):
        for j in range(i):
            if tokens[i] == tokens[j] and jaccard.possible(int(sizes[i]), int(sizes[j])):
                assert part[i] == part[j]
            if part[i] == part[j]:
                assert tokens[i] == tokens[j]
    assert len(np.unique(part)) > 100
    nodes = np.arange(len(tokens))
    columns = {"tokens": tokens, "places": nodes[::-1], "nodes": nodes[::-1], "sizes": sizes[::-1], "scores": nodes[::-1] % 7}
    blob = {name: pa.array([jaccard.pack(values.astype(jaccard.PACKED[name]))], pa.binary()) for name, values in columns.items()}
    found = jaccard._shard_groups((pa.scalar(0),), pa.table(blob)).to_pydict()
    rows = list(zip(*found.values()))
    assert len({name for is_pair, name, _ in rows if not is_pair}) == sum(np.bincount(part) > 1)
    assert sorted(node for is_pair, _, node in rows if not is_pair) == np.flatnonzero(np.bincount(part)[part] > 1).tolist()
    for is_pair, a, b in rows:
        assert not is_pair or (part[a] == part[b] and jaccard.possible(int(sizes[a]), int(sizes[b])))
