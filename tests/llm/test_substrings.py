"""Repeated-string removal against a brute-force count of all 400-byte strings."""

import random
from collections import Counter

import numpy as np
import pytest

from fleetspan.llm import substrings
from fleetspan.llm.substrings import LENGTH, remove_repeats

SCHEMA = "doc_id long, text string, spans string, kept int"


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def corpus():
    draw = random.Random(2)

    def words(n):
        return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 9))) for _ in range(n))

    passage, line = words(160), "=" * 900
    texts = [None, "", "short", "x" * 399, "x" * 400, "x" * 401, line, line + words(50), "ab" * 700]
    base = [words(draw.randrange(60, 500)) for _ in range(12)]
    texts += base + base[:3] + base[:2]
    for text in base:
        cut = draw.randrange(len(text))
        texts.append(text[:cut] + "#" + text[cut:])
        texts.append(words(draw.randrange(5, 60)) + " " + passage[draw.randrange(300) :] + " " + words(20))
        texts.append(words(40) + passage[:400] + words(9))
        texts.append(words(40) + passage[:399] + words(9))
    texts.append(base[0] + words(3) + base[0])
    return texts


@pytest.mark.parametrize("contents, piece, gather", [(4000, 1 << 20, 12 << 20), (1, 1 << 20, 1000), (3, 1500, 1000)])
def test_matches_brute_force(spark, monkeypatch, contents, piece, gather):
    monkeypatch.setattr(substrings, "CONTENTS", contents)
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "GATHER_BYTES", gather)
    texts = corpus()
    rows = [(i if i else None, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[9], "clash", 1)] * 2
    found = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = Counter((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in found)
    want = Counter((row[0], *answer) for row, answer in zip(rows, brute([r[1] for r in rows])))
    assert got == want


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_of_powers_are_no_longer_than_a_piece_needs(monkeypatch):
    monkeypatch.setattr(substrings, "_TABLES", {})
    data = np.zeros(substrings.PIECE + substrings.LENGTH, np.uint8)
    substrings.hasher(data)
    kept = sum(table.nbytes for name in ("powers", "inverse") for table in substrings._TABLES[name])
    # Every worker keeps them, beside the heap of its executor.
    assert kept <= 40 << 20
