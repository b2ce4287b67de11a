"""Periodic runs against a scan of all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fleetspan.llm.queries import run_figures
from fleetspan.llm.runs import periodic_runs, solve_tile, tiles, with_planted_runs, word_numbers

SCHEMA = "doc_id long, text string, runs string, _row int, n_words string"


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def brute(words):
    runs = brute_runs(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def texts():
    draw = random.Random(11)
    made = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x " * 97, "a b " * 40 + "a", "ä ä ä ä ä ä ä b"]
    for _ in range(120):
        words = [draw.choice("abc") for _ in range(draw.randrange(80))]
        for _ in range(draw.randrange(4)):
            root = [draw.choice("abcd") for _ in range(draw.randrange(1, 14))]
            words += root * draw.randrange(2, 12) + root[: draw.randrange(len(root))] + [draw.choice("ab") for _ in range(draw.randrange(5))]
        made.append(draw.choice([" ", "\n", "  "]).join(words))
    unit = [f"w{draw.randrange(900)}" for _ in range(701)]
    made.append(" ".join(unit * 4 + unit[:13]))
    made.append(" ".join([f"u{i}" for i in range(3000)] + ["z"] * 9000 + [f"u{i}" for i in range(50)] * 7))
    return made


def test_tiles_find_every_run_of_random_words():
    draw = random.Random(2)
    for trial in range(300):
        words = [draw.choice("ab") for _ in range(draw.randrange(1, 90))]
        words += [draw.choice("abc") for _ in range(draw.randrange(1, 9))] * draw.randrange(1, 9)
        codes, ends, _ = word_numbers([b"q r s t u v w x y", " ".join(words).encode()])
        spans = {}
        for text, block, first, part, bounds in tiles(codes, ends):
            for q, stretches in solve_tile(part, bounds - first, block).items():
                spans.setdefault((text, q), []).extend((first + a, first + b) for a, b in stretches)
        found = []
        for (text, q), stretches in spans.items():
            joined = []
            for low, high in sorted(stretches):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(high, joined[-1][1])
                else:
                    joined.append([low, high])
            found += [(low, high - low + q, q) for low, high in joined if high - low + q >= max(6, 4 * q)]
            assert text == 1
        assert sorted(found) == brute_runs(words), trial


def test_runs_and_collapsed_texts_match_brute_force(spark):
    made = texts()
    rows = [(i if i % 7 else None, text, "clash", 1, "c") for i, text in enumerate(made)] + [(5, made[6], "clash", 1, "c")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(repr((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in periodic_runs(docs).collect())
    wanted = []
    for row in rows:
        words = (row[1] or "").encode().split()
        wanted.append(repr((row[0], len(words), *brute(words))))
    assert got == sorted(wanted)
    digests = {r["collapsed"] for r in periodic_runs(docs, collapsed="sha256").collect()}
    assert digests == {hashlib.sha256(brute((row[1] or "").encode().split())[1].encode()).hexdigest() for row in rows}


def test_planted_figures(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(200))), "c", 1, "c") for i in range(150)] + [(None, "a a a a a a a", "c", 1, "c"), (151, None, "c", 1, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in run_figures(with_planted_runs(docs)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        words = planted(doc_id, (text or "").encode().split()) if doc_id is not None else text.encode().split()
        runs, rest = brute(words)
        row = got[doc_id]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(rest.encode()).hexdigest()


def test_a_very_long_periodic_text(spark):
    draw = np.random.default_rng(1)
    unit = " ".join(f"w{i}" for i in draw.integers(0, 5000, 20_000))
    docs = spark.createDataFrame([(1, "b " * 150_000 + (unit + " ") * 4, "c", 1, "c")], SCHEMA)
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 150_000, 1), (150_000, 80_000, 20_000)]
    assert row["collapsed"] == "b " + unit


def test_empty_table_and_clashes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic_runs(empty).count() == 0
    with pytest.raises(ValueError, match="clash"):
        periodic_runs(empty, keep=["runs"])
