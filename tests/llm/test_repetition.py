"""Repetition rules against a brute-force scan."""

import random
from collections import Counter

from fleetspan.llm.repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT, repetition_rules

SCHEMA = "doc_id long, text string, kept string, extra int"


def brute(text):
    text = text or ""
    words = text.encode().split()
    n = len(words)
    length = [0] * n
    for p in range(n):
        for q in range(n):
            if p != q:
                k = 0
                while max(p, q) + k < n and words[p + k] == words[q + k]:
                    k += 1
                length[p] = max(length[p], k)
    repeated = {p + i for p in range(n) if length[p] >= 5 for i in range(5)}
    spans = {p + i for p in range(n) if length[p] >= MIN_REPEAT for i in range(length[p])}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    failed = n < 10 or 100 * len(repeated) > 20 * n
    most = max([x for x in length if x >= 5], default=0)
    good = not failed and len(spans) / max(n, 1) <= MAX_COVERED and most <= MAX_LONGEST
    chars = sum(c not in " \t\n\r\x0b\x0c" for c in text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, chars, symbols, sum(v - 1 for v in Counter(lines).values()), len(repeated), failed, good, most


def texts():
    draw = random.Random(3)
    made = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 60, "ä b\n\nä b\n \n \nc", "a b c|d <e>"]
    for _ in range(60):
        words = [draw.choice(["a", "b", "c", "dd", "é"]) if draw.random() < 0.5 else f"w{draw.randrange(40)}" for _ in range(draw.randrange(120))]
        if draw.random() < 0.5:
            words += words[: draw.randrange(1, 60)]
        made.append(draw.choice([" ", "\n", "  "]).join(words))
    line = " ".join(f"long{i}" for i in range(130))
    made.append(" ".join(f"u{i}" for i in range(1400)) + " " + line + " mid " + line)
    return made


def test_figures_match_brute_force(spark):
    made = texts()
    rows = [(i if i % 7 else None, text, "clash", 1) for i, text in enumerate(made)] + [(5, made[5], "clash", 1)]
    found = repetition_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")
    got = Counter((row["doc_id"], *(row[n] for n in names)) for row in found)
    assert got == Counter((row[0], *brute(row[1])) for row in rows)


def test_empty_table(spark):
    assert repetition_rules(spark.createDataFrame([], SCHEMA)).count() == 0
