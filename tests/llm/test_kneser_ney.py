"""The language model against a brute-force Kneser-Ney model, and its sums of probabilities."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from fleetspan.llm import kneser_ney
from fleetspan.llm.kneser_ney import discounts, held_out_scores

SCHEMA = "doc_id long, text string, held_out string, score string"


def words(text):
    out = (text or "").encode().split()
    return [bytes(w).lower().decode() for w in out] + ["\n"]


class Brute:
    def __init__(self, texts):
        tokens = [words(t) for t in texts]
        self.count = Counter(w for t in tokens for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.pairs = Counter(p for t in tokens for p in zip(["<s>", *t], t))
        self.d = self.rates(self.pairs.values())
        self.context = Counter()
        self.after = defaultdict(Counter)
        self.before = Counter()
        for (a, b), c in self.pairs.items():
            self.context[a] += c
            self.after[a][min(c, 3)] += 1
            self.before[b] += 1
        self.low_d = self.rates(self.before.values())

    def rates(self, counts):
        seen = Counter(counts)
        return discounts(seen[1], seen[2], seen[3], seen[4])

    def low(self, w):
        total = sum(self.before.values())
        rest = sum(self.low_d[min(c, 3) - 1] for c in self.before.values()) / total
        b = self.before[w]
        return (max(b - self.low_d[min(b, 3) - 1], 0) if b else 0) / total + rest / (self.v + 1)

    def high(self, a, w):
        if not self.context[a]:
            return self.low(w)
        c = self.pairs[a, w]
        rest = sum(self.d[k - 1] * n for k, n in self.after[a].items()) / self.context[a]
        return (max(c - self.d[min(c, 3) - 1], 0) if c else 0) / self.context[a] + rest * self.low(w)


def corpus():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Wort", "É", "é"]
    texts = [" ".join(draw.choice(vocabulary[: 2 + draw.randrange(60)]) for _ in range(draw.randrange(30))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "new words WORT only"), (503, "w1 " * 2000), (None, "w1 w2")]


@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_scores_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(kneser_ney, "FLUSH_PAIRS", chunk * 3)
    monkeypatch.setattr(kneser_ney.chunks_of, "__defaults__", (chunk,))
    rows = corpus()
    out = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    model = Brute([t for i, t in rows if not out[i]])
    assert abs(sum(model.high("w1", w) for w in [*model.count, "unknown"]) - 1) < 1e-9
    found = held_out_scores(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for row in found:
        tokens = words(texts[row["doc_id"]])
        assert row["held_out"] == out[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens), sum(w in model.count for w in tokens), model.n)
        base = sum(math.log10((model.count[w] + 1) / (model.n + model.v + 1)) for w in tokens)
        score = sum(math.log10(model.high(a, w)) for a, w in zip(["<s>", *tokens], tokens))
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and math.isclose(row["score"], score, rel_tol=1e-9)


def test_without_training_text(spark):
    found = held_out_scores(spark.createDataFrame([(None, "a b", "x", "y")], SCHEMA)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found] == [(3, 0, 0, 0.0, 0.0)]
    assert held_out_scores(spark.createDataFrame([], SCHEMA)).count() == 0
