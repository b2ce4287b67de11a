"""Quality rules on repetition: a suffix array over the words of each text.

Suffixes are sorted by prefix doubling, and only buckets that still hold several suffixes are sorted on.
The longest common prefixes of neighbours in the array, read from the ranks of every doubling, give the
maximal repeated substrings; the union of their spans and the longest of them are limited.  Many texts
share one array, in which a suffix ends with its text, so repeats never cross texts.

A null text counts as empty, has no words and fails; ids may be null or repeated, and every row is
judged by itself.  An empty table gives no rows.  Memory follows the longest text (some 100 bytes for a
word); shorter texts are handled in groups of bounded size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
# The method's verdict: repeats of at least MIN_REPEAT words may cover this share of the words, and the
# longest may have that many words.
MIN_REPEAT = 10
MAX_COVERED = 0.2
MAX_LONGEST = 100
GROUP_WORDS = 1_000_000
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


def _dense(keys: np.ndarray) -> np.ndarray:
    """For every key the number of smaller keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return ranks


def repeat_lengths(codes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For every word the length of the longest substring from it that its text holds elsewhere too.

    Lengths below ``WINDOW - 1`` may be given as 0.
    """
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest
    _, ends = np.unique(text_of, return_index=True)
    stop = np.append(ends[1:], n)[np.cumsum(np.isin(np.arange(n), ends)) - 1]

    def after(ranks, at, step):
        """Rank of the suffix ``step`` words later, -1 beyond the text."""
        to = at + step
        inside = to < stop[at]
        return np.where(inside, ranks[np.where(inside, to, 0)], -1)

    everywhere = np.arange(n)
    ranks = _dense(text_of.astype(np.int64) * (int(codes.max()) + 1) + codes)
    levels, step = [(1, ranks)], 1
    while step < WINDOW - 1:
        ranks = _dense(ranks * (n + 1) + after(ranks, everywhere, step) + 1)
        step *= 2
        levels.append((step, ranks))
    crowd = np.bincount(ranks, minlength=n)
    alive = np.flatnonzero(crowd[ranks] > 1)
    repeated = alive
    while len(alive):
        own, later = ranks[alive], after(ranks, alive, step)
        order = np.lexsort((later, own))
        alive, own, later = alive[order], own[order], later[order]
        at = np.arange(len(alive))
        new_bucket = np.ones(len(alive), bool)
        new_bucket[1:] = own[1:] != own[:-1]
        new_part = new_bucket.copy()
        new_part[1:] |= later[1:] != later[:-1]
        bucket = np.maximum.accumulate(np.where(new_bucket, at, 0))
        part = np.maximum.accumulate(np.where(new_part, at, 0))
        ranks = ranks.copy()
        ranks[alive] = own + part - bucket
        step *= 2
        sizes = np.diff(np.append(np.flatnonzero(new_part), len(alive)))
        again = np.repeat(sizes > 1, sizes)
        if again.any():
            levels.append((step, ranks))
        alive = alive[again]
    if len(repeated) < 2:
        return longest
    suffixes = repeated[np.argsort(ranks[repeated], kind="stable")]
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(left), np.int64)
    for step, ranks in reversed(levels):
        a, b = left + common, right + common
        inside = (a < stop[left]) & (b < stop[right])
        same = inside & (ranks[np.where(inside, a, 0)] == ranks[np.where(inside, b, 0)])
        common += np.where(same, step, 0)
    longest[suffixes[1:]] = common
    longest[suffixes[:-1]] = np.maximum(longest[suffixes[:-1]], common)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _dup_lines(text: str) -> int:
    seen, count = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            if line in seen:
                count += 1
            seen.add(line)
    return count


def _judge(texts: list) -> list:
    """The figures of a group of texts as columns."""
    split = [text.encode("utf-8", "surrogatepass").split() for text in texts]
    counts = np.array([len(words) for words in split], np.int64)
    flat = pa.array([word for words in split for word in words], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), counts)
    longest = repeat_lengths(codes.astype(np.int64), text_of)
    starts = np.flatnonzero(longest >= WINDOW)
    window = _covered(starts, np.full(len(starts), WINDOW), len(codes))
    starts = np.flatnonzero(longest >= MIN_REPEAT)
    spans = _covered(starts, longest[starts], len(codes))
    per_text = lambda values: np.bincount(text_of, weights=values, minlength=len(texts)).astype(np.int64)
    repeats, covered = per_text(window), per_text(spans)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, text_of, np.where(longest >= WINDOW, longest, 0))
    chars = np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    lines = np.array([_dup_lines(t) for t in texts], np.int64)
    failed = (counts < MIN_WORDS) | (100 * repeats > MAX_REPEATED_PERCENT * counts)
    share = covered / np.maximum(counts, 1)
    kept = ~failed & (share <= MAX_COVERED) & (most <= MAX_LONGEST)
    return [counts, chars, symbols, lines, repeats, failed, kept, share, most]


FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_share double, longest_repeat long"
)


def _run(batches):
    names = ["doc_id", *(part.split()[0] for part in FIGURES.split(", "))]
    for batch in batches:
        ids = batch.column("doc_id")
        at = 0
        while at < len(batch):
            texts, size, begin = [], 0, at
            while at < len(batch) and (not texts or size < GROUP_WORDS * 6):
                texts.append(batch.column("text")[at].as_py() or "")
                size += len(texts[-1])
                at += 1
            yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), *map(pa.array, _judge(texts))], names=names)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed``, ``kept``, ``covered_share``, ``longest_repeat``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_run, f"doc_id {kind}, {FIGURES}")
