"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds all tokens in a word.  The encoder goes on with the longest token that
starts where the last one ended and that is compatible with it: two tokens are compatible if the merges
of their joined symbols give these two tokens again.  Where nothing fits it takes the last token back and
tries the next shorter one, by a table of the next shorter token that begins a token; no end position is
tried twice, so the work is linear in the word.  A sequence of pairwise compatible tokens is exactly what
the merges in rank order give.

Decoding gathers bytes from one array of all token texts by their offsets.  A null or empty text has no
tokens and decodes to the empty text.  Rows are encoded by themselves; ids may be null or repeated.
The vocabulary file is a parameter, read on the driver and broadcast (a fixed size of some MB).
"""

import hashlib
import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

IDS = ArrayType(IntegerType())

# Words of each of two generations, and pairs of tokens, that a worker remembers.
REMEMBERED = 150_000
PAIRS = 250_000
ROWS_AT_ONCE = 500
BYTES_AT_ONCE = 2 << 20
# Stands before an added token among words; no word holds a blank.
SPECIAL = " "
# The Unicode property White_Space, which the tokenizer's \s stands for.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class BytePairs:
    """The tokenizer of a vocabulary file with byte symbols and, where it has them, word ends."""

    def __init__(self, description: str):
        known = json.loads(description)
        model = known["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in known.get("added_tokens", [])}
        patterns = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(patterns)})") if patterns else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        # The same for texts of ASCII letters only, in lower case.
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        # Every symbol is one character of its own, also the last one of a word together with its end.
        self.codes = {s: chr(0x4000 + i) for i, s in enumerate(self.symbols)}
        self.codes |= {s + self.end: chr(0x5000 + i) for i, s in enumerate(self.symbols)} if self.end else {}
        self.inner = {i: self.codes[symbol] for i, symbol in enumerate(self.symbols)}
        self.last = [self.codes[symbol + self.end] for symbol in self.symbols]
        self.finder = ahocorasick.Automaton()
        self.parts: dict = {}
        known_codes: dict = {}
        for token, number in self.vocab.items():
            symbols = self.split(token)
            coded = "".join(map(self.codes.get, symbols))
            self.parts[number] = symbols
            if self.merged(symbols) == [token]:  # others are never made by merges
                known_codes[coded] = (len(coded), number)
                self.finder.add_word(coded, known_codes[coded])
        self.finder.make_automaton()
        # Of each token that is found: its length, and the next shorter one that it begins with.
        self.n_ids = max([*self.vocab.values(), *self.special.values()]) + 1
        self.lengths = [0] * self.n_ids
        self.shorter: list = [None] * self.n_ids
        for coded, (length, number) in known_codes.items():
            self.lengths[number] = length
            begins = (known_codes.get(coded[:size]) for size in range(length - 1, 0, -1))
            self.shorter[number] = next(filter(None, begins), None)
        # Rank of the merge that makes a token, and the tokens it is made of; rank by the two tokens.
        self.made = {number: (-1, number, number) for number in self.parts}
        self.joined: dict = {}
        for (one, other), rank in self.ranks.items():
            whole, a, b = (self.vocab.get(text) for text in (one + other, one, other))
            if None not in (whole, a, b):
                self.joined[a * self.n_ids + b] = rank
                if self.made[whole][0] < 0 and self.merged(self.parts[whole]) == [one + other]:
                    self.made[whole] = (rank, a, b)
        # What only the tables above are made from: every worker of an executor holds a tokenizer.
        self.n_ranks = len(self.ranks)
        self.compatible: dict = {}
        self.memory: dict = {}
        self.older: dict = {}
        texts = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.pieces = pa.array([texts.get(i, "") + " " for i in range(self.n_ids)], pa.large_binary())
        self.sizes = pc.binary_length(self.pieces).to_numpy()
        del self.ranks, self.parts, self.vocab

    def split(self, token: str) -> list:
        """The symbols of a token."""
        if self.end and token.endswith(self.end) and token != self.end:
            plain = token[: -len(self.end)]
            return [*plain[:-1], plain[-1] + self.end]
        return list(token)

    def merged(self, symbols: list) -> list:
        """Merges in rank order, as they are defined; used for tokens and pairs of tokens only."""
        while len(symbols) > 1:
            ranked = [(self.ranks.get(pair, len(self.ranks)), at) for at, pair in enumerate(zip(symbols, symbols[1:]))]
            rank, at = min(ranked)
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fits(self, left: int, right: int) -> bool:
        """Whether merges make these two tokens of their joined symbols; remembered, as pairs come again and again.

        They don't if some merge across the border comes before those that complete the tokens on its two sides.
        From the last merge backwards, the side made later is opened at the border, and what then meets is looked at.
        """
        first, second = left, right
        limit = self.n_ranks
        known = True
        while True:
            if self.joined.get(first * self.n_ids + second, limit) < limit:
                known = False
                break
            a, b = self.made[first], self.made[second]
            if a[0] < 0 and b[0] < 0:
                break
            # On the left a merge of the same rank comes first, as merges go from left to right.
            if a[0] > b[0]:
                limit, first = a[0], a[2]
            else:
                limit, second = b[0] + 1, b[1]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[left * self.n_ids + right] = known
        return known

    def longest(self, coded: str, start: int):
        """The longest token from a place on, with its length."""
        for last, token in self.finder.iter_long(coded, start):
            return token if last + 1 - token[0] == start else None
        return None

    def encode_word(self, word: str) -> list:
        data = word.encode("utf-8")
        coded = data[:-1].decode("latin-1").translate(self.inner) + self.last[data[-1]]
        n = len(coded)
        compatible, fits, n_ids = self.compatible, self.fits, self.n_ids
        # Mostly the longest tokens one after the other fit at once.
        taken: list = []
        start, previous = 0, None
        for last, (length, number) in self.finder.iter_long(coded):
            if start + length != last + 1:
                break
            if previous is not None:
                known = compatible.get(previous * n_ids + number)
                if not (fits(previous, number) if known is None else known):
                    break
            taken.append(number)
            previous = number
            start += length
        if start == n:
            return taken
        shorter, lengths = self.shorter, self.lengths
        token = self.longest(coded, start)
        dead: set = set()
        while start < n:
            while token is not None:
                length, number = token
                if start + length not in dead:
                    if not taken:
                        break
                    known = compatible.get(taken[-1] * n_ids + number)
                    if fits(taken[-1], number) if known is None else known:
                        break
                token = shorter[number]
            if token is not None:
                taken.append(number)
                start += length
                token = self.longest(coded, start) if start < n else None
            elif taken:
                dead.add(start)
                number = taken.pop()
                start -= lengths[number]
                token = shorter[number]
            else:
                raise ValueError(f"no tokens for {word!r}")
        return taken

    def split_words(self, text: str) -> list:
        """The words of a text in lower case; blanks between them don't matter."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.words.findall(text.replace("Σ", "σ").lower())  # letter by letter: no final sigma

    def word_ids(self, words: list) -> list:
        """Packed ids of every word; those of words met before are remembered."""
        made = list(map(self.memory.get, words))
        for i, ids in enumerate(made):
            if ids is None:
                word = words[i]
                ids = self.older.get(word)
                if ids is None:
                    ids = [self.special[word[1:]]] if word[0] == SPECIAL else self.encode_word(word)
                    ids = array("i", ids).tobytes()
                if len(self.memory) >= REMEMBERED:
                    # Words that come again move over; the others are forgotten with the next turn.
                    self.older, self.memory = self.memory, {}
                made[i] = self.memory[word] = ids
        return made

    def items(self, text) -> list:
        """Words and, with SPECIAL before them, added tokens of a text."""
        if not text:
            return []
        if not any(map(text.__contains__, self.special)):
            return self.split_words(text)
        made: list = []
        for part in self.cut.split(text):
            if part in self.special:
                made.append(SPECIAL + part)
            elif part:
                made.extend(self.split_words(part))
        return made

    def encode_all(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends: every different word is encoded once."""
        words: list = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words += self.items(text)
            ends[i + 1] = len(words)
        if not words:
            return np.zeros(0, np.int32), ends
        coded = pa.array(words, pa.string()).dictionary_encode()
        made = self.word_ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = np.cumsum(sizes) - sizes
        known = np.frombuffer(b"".join(made), np.int32)
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        stops = np.cumsum(lengths)
        place = np.repeat(starts[at] - (stops - lengths), lengths) + np.arange(stops[-1])
        return known[place], np.append(0, stops)[ends]

    def encode(self, text) -> list:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts that rows of ids stand for; ``ends`` begins with 0."""
        stops = np.append(0, np.cumsum(self.sizes[ids]))[ends]
        data = self.pieces.take(pa.array(ids)).buffers()[2]
        rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(stops), data])
        # The blank after a text's last token is no part of it.
        return pc.binary_slice(rows, 0, -1).cast(pa.string())

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


_LOADED: dict = {}


def _loaded(shared) -> BytePairs:
    """The tokenizer of a broadcast description, built once per worker."""
    key = hashlib.sha256(shared.value.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = BytePairs(shared.value)
    return _LOADED[key]


def _encoded(tokenizer: BytePairs, texts: pa.Array) -> pa.Array:
    ids, ends = tokenizer.encode_all(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _decoded(tokenizer: BytePairs, rows: pa.Array) -> pa.Array:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([0, *rows.value_lengths().fill_null(0).to_pylist()])
    return tokenizer.decode_all(flat, ends)


def _slices(batch: pa.RecordBatch, column: str):
    """Rows of a batch, ``ROWS_AT_ONCE`` or ``BYTES_AT_ONCE`` at a time; a longer text goes by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for at in range(len(batch)):
        if at > start and (at - start >= ROWS_AT_ONCE or size + sizes[at] > BYTES_AT_ONCE):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += sizes[at]
    if start < len(batch):
        yield batch.slice(start)


class Tokenizer:
    """Columns of token ids and of decoded texts for one vocabulary file."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            self.shared = spark.sparkContext.broadcast(file.read())

    def encode(self, text: Column) -> Column:
        shared = self.shared

        @F.arrow_udf(IDS)
        def encode(texts: pa.Array) -> pa.Array:
            return _encoded(_loaded(shared), texts)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        shared = self.shared

        @F.arrow_udf(StringType())
        def decode(rows: pa.Array) -> pa.Array:
            return _decoded(_loaded(shared), rows)

        return decode(ids)

    def round_trip(self, text: str, others: list):
        """A function of batches for ``mapInArrow``: other columns, ids and decoded texts, some rows at a time."""
        shared = self.shared

        def run(batches):
            for batch in batches:
                for part in _slices(batch, text):
                    ids = _encoded(_loaded(shared), part.column(text))
                    columns = [*(part.column(c) for c in others), ids, _decoded(_loaded(shared), ids)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*others, "token_ids", "decoded"])
            # The worker goes on with other stages: it keeps the words of one generation only.
            _loaded(shared).older = {}
            pa.default_memory_pool().release_unused()

        return run


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``token_ids``, and ``decoded``, the text that these ids stand for.

    Columns of these names are replaced.  A worker holds the results of ``ROWS_AT_ONCE`` rows.
    """
    tokenizer = Tokenizer(docs.sparkSession, path)
    others = [c for c in (keep or docs.columns) if c not in ("token_ids", "decoded")]
    schema = StructType([docs.schema[c] for c in others]).add("token_ids", IDS).add("decoded", StringType())
    rows = docs.select(*dict.fromkeys([*others, text]))
    return rows.mapInArrow(tokenizer.round_trip(text, others), schema)
