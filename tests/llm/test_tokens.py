"""BPE against the tokenizers library and an exact round trip of ids."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from fleetspan.llm import tokens
from fleetspan.llm.tokens import encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello  WORLD's 123 tést", "İstanbul ΑΣ ΟΔΟΣ ς", "x\x85y\x1cz\x1f q", "ſ'S's 's'll've",
    "日本語 テスト 😀👍🏽", "<|endoftext|> a<|startoftext|>B<|endoftext", "!!!??? $$$###'s --- ...", "é é́", "\x00a\x00",
    "a" * 3000, "ab" * 2000 + "!" * 1500, "antidisestablishmentarianism " * 40, "éàü" * 500, "0123456789" * 30,
]


@pytest.mark.parametrize("shuffle", [0, 1])
def test_equal_to_library(spark, shuffle):
    known = Library.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS + TEXTS)] + [(1000 + r[0], r[1], "x", "y") for r in docs]
    made = spark.createDataFrame(rows[:: -1 if shuffle else 1], "doc_id long, text string, token_ids string, decoded string")
    found = {r["doc_id"]: r for r in encode_documents(made, PATH).collect()}
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        wanted = known.encode(text or "", add_special_tokens=False).ids
        assert found[doc_id]["token_ids"] == wanted, text
        assert found[doc_id]["decoded"] == known.decode(wanted, skip_special_tokens=False)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_worker_keeps_no_tables_that_only_building_needs():
    with open(PATH, encoding="utf-8") as file:
        built = tokens.BytePairs(file.read())
    assert not hasattr(built, "ranks") and not hasattr(built, "parts")
    assert built.encode("low lower lowest") == Library.from_file(PATH).encode("low lower lowest", add_special_tokens=False).ids


def test_taking_tokens_back_looks_up_the_longest_match_only():
    """No list of all matches of a word, and packed ids for the words that are remembered."""
    with open(PATH, encoding="utf-8") as file:
        built = tokens.BytePairs(file.read())
    whole, starts = built.finder, []

    class Longest:
        def iter_long(self, coded, start=0):
            starts.append(start)
            return whole.iter_long(coded, start)

    built.finder = Longest()
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdeghilmnorstuvwy", k=draw.randint(1, 14))) for _ in range(3000)]
    known = Library.from_file(PATH)
    assert [built.encode(word) for word in words] == [known.encode(word, add_special_tokens=False).ids for word in words]
    assert any(starts)
    assert all(isinstance(ids, bytes) for ids in built.memory.values())
