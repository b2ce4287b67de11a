"""The corpus pipeline, stage by stage, against what each stage promises."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetspan.llm.common import kept

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(kept(stage(spark, made[-1], FOLDER), "pipeline-test"))
    return made


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def test_columns_stay_until_the_end(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert "token_ids" in stages[-1].columns


def test_quality_drops_what_is_labelled_bad(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in s.collect()} for s in stages[:2])
    known = [d for d in before if d in labels]
    assert after <= before and sum((d in after) == bool(labels[d]) for d in known) >= 0.95 * len(known)


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = ({r["doc_id"]: shingles(r["text"]) for r in s.collect()} for s in stages[1:3])
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    stay = sorted(after)
    assert not any(near(after[a], after[b]) for i, a in enumerate(stay) for b in stay[:i])
    for gone in set(before) - set(after):
        assert any(near(before[gone], before[d]) for d in before if d != gone)


def test_private_data_is_replaced(stages):
    pattern = r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|AKIA\w{16}|\(\d{3}\) \d{3}-\d{4}"
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        old = re.findall(pattern, text)
        assert (text == after[doc_id]) or old or re.search("token|password", text)
        assert len(re.findall(pattern, after[doc_id])) >= len(old) > -1
        assert not [o for o in old if o in after[doc_id]]


def test_tokens_are_those_of_the_mix(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = sorted((r["doc_id"], r["text"]) for r in stages[4].collect())
    made = sorted((r["doc_id"], r["token_ids"], r["decoded"]) for r in stages[5].collect())
    assert [m[0] for m in mixed] == [m[0] for m in made]
    for (_, text), (_, ids, decoded) in zip(mixed, made):
        assert ids == library.encode(text, add_special_tokens=False).ids and decoded == library.decode(ids, skip_special_tokens=False)
