"""The corpus pipeline: documents through quality, near copies, private data, mixing and tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import kept
from fleetspan.llm.jaccard import without_near_copies
from fleetspan.llm.mixing import mixed_corpus
from fleetspan.llm.private import replace_private
from fleetspan.llm.quality import good_documents
from fleetspan.llm.tokens import encode_documents

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data becomes surrogates; the number of characters follows."""
    clean = replace_private(docs)
    length = F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share asks for."""
    return mixed_corpus(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the text that they stand for."""
    made = encode_documents(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id", "lang", "source"])
    return made.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality", quality),
    ("near copies", near_copies),
    ("private data", private_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

# The classifier, the surrogates and the tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
