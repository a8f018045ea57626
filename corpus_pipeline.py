"""A training-data pipeline over ``documents``: each stage applies one operator of ``blockwise.llm`` to all that the
stage before it kept, is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockwise.llm import mixing, ngram_jaccard, secrets, sentencepiece_bpe, toxicity
from blockwise.llm.common import materialize
from blockwise.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return ngram_jaccard.drop_near_copies(docs, words=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's budget asks for."""
    return mixing.mixed_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture."""
    return sentencepiece_bpe.encode(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("secret scan", redact_secrets), ("mix sources", mix_sources), ("SentencePiece", encode)]

#: The learned score and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
