"""A corpus pipeline of five operators, each working on all that the one before it kept.

The quality classifier drops what it rejects; exact and near deduplication keep one document of each group; entities
get surrogates; and what is left is packed into sequences of tokens. Every stage is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.common import durable, table
from quillframe.llm.exact_dedup import drop_copies
from quillframe.llm.near_dedup import drop_near_copies
from quillframe.llm.packing import pack
from quillframe.llm.pii import replace_entities
from quillframe.llm.quality import keep_quality
from quillframe.llm.registry import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data and secrets."""
    return replace_entities(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("pii", private), ("pack", packed)]

#: The classifier, the surrogates and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
