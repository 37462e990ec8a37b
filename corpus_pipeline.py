"""The training-data pipeline: quality rules, near-dedup, repeated passages, personal data, packing.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of documents: quality rules drop what
they reject, near-dedup keeps one document of each group (five-word shingles, similarity 0.8), repeated passages and personal data are
taken out of the texts, and packing gives the pieces of full training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpie.llm import bpe, minhash, packing, pii, rules, suffix
from kelpie.llm.common import durable, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.vocabulary())


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("repeated passages", repeated_passages), ("personal data", personal_data), ("packing", pack)]

#: Signatures, learned rules and retrieval can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of sf_dir; what a stage gives is written to the shared folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else durable(docs)
    return docs
