"""From raw documents to token ids: each stage works on all that the one before it kept.

All stages take null and empty texts, repeated rows, null and repeated doc_ids, empty tables and extra columns of any name: null and
empty texts fail the quality rules (and so go), share one near-duplicate group, hold no benchmark item and no secret, and have
no ids; repeated rows are judged each, but for near-duplicates, where exactly one row of a group stays: that of the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, minhash, quality, scratch, secrets
from tidemark.llm.queries import table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject; cutoffs come from the labels of documents in the input."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles with Jaccard similarity of at least 0.8, checked on all that SimHash links and MinHash bands propose."""
    return minhash.keep_representatives(docs)


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the other columns but text, with ids and the text decoded from them."""
    return bpe.encode(docs, vocabulary())


STAGES = [("quality rules", keep_good), ("near-duplicates", keep_distinct), ("decontamination", drop_leaking), ("secrets", redact_secrets), ("token ids", encode)]

#: Learned cutoffs, edit distances and a forest have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
