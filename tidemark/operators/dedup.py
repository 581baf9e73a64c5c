"""Semantic deduplication that keeps every conflicting variant and the lineage of each.

Rows share a semantic key (what they are about) and a logical key (what they say). For each pair of keys the
row of smallest provenance stays, with a count and the ordered list of all sources. Where a semantic key has
several logical ones, all of them stay and are marked as a conflict. Rows are combined before they are shuffled, so
a key that holds a third of them costs a row for each task; only variants reach the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMANTIC, LOGICAL = "semantic_key_sha256", "logical_record_sha256"
PROVENANCE = ("receive_time_utc_ns", "source_chunk_sha256", "source_record_ordinal", "source_subrecord_ordinal", "collector_instance_id", "connection_id", "source_chunk_id")


def lineage(order: list[str]) -> Column:
    return F.struct(*order)


def deduplicate(rows: DataFrame, semantic: list[str], logical: list[str], order: list[str], sources: str | None = "sources") -> DataFrame:
    """One row for each (semantic, logical): the first by `order`, with duplicate_count, identity_conflict and `sources`.

    `order` must tell any two rows apart, or equal ones are interchangeable. Null keys are keys like any other.
    A lineage list is as long as its group, because that is what it says; without one (sources=None), nothing is, and
    lineage_rows() gives the same as rows.
    """
    rest = [c for c in rows.columns if c not in {*semantic, *logical, "duplicate_count", "identity_conflict", sources}]
    found = [F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"), F.count("*").cast("int").alias("duplicate_count")]
    if sources:
        found.append(F.array_sort(F.collect_list(lineage(order))).alias(sources))
    variants = F.count("*").over(Window.partitionBy(*semantic))
    grouped = rows.groupBy(*semantic, *logical).agg(*found).withColumn("identity_conflict", variants > 1)
    return grouped.select(*semantic, *logical, "__first.*", "duplicate_count", "identity_conflict", *([sources] if sources else []))


def lineage_rows(rows: DataFrame, semantic: list[str], logical: list[str], order: list[str]) -> DataFrame:
    """A row for each source of each (semantic, logical), with whether it is the one that stays: no list of a group is ever made."""
    first = rows.groupBy(*semantic, *logical).agg(F.min(F.struct(*order)).alias("__first"))
    keys = [*semantic, *logical]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = rows.select(*keys, *order).alias("l").join(first.alias("r"), reduce(lambda a, b: a & b, same))
    return joined.select(*(F.col(f"l.{c}") for c in [*keys, *order]), F.struct(*(F.col(f"l.{c}") for c in order)).eqNullSafe(F.col("r.__first")).alias("is_winner"))


def deduplicate_events(candidates: DataFrame, scope: str = "global") -> DataFrame:
    """Normalized rows of parsed candidates. scope "global" goes by the hash alone, so identical malformed bytes of
    two streams are one row; "stream" keeps markets and streams apart."""
    semantic = [SEMANTIC] if scope == "global" else ["market", "stream", SEMANTIC]
    # of equal keys the first by chunk, then by place in it; the lineage has its fields in name order, as canonical JSON does
    out = deduplicate(candidates, semantic, [LOGICAL], list(PROVENANCE), "__sources")
    names = sorted(PROVENANCE)
    ordered = F.transform("__sources", lambda s: F.struct(*(s[n].alias(n) for n in names)))
    return out.withColumn("duplicate_sources_json", F.to_json(ordered)).drop("__sources")


def partition_statistics(rows: DataFrame) -> DataFrame:
    """Rows, candidates, conflict rows, source chunks and receive bounds of each (market, stream, date, hour)."""
    sources = F.from_json("duplicate_sources_json", "array<struct<source_chunk_sha256:string>>")
    each = rows.select("market", "stream", "receive_date", "receive_hour", "duplicate_count", "identity_conflict", "receive_time_utc_ns", "logical_record_sha256", F.array_distinct(F.concat(F.array("source_chunk_sha256"), F.coalesce(sources["source_chunk_sha256"], F.array().cast("array<string>")))).alias("hashes"))
    keys = ["market", "stream", "receive_date", "receive_hour"]
    return each.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.sum("duplicate_count").alias("input_candidate_count"), F.count_if("identity_conflict").alias("identity_conflicts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hashes")))).alias("source_chunk_hashes"),
        F.min("receive_time_utc_ns").alias("receive_time_utc_min_ns"), F.max("receive_time_utc_ns").alias("receive_time_utc_max_ns"),
        content_digest(F.col("logical_record_sha256"), F.col("duplicate_count")).alias("content_digest"),
    )


def content_digest(logical: Column, count: Column) -> Column:
    """A digest of a set of rows that no order changes and that partial sums add up: the sum of their hashes."""
    return F.sum(F.xxhash64(logical, count).cast("decimal(38,0)")).cast("string")


def build_totals(statistics: DataFrame) -> DataFrame:
    return statistics.agg(F.count("*").alias("partitions"), F.sum("row_count").alias("row_count"), F.sum("input_candidate_count").alias("input_candidate_count"), F.sum("identity_conflicts").alias("identity_conflicts"))
