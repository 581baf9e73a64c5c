"""Manifests, builds, REST documents, live messages and archive files as DataFrames."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import archive_time_ns
from ..operators.parse import Object
from ..schemas import partition_columns, schema_for

MANIFEST = "chunk_id string, market string, symbol string, stream string, created_at_utc_ns bigint, record_count bigint, uncompressed_sha256 string, stored_sha256 string, stored_bytes bigint, path string, complete boolean, gap boolean, resync boolean, recovered boolean, capture_flags array<string>"
HISTORY = "source_revision string, source_sha256 string, market string, symbol string, data_type string, row_ordinal bigint, event_time_ns bigint, values array<string>"
VERIFIED = ("VERIFIED", "LOCAL_DELETE_PENDING", "LOCAL_DELETED")


class IncompleteSource(ValueError):
    """A chunk that is neither here nor verified elsewhere."""


def manifests(spark: SparkSession, paths: list[str], market: str | None = None, stream: str | None = None, created_until_ns: int | None = None) -> DataFrame:
    """Chunk manifests under a fixed schema, filtered and in path order."""
    out = spark.read.schema(MANIFEST).option("multiLine", True).json(paths).withColumn("manifest_path", F.input_file_name())
    for column, value in (("market", market), ("stream", stream)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if created_until_ns is None else out.where(F.col("created_at_utc_ns") <= created_until_ns)
    return out.orderBy("manifest_path")


def resolve_sources(chunks: DataFrame, local: DataFrame, archive: DataFrame) -> DataFrame:
    """Where each chunk can be read: here, else in a verified archive; any that is nowhere fails the whole."""
    here = local.select("chunk_id", F.col("path").alias("local_path"))
    away = archive.where(F.col("state").isin(*VERIFIED)).select("chunk_id", F.col("path").alias("archive_path"))
    out = chunks.drop("path").join(here, "chunk_id", "left").join(away, "chunk_id", "left").withColumn("path", F.coalesce("local_path", "archive_path"))
    lost = out.where("path is null").select("chunk_id").limit(5).collect()
    if lost:
        raise IncompleteSource(", ".join(r[0] for r in lost))
    return out.orderBy("uncompressed_sha256", "chunk_id")


def read_build(spark: SparkSession, paths: list[str], market: str, stream: str) -> DataFrame:
    """Partitions of one stream of a build, by the paths its manifest lists (never by pattern)."""
    schema = schema_for(market, stream)
    inside = [f for f in schema.fields if f.name not in partition_columns()]
    base = paths[0].split("/market=")[0]
    return spark.read.schema(type(schema)(inside + [schema[c] for c in partition_columns()])).option("basePath", base).parquet(*paths)


def read_candidates(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Parsed rows of resolved chunks (see resolve_sources), each chunk read once, by the parser of its own stream.

    The list of chunks is metadata, a row for each file, and comes to the driver as any file listing does; what it
    says about each joins its records by chunk.
    """
    from functools import reduce

    from ..operators.parse import parse_stream
    from .rawchunk import read_chunks

    listed: dict[tuple[str, str], list[str]] = {}
    for row in chunks.select("market", "stream", "path").orderBy("market", "stream", "path").toLocalIterator():
        listed.setdefault((row.market, row.stream), []).append(row.path)
    none = F.array().cast("array<string>")
    about = chunks.select(
        F.col("chunk_id").alias("source_chunk_id"), F.col("uncompressed_sha256").alias("source_chunk_sha256"), F.col("complete").alias("source_complete"), F.col("gap").alias("source_gap"),
        F.coalesce("resync", F.lit(False)).alias("source_resync"), F.coalesce("recovered", F.lit(False)).alias("source_recovered"), F.coalesce("capture_flags", none).alias("source_capture_flags"),
    )
    parts = [parse_stream(read_chunks(spark, paths).drop("path").join(about, "source_chunk_id"), market, stream) for (market, stream), paths in listed.items()]
    if not parts:
        raise IncompleteSource("no chunks")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def verify_rows(build: DataFrame, expected: int) -> None:
    found = build.count()
    if found != expected:
        raise IncompleteSource(f"{found} rows, the manifest has {expected}")


def live_metadata(messages: DataFrame, futures: bool = False) -> DataFrame:
    """messages(raw_payload, stream, ...) with the clocks and sequence numbers of websocket JSON; what can't be read keeps its
    bytes and gets the flag `malformed`."""
    doc = Object(F.col("__doc"))
    number = lambda name: F.when((doc.kind(name) == "BIGINT"), F.try_variant_get(F.col("__doc"), f"$['{name}']", "bigint"))
    rows = messages.withColumn("__doc", F.try_parse_json(F.try_validate_utf8(F.col("raw_payload").cast("string"))))
    wanted = ["U", "u", "a", "f", "l"] + (["pu"] if futures else [])
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), number(n).cast("string").alias("v")) for n in wanted)), lambda p: p["v"].isNotNull())
    good = F.schema_of_variant(F.col("__doc")).startswith("OBJECT")
    old = F.coalesce(F.col("capture_flags"), F.array().cast("array<string>")) if "capture_flags" in messages.columns else F.array().cast("array<string>")
    return rows.select(
        *(c for c in messages.columns if c != "capture_flags"), number("E").alias("exchange_event_time"), F.lit(None).cast("bigint").alias("exchange_transaction_time"), number("T").alias("exchange_trade_time"),
        F.map_from_entries(pairs).alias("source_sequence"), F.when(F.coalesce(good, F.lit(False)), old).otherwise(F.array_union(old, F.array(F.lit("malformed")))).alias("capture_flags"),
    )


def rest_envelope(documents: DataFrame) -> DataFrame:
    """REST documents (text) with their request and response provenance, for files of JSON documents."""
    v = F.try_parse_json("text")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return documents.select("*", get("$.request.path", "string").alias("request_path"), get("$.request.request_time_utc_ns", "bigint").alias("request_time_utc_ns"), get("$.response.status", "int").alias("response_status"), F.to_json(get("$.response.model", "variant")).alias("model_json"))


def history(files: DataFrame, revision: Column, market: str, symbol: str, data_type: str, unit: str = "ms") -> DataFrame:
    """Rows of archive files (a binaryFile DataFrame of ZIPs, each with one CSV): rows whose first value isn't an integer
    are skipped, but they count in the ordinal. A task holds one file; files are the archive's unit of a day or month."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, rev, sha in batch.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [n for n in archive.namelist() if n.endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError("an archive must hold exactly one CSV")
                    with archive.open(members[0]) as raw:
                        part = []
                        for ordinal, values in enumerate(csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""))):
                            if values and values[0].lstrip("-").isdigit():
                                part.append((rev, sha, ordinal, values))
                            if len(part) == 20_000:
                                yield pd.DataFrame(part, columns=["r", "s", "o", "v"])
                                part = []
                        yield pd.DataFrame(part, columns=["r", "s", "o", "v"])

    rows = files.select("content", revision.alias("rev"), F.sha2("content", 256).alias("sha")).mapInPandas(run, "r string, s string, o bigint, v array<string>")
    return rows.select(F.col("r").alias("source_revision"), F.col("s").alias("source_sha256"), F.lit(market).alias("market"), F.lit(symbol).alias("symbol"), F.lit(data_type).alias("data_type"), F.col("o").alias("row_ordinal"), archive_time_ns(data_type, F.col("v"), unit).alias("event_time_ns"), F.col("v").alias("values"))
