"""Framed raw chunks as a Spark data source: one input partition for each chunk.

A chunk is a fixed header with a canonical CBOR body, then frames: length, flags, reserved, CRC-32C, canonical
CBOR envelope. A reader goes forward once, holds one frame, and stops at the first fault with its place; what came
before is valid. Chunks may be compressed with zstd.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.identity import crc32c_of
from ..schemas import ENVELOPE
from . import cbor

# The layout of the format.
MAGIC, VERSION, ORDER_MARK = b"BMRCHNK\x1a", (1, 0), 0xFEFF
HEADER, PREFIX = struct.Struct(">8sBBHIII"), struct.Struct(">IHHI")
HEADER_KEYS = "chunk_id chunk_schema_version collector_instance_id collector_version created_at_utc_ns envelope_schema_version format market max_frame_bytes stream symbol".split()
CHUNK_SCHEMA, ENVELOPE_SCHEMA = "raw-chunk.v1", "event-envelope.v1"
MAX_HEADER, MIN_FRAME, MAX_FRAME = 64 * 1024, 1024, 64 * 1024 * 1024
# End of fixed values.
ENVELOPE_KEYS = [f.name for f in ENVELOPE.fields]
OPTIONAL = {"exchange_event_time", "exchange_transaction_time", "exchange_trade_time"}
SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("source_chunk_id", T.StringType()), T.StructField("source_record_ordinal", T.LongType()),
    *(T.StructField(f.name, f.dataType, True) for f in ENVELOPE.fields),
    T.StructField("issue", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("valid_end", T.LongType()),
])


class Fault(ValueError):
    def __init__(self, issue: str, detail: str):
        super().__init__(detail)
        self.issue, self.detail = issue, detail


def read_exactly(source, n: int) -> bytes:
    out = b""
    while len(out) < n and (more := source.read(n - len(out))):
        out += more
    return out


def read_header(source) -> tuple[dict, int]:
    """The header and its length in bytes."""
    fixed = read_exactly(source, HEADER.size)
    if len(fixed) < HEADER.size:
        raise Fault("invalid_header", "truncated fixed header")
    magic, major, minor, mark, flags, size, crc = HEADER.unpack(fixed)
    if magic != MAGIC or (major, minor) != VERSION or mark != ORDER_MARK or flags or size > MAX_HEADER:
        raise Fault("invalid_header", "not a supported chunk")
    body = read_exactly(source, size)
    if len(body) < size or crc32c_of(body, crc32c_of(fixed[:-4])) != crc:
        raise Fault("invalid_header", "truncated or damaged header")
    try:
        found = cbor.loads(body)
    except cbor.CborError as e:
        raise Fault("invalid_header", str(e)) from e
    sound = isinstance(found, dict) and sorted(found) == HEADER_KEYS and found["chunk_schema_version"] == CHUNK_SCHEMA and found["envelope_schema_version"] == ENVELOPE_SCHEMA
    sound = sound and isinstance(found["chunk_id"], bytes) and len(found["chunk_id"]) == 16 and plain_int(found["created_at_utc_ns"]) and found["created_at_utc_ns"] >= 0
    sound = sound and all(isinstance(found[k], str) and found[k] for k in ("collector_instance_id", "collector_version", "market", "stream", "symbol"))
    if not (sound and plain_int(found["max_frame_bytes"]) and MIN_FRAME <= found["max_frame_bytes"] <= MAX_FRAME):
        raise Fault("invalid_header", "header fields")
    return found | {"chunk_id": str(uuid.UUID(bytes=found["chunk_id"]))}, HEADER.size + size


def plain_int(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def check_envelope(found, header: dict) -> dict:
    """An envelope's fields, as the schema has them; values of the sequence map become JSON texts."""
    if not isinstance(found, dict) or not set(ENVELOPE_KEYS) - OPTIONAL <= set(found) or not set(found) <= set(ENVELOPE_KEYS):
        raise Fault("invalid_envelope", "envelope keys")
    times = ["receive_time_utc_ns", "receive_monotonic_ns", *OPTIONAL]
    if any(found.get(k) is not None and not (plain_int(found[k]) and found[k] >= 0) for k in times) or found["receive_time_utc_ns"] is None:
        raise Fault("invalid_envelope", "envelope clocks")
    sequence, flags = found["source_sequence"], found["capture_flags"]
    if not isinstance(sequence, dict) or not all(isinstance(k, str) and (plain_int(v) or isinstance(v, str)) for k, v in sequence.items()):
        raise Fault("invalid_envelope", "source_sequence")
    if not isinstance(flags, list) or not all(isinstance(f, str) for f in flags) or not isinstance(found["raw_payload"], bytes):
        raise Fault("invalid_envelope", "capture_flags or raw_payload")
    if any(found[k] != header[k] for k in ("market", "symbol", "stream")):
        raise Fault("invalid_envelope", "identity differs from the header's")
    return found | {"source_sequence": {k: json.dumps(v, ensure_ascii=False) for k, v in sequence.items()}}


def read_chunk(source) -> Iterator[tuple[dict, int, dict | None, int, Fault | None]]:
    """(header, ordinal, envelope, end of what is valid, fault): each record, then one row without an envelope that ends the scan."""
    header, end = {"chunk_id": None}, 0
    try:
        header, end = read_header(source)
    except Fault as e:
        yield header, 0, None, 0, e
        return
    ordinal = 0
    while prefix := read_exactly(source, PREFIX.size):
        try:
            if len(prefix) < PREFIX.size:
                raise Fault("truncated_tail", "incomplete frame prefix")
            size, flags, reserved, crc = PREFIX.unpack(prefix)
            if flags or reserved:
                raise Fault("unsupported_flags", "frame flags")
            if not 0 < size <= header["max_frame_bytes"]:
                raise Fault("invalid_frame_length", "frame length")
            body = read_exactly(source, size)
            if len(body) < size:
                raise Fault("truncated_tail", "incomplete frame body")
            if crc32c_of(body, crc32c_of(prefix[:-4])) != crc:
                raise Fault("checksum_failure", "frame checksum")
            try:
                envelope = check_envelope(cbor.loads(body), header)
            except cbor.CborError as e:
                raise Fault("invalid_envelope", str(e)) from e
        except Fault as e:
            yield header, ordinal, None, end, e
            return
        end += PREFIX.size + size
        yield header, ordinal, envelope, end, None
        ordinal += 1
    yield header, ordinal, None, end, None


def write_header(header: dict) -> bytes:
    body = cbor.dumps(header | {"chunk_id": uuid.UUID(header["chunk_id"]).bytes})
    fixed = struct.pack(">8sBBHII", MAGIC, *VERSION, ORDER_MARK, 0, len(body))
    return fixed + struct.pack(">I", crc32c_of(body, crc32c_of(fixed))) + body


def write_frame(envelope: dict) -> bytes:
    body = cbor.dumps(envelope)
    prefix = struct.pack(">IHH", len(body), 0, 0)
    return prefix + struct.pack(">I", crc32c_of(body, crc32c_of(prefix))) + body


@dataclass
class Chunk(InputPartition):
    path: str


class ChunkReader(DataSourceReader):
    def __init__(self, paths: list[str], issues: bool):
        self.paths, self.issues = paths, issues

    def partitions(self):
        return [Chunk(p) for p in self.paths]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if "://" in partition.path or partition.path.startswith("file:"):
            system, path = fs.FileSystem.from_uri(partition.path)
        else:
            system, path = fs.LocalFileSystem(), partition.path
        schema = arrow_schema()
        rows: list[dict] = []
        with system.open_input_stream(path, compression=None) as raw:
            source = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw)) if path.endswith(".zst") else raw
            for header, ordinal, envelope, end, fault in read_chunk(source):
                if envelope is None and not self.issues:
                    if fault:
                        raise fault  # fail closed: a damaged chunk is no input
                    continue
                base = {"path": partition.path, "source_chunk_id": header["chunk_id"], "source_record_ordinal": ordinal, "issue": fault.issue if fault else "none", "detail": fault.detail if fault else None, "valid_end": end}
                rows.append(base | {k: (list(v.items()) if isinstance(v, dict) else v) for k, v in (envelope or {}).items()})
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in SCHEMA.fields])


class RawChunks(DataSource):
    """spark.read.format("raw_chunks").option("paths", json list).option("issues", "true" or "false")."""

    @classmethod
    def name(cls) -> str:
        return "raw_chunks"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(json.loads(self.options["paths"]), self.options.get("issues", "false") == "true")


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Envelopes of verified chunks; a damaged chunk is an error."""
    spark.dataSource.register(RawChunks)
    return spark.read.format("raw_chunks").option("paths", json.dumps(paths)).load().drop("issue", "detail", "valid_end")


def scan_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All that can be read, and one row for each chunk's end: its first fault, or "none", and the first place that isn't valid."""
    spark.dataSource.register(RawChunks)
    return spark.read.format("raw_chunks").option("paths", json.dumps(paths)).option("issues", "true").load()
