"""Raw chunks written from envelopes: rotation by time and size, frames with checksums, one manifest row for each chunk."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import floor_div
from ..functions.identity import rotation_phase
from ..schemas import ENVELOPE
from ..sources.rawchunk import CHUNK_SCHEMA, ENVELOPE_SCHEMA, write_frame, write_header

PERIOD_SECONDS, MAX_BYTES, FRAME_LIMIT = 60, 128 << 20, 16 << 20
OUT = "chunk_id string, market string, symbol string, stream string, rotation bigint, part int, record_count bigint, payload binary"


def with_rotation(envelopes: DataFrame, period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    """The rotation that each envelope falls into; a hash of its stream staggers the ends."""
    phase = (rotation_phase(F.col("market"), F.col("stream"), period_seconds) * 1_000_000_000).cast("bigint")
    return envelopes.withColumn("rotation", floor_div(F.col("receive_time_utc_ns") - phase, period_seconds * 1_000_000_000))


def to_chunks(envelopes: DataFrame, collector: str, version: str, created_at_ns: int, max_bytes: int = MAX_BYTES, file_format: str = "raw-chunk") -> DataFrame:
    """One row for each chunk of a (market, symbol, stream, rotation): its bytes, compressed with zstd. A chunk closes at
    max_bytes, so what a task holds is one chunk. Ids come from content, so a task that runs again writes the same chunks."""
    names = [f.name for f in ENVELOPE.fields]
    keys = ["market", "symbol", "stream", "rotation"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, frames, size = None, 0, [], 0

        def close() -> pd.DataFrame:
            market, symbol, stream, rotation = key
            chunk = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}:{part}:{len(frames)}:{hash_of(frames)}"))
            header = {"chunk_id": chunk, "chunk_schema_version": CHUNK_SCHEMA, "collector_instance_id": collector, "collector_version": version, "created_at_utc_ns": created_at_ns, "envelope_schema_version": ENVELOPE_SCHEMA, "format": file_format, "market": market, "max_frame_bytes": FRAME_LIMIT, "stream": stream, "symbol": symbol}
            body = zstandard.ZstdCompressor(level=3).compress(write_header(header) + b"".join(frames))
            return pd.DataFrame([(chunk, market, symbol, stream, rotation, part, len(frames), body)], columns=[c.split(" ")[0] for c in OUT.split(", ")])

        for batch in batches:
            for row in batch.to_dict("records"):
                own = tuple(row[k] for k in keys)
                frame = write_frame(plain_envelope(row, names))
                if frames and (own != key or size + len(frame) > max_bytes):
                    yield close()
                    part, frames, size = (part + 1 if own == key else 0), [], 0
                elif own != key:
                    part = 0
                key = own
                frames.append(frame)
                size += len(frame)
        if frames:
            yield close()

    n = int(envelopes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return envelopes.select(*names, "rotation").repartition(n, *keys).sortWithinPartitions(*keys, "receive_time_utc_ns", "receive_monotonic_ns").mapInPandas(run, OUT)


def hash_of(frames: list[bytes]) -> str:
    import hashlib

    h = hashlib.sha256()
    for f in frames:
        h.update(f)
    return h.hexdigest()


def plain_envelope(row: dict, names: list[str]) -> dict:
    import json

    out = {}
    for n in names:
        v = row[n]
        if n == "source_sequence":
            v = {k: json.loads(x) for k, x in dict(v).items()}
        elif n == "capture_flags":
            v = [str(x) for x in v]
        elif n == "raw_payload":
            v = bytes(v)
        elif n.endswith(("_ns", "_time")):
            v = None if pd.isna(v) else int(v)
        out[n] = v
    return out
