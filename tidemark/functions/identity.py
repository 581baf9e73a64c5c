"""Canonical JSON, content hashes and checksums.

Spark's VARIANT keeps an object's keys in order, so parse_json and to_json give canonical text inside the JVM.
Where byte parity with another writer's escapes and numbers matters, `canonical_json_exact` spells it out in Arrow batches.
"""

from __future__ import annotations

import json
import struct
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_variant(value: Column) -> Column:
    """Compact JSON of a variant, keys in order."""
    return F.to_json(value)


def canonical_struct(*columns: Column, nulls: bool = True) -> Column:
    """Compact JSON of named columns that the caller gives in key order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if nulls else "true"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@F.pandas_udf(T.StringType())
def canonical_json_exact(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces, and characters outside ASCII as they are; null where it isn't JSON."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def castagnoli_table() -> np.ndarray:
    """CRC-32C remainders of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = out >> 1 ^ np.where(out & 1, np.uint32(0x82F63B78), np.uint32(0))
    return out


BYTES = castagnoli_table()
#: Remainders of each pair of bytes, for short data.
PAIRS = (BYTES[BYTES[np.arange(1 << 16) & 255] & 255 ^ np.arange(1 << 16) >> 8] ^ BYTES[np.arange(1 << 16) & 255] >> 8).tolist()
#: Bytes of a lane; data of several lanes goes through all of them at once.
LANE = 256


@cache
def lane_shift() -> list[list[int]]:
    """What LANE zero bytes make of a remainder, by each of its bytes."""
    out = []
    for k in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(LANE):
            x = BYTES[x & 255] ^ x >> 8
        out.append(x.tolist())
    return out


def crc32c_of(data: bytes, value: int = 0) -> int:
    """CRC-32C of data that goes on from what `value` is the checksum of."""
    value ^= 0xFFFFFFFF
    if len(data) >= 8 * LANE:
        x = np.zeros(-(-len(data) // LANE) * LANE, np.uint8)  # zeros in front leave a remainder of zero as it is
        pad = len(x) - len(data)
        x[pad:] = np.frombuffer(data, np.uint8)
        x[pad : pad + 4] ^= np.frombuffer(value.to_bytes(4, "little"), np.uint8)
        lanes = np.ascontiguousarray(x.reshape(-1, LANE).T)
        rest = np.zeros(lanes.shape[1], np.uint32)
        for row in lanes:
            rest = BYTES[rest & 255 ^ row] ^ rest >> 8
        a, b, c, d = lane_shift()
        value = 0
        for r in rest.tolist():
            value = a[value & 255] ^ b[value >> 8 & 255] ^ c[value >> 16 & 255] ^ d[value >> 24] ^ r
        return value ^ 0xFFFFFFFF
    for pair in struct.unpack_from(f"<{len(data) // 2}H", data):
        value = PAIRS[(value ^ pair) & 0xFFFF] ^ value >> 16
    if len(data) % 2:
        value = int(BYTES[(value ^ data[-1]) & 255]) ^ value >> 8
    return value ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C (Castagnoli) of binary; Spark's crc32 is the IEEE one."""
    return data.map(lambda x: None if x is None else crc32c_of(x))


def rotation_phase(market: Column, stream: Column, period_seconds: int) -> Column:
    """Seconds into a period at which a stream's chunks rotate: the first 8 bytes of a hash as a fraction of it."""
    head = F.sha2(F.concat(market.cast("binary"), F.unhex(F.lit("00")), stream.cast("binary")), 256)
    return F.conv(F.substring(head, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64) * period_seconds
