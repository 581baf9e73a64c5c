"""The part of CBOR that raw chunks use, in canonical form: integers, texts, bytes, arrays, maps, booleans, null, doubles."""

from __future__ import annotations

import struct


class CborError(ValueError):
    """Bytes that aren't one canonical value."""


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size, limit in ((24, "B", 1 << 8), (25, "H", 1 << 16), (26, "I", 1 << 32), (27, "Q", 1 << 64)):
        if n < limit:
            return bytes([major << 5 | code]) + struct.pack(">" + size, n)
    raise CborError("an integer beyond 64 bits")


def dumps(value) -> bytes:
    if value is None or value is True or value is False:
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(dumps, value))
    if isinstance(value, dict):
        pairs = sorted(((dumps(k), dumps(v)) for k, v in value.items()), key=lambda p: (len(p[0]), p[0]))
        return head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    raise CborError(f"no CBOR for {type(value).__name__}")


def read(data: bytes, at: int):
    """(value, next place)."""
    if at >= len(data):
        raise CborError("truncated")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if info in (20, 21, 22):
            return {20: False, 21: True, 22: None}[info], at
        if info == 27 and at + 8 <= len(data):
            return struct.unpack_from(">d", data, at)[0], at + 8
        raise CborError("unsupported simple value")
    if info < 24:
        n = info
    elif info <= 27:
        size = 1 << (info - 24)
        if at + size > len(data):
            raise CborError("truncated")
        n = int.from_bytes(data[at : at + size], "big")
        at += size
    else:
        raise CborError("indefinite lengths aren't canonical")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(data):
            raise CborError("truncated")
        raw = data[at : at + n]
        try:
            return (raw if major == 2 else raw.decode()), at + n
        except UnicodeDecodeError as e:
            raise CborError("text that isn't UTF-8") from e
    if major == 4:
        out = []
        for _ in range(n):
            value, at = read(data, at)
            out.append(value)
        return out, at
    if major == 5:
        pairs = {}
        for _ in range(n):
            key, at = read(data, at)
            value, at = read(data, at)
            if isinstance(key, (list, dict)) or key in pairs:
                raise CborError("a map key that repeats or isn't simple")
            pairs[key] = value
        return pairs, at
    raise CborError("tags aren't supported")


def loads(data: bytes):
    """One value and nothing after it, written the one canonical way."""
    value, at = read(data, 0)
    if at != len(data):
        raise CborError("trailing bytes")
    if dumps(value) != data:
        raise CborError("not canonical")
    return value
