"""Batches, transitions and checksums: each repeat is nothing, each contradiction an error."""

import random

import pytest

from tidemark.functions.identity import BYTES, crc32c_of
from tidemark.operators import gaps
from tidemark.sinks.tables import Conflict, append_new, apply_transitions


def test_whole_batches(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "batch_id string, stream string, n int")
    known = rows(("a", "x", 1))
    new = append_new(rows(("a", "x", 1), ("a", "y", 9), ("b", "x", 1), ("b", "y", 2), ("b", "y", 2)), known)
    assert sorted(map(tuple, new.collect())) == [("b", "x", 1), ("b", "y", 2), ("b", "y", 2)]


ALLOWED = [("ACTIVE", "SEALING"), ("SEALING", "SEALED"), ("ACTIVE", "QUARANTINED")]


def test_chains_of_transitions(spark):
    current = spark.createDataFrame([("c", "ACTIVE"), ("d", "SEALING"), ("e", "ACTIVE")], "chunk string, state string")
    allowed = spark.createDataFrame(ALLOWED, "from_state string, to_state string")
    log = spark.createDataFrame([("d", "k0")], "chunk string, idempotency_key string")
    asked = lambda *r: spark.createDataFrame(list(r), "chunk string, from_state string, to_state string, idempotency_key string, requested_at_ns bigint")
    apply = lambda *r: apply_transitions(asked(*r), current, allowed, "chunk", log)
    states, rows = apply(("c", "SEALING", "SEALED", "k2", 2), ("c", "ACTIVE", "SEALING", "k1", 1), ("c", "ACTIVE", "SEALING", "k1", 5), ("d", "ACTIVE", "SEALING", "k0", 0))
    assert sorted(map(tuple, states.collect())) == [("c", "SEALED"), ("d", "SEALING"), ("e", "ACTIVE")]
    assert sorted((r.chunk, r.from_state, r.to_state, r.idempotency_key) for r in rows.collect()) == [("c", "ACTIVE", "SEALING", "k1"), ("c", "SEALING", "SEALED", "k2")]
    for bad in (
        [("c", "ACTIVE", "SEALING", "k1", 1), ("c", "ACTIVE", "QUARANTINED", "k2", 2)], [("c", "ACTIVE", "SEALED", "k1", 1)],
        [("x", "ACTIVE", "SEALING", "k1", 1)], [("c", "ACTIVE", "SEALING", "k1", 1), ("e", "ACTIVE", "SEALING", "k1", 1)],
    ):
        with pytest.raises(Conflict):
            apply(*bad)


def test_checksums():
    def slow(data, value=0):
        value ^= 0xFFFFFFFF
        for b in data:
            value = int(BYTES[(value ^ b) & 255]) ^ value >> 8
        return value ^ 0xFFFFFFFF

    rng = random.Random(1)
    assert crc32c_of(b"123456789") == 0xE3069283
    for size in (0, 1, 2, 255, 2047, 2048, 2049, 5000, 70_001):
        data = rng.randbytes(size)
        assert crc32c_of(data) == slow(data) and crc32c_of(data, slow(b"abc")) == slow(b"abc" + data)


def test_kinds_of_transitions(spark):
    gap, both, mine = ["sequence_gap"], ["blue_green_overlap"], ["blue_green_overlap", "deployment_id=1"]
    runs = [
        ([("a", []), ("a", gap), ("b", [])], "EXPLICIT_SEQUENCE_GAP"), ([("a", []), ("b", gap)], "EXPLICIT_SEQUENCE_GAP"), ([("a", gap), ("b", [])], "UNKNOWN"),
        ([("a", []), ("a", both), ("b", both)], "BLUE_GREEN_OVERLAP"), ([("a", both), ("b", mine)], "UNMARKED_RECONNECT"), ([("a", mine), ("b", mine)], "BLUE_GREEN_OVERLAP"),
        ([("a", []), ("b", None)], "UNMARKED_RECONNECT"),
    ]
    frames = spark.createDataFrame([(f"s{n}", k, c, f) for n, (run, _) in enumerate(runs) for k, (c, f) in enumerate(run)], "stream string, at bigint, connection_id string, capture_flags array<string>")
    moves = gaps.frame_transitions(frames, ["stream"], ["at"])
    kinds = gaps.transition_kinds(moves)
    assert {r.stream: r.kind for r in kinds.collect()} == {f"s{n}": kind for n, (_, kind) in enumerate(runs)} and kinds.count() == len(runs)
    tally = gaps.kind_tallies(kinds.withColumn("all", gaps.F.lit(1)), ["all"]).first()
    assert tuple(tally)[1:] == (7, 2, 2, 2, 1)


def test_order_of_transitions(spark):
    rows = spark.createDataFrame([(2, "c", "d", "x", "y"), (1, "c", "d", "x", "z"), (1, "c", "d", None, "z"), (1, "b", "d", "x", "y")], "occurred_at_utc_ns bigint, old_chunk_id string, new_chunk_id string, old_connection_id string, new_connection_id string")
    assert [(r[0], r[1], r[3]) for r in gaps.transition_kinds(rows).collect()] == [(1, "b", "x"), (1, "c", None), (1, "c", "x"), (2, "c", "x")]
