"""Strict parsing of every stream, and normalized identities."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.dedup import build_totals, deduplicate_events, partition_statistics
from tidemark.operators.parse import parse, parse_stream

T0 = 1_767_225_600_000_000_000
LEVELS = [["100.10", "1.5"], ["99", "0"]]


def canonical(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def rest(model, **parameters):
    return {"schema_version": "v1", "request": {"path": "/x", "parameters": parameters, "request_time_utc_ns": T0}, "response": {"status": 200, "headers": {}, "model": model}, "transport": {}}


FIVE = {"symbol": "BTCUSDT", "pair": "BTCUSDT", "timestamp": 300000, "sumOpenInterest": "1", "sumOpenInterestValue": "2", "buySellRatio": "1", "buyVol": "2", "sellVol": "3", "longShortRatio": "1", "longAccount": "0.5", "shortAccount": "0.5", "contractType": "PERPETUAL", "indexPrice": "1", "futuresPrice": "1", "basis": "0.1", "basisRate": "0.01", "annualizedBasisRate": ""}
SYMBOL = {"symbol": "BTCUSDT", "status": "TRADING", "contractType": "PERPETUAL", "filters": [{"b": 1, "a": "x"}], "orderTypes": ["LIMIT"]}
PAYLOADS = {
    ("spot", "diff_depth"): {"e": "depthUpdate", "E": 1, "s": "BTCUSDT", "U": 7101, "u": 7104, "b": LEVELS, "a": []},
    ("spot", "agg_trade"): {"e": "aggTrade", "E": 1, "s": "BTCUSDT", "a": 8801, "p": "0.001", "q": "100", "f": 100, "l": 105, "T": 2, "m": True, "M": True},
    ("spot", "book_ticker"): {"u": 8803, "s": "BTCUSDT", "b": "7.5", "B": "3.5", "a": "7.6", "A": "2.5"},
    ("spot", "depth_snapshot"): rest({"lastUpdateId": 7101, "bids": LEVELS, "asks": LEVELS}),
    ("spot", "exchange_info"): rest({"serverTime": 5, "symbols": [SYMBOL], "rateLimits": []}),
    ("um_perpetual", "diff_depth"): {"e": "depthUpdate", "E": 1, "T": 2, "s": "BTCUSDT", "U": 7101, "u": 7104, "pu": 7093, "b": LEVELS, "a": LEVELS},
    ("um_perpetual", "agg_trade"): {"e": "aggTrade", "E": 1, "s": "BTCUSDT", "a": 8802, "p": "0.001", "q": "100", "f": 100, "l": 105, "T": 2, "m": False},
    ("um_perpetual", "book_ticker"): {"e": "bookTicker", "u": 7, "E": 1, "T": 1, "s": "BTCUSDT", "b": "1", "B": "2", "a": "3", "A": "4"},
    ("um_perpetual", "depth_snapshot"): rest({"lastUpdateId": 7104, "bids": [], "asks": []}),
    ("um_perpetual", "mark_price"): {"e": "markPriceUpdate", "E": 9, "s": "BTCUSDT", "p": "1", "i": "2", "P": "3", "r": "0.0001", "T": 10},
    ("um_perpetual", "liquidation"): {"e": "forceOrder", "E": 9, "o": {"s": "BTCUSDT", "S": "SELL", "o": "LIMIT", "f": "IOC", "q": "0.25", "p": "4400", "ap": "4400", "X": "FILLED", "l": "0.25", "z": "0.25", "T": 8}},
    ("um_perpetual", "premium_index_snapshot"): rest({"symbol": "BTCUSDT", "markPrice": "1", "indexPrice": "1", "estimatedSettlePrice": "1", "lastFundingRate": "0", "interestRate": "0", "nextFundingTime": 3, "time": 4}),
    ("um_perpetual", "funding_history"): rest([{"symbol": "BTCUSDT", "fundingRate": "0.1", "fundingTime": 1}, {"symbol": "BTCUSDT", "fundingRate": "0.2", "fundingTime": 2, "markPrice": "5"}]),
    ("um_perpetual", "funding_info"): rest([{"symbol": "OTHER"}]),
    ("um_perpetual", "open_interest"): rest({"openInterest": "10", "symbol": "BTCUSDT", "time": 4}),
    ("um_perpetual", "exchange_info"): rest({"serverTime": 5, "symbols": [SYMBOL], "rateLimits": [{"limit": 1}]}),
    **{("um_perpetual", s): rest([FIVE]) for s in schemas.STREAMS["um_perpetual"].split() if s.endswith("_5m")},
}


def envelopes(spark, rows):
    """rows: (market, stream, payload or bytes, changes)."""
    out = []
    for n, (market, stream, payload, changes) in enumerate(rows):
        raw = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
        base = {"schema_version": "event-envelope.v1", "venue": "x", "market": market, "symbol": "BTCUSDT", "stream": stream, "module": "x.spot.v1", "connection_id": "c1", "collector_instance_id": "k1", "collector_version": "1", "receive_time_utc_ns": T0 + n, "receive_monotonic_ns": n, "exchange_event_time": 1_500, "exchange_transaction_time": None, "exchange_trade_time": None, "source_sequence": {"u": "1"}, "payload_encoding": "utf-8-json", "raw_payload": bytearray(raw), "capture_flags": [], "source_chunk_id": "chunk", "source_chunk_sha256": "aa", "source_record_ordinal": n, "source_complete": True, "source_gap": False, "source_resync": False, "source_recovered": False, "source_capture_flags": []}
        row = base | changes
        out.append(tuple(row[f.name] for f in [*schemas.ENVELOPE.fields, *schemas.SOURCE.fields]))
    return spark.createDataFrame(out, type(schemas.ENVELOPE)([*schemas.ENVELOPE.fields, *schemas.SOURCE.fields]))


def test_every_stream_parses(spark):
    assert set(PAYLOADS) == set(schemas.supported())
    rows = parse(envelopes(spark, [(m, s, p, {}) for (m, s), p in PAYLOADS.items()]).coalesce(1)).select("market", "stream", "valid", "error_code", "event_kind", "symbol_present", "source_subrecord_ordinal").collect()
    assert [r for r in rows if not r.valid] == []
    assert len(rows) == len(PAYLOADS) + 1  # funding history has two items
    info = next(r for r in rows if r.stream == "funding_info")
    assert info.symbol_present is False  # another symbol alone is an observation of absence


def test_identity_is_canonical_json(spark):
    row = parse_stream(envelopes(spark, [("spot", "diff_depth", PAYLOADS["spot", "diff_depth"], {})]), "spot", "diff_depth").first()
    identity = {"kind": "diff_depth", "market": "spot", "symbol": "BTCUSDT", "U": 7101, "u": 7104}
    assert row.semantic_key_sha256 == hashlib.sha256(canonical(identity).encode()).hexdigest()
    content = {"first_update_id": 7101, "final_update_id": 7104, "previous_final_update_id": None, "bids_json": canonical(LEVELS), "asks_json": "[]"}
    whole = {"event_kind": "market_event", "valid": True, "error_code": None, "exchange_event_time_ms": 1500, "exchange_transaction_time_ms": None, "exchange_trade_time_ms": None, "content": content}
    assert row.logical_record_sha256 == hashlib.sha256(canonical(whole).encode()).hexdigest()
    assert (row.receive_date, row.receive_hour, row.source_sequence_json) == ("2026-01-01", 0, '{"u":1}')
    assert row.schema_version == "normalized-x-spot-diff-depth.v1"


def test_strict_types(spark):
    cases = [({"U": True}, "U must be a non-negative integer"), ({"u": -1}, "u must be a non-negative integer"), ({"U": 7105}, "depth U exceeds u"), ({"s": "X"}, "payload symbol differs from envelope"), ({"b": [["1"]]}, "b contains invalid price levels"), ({"b": [[1, "2"]]}, "b contains invalid price levels"), ({"a": None}, "a must be an array"), ({"U": "7101"}, "U must be a non-negative integer")]
    rows = parse_stream(envelopes(spark, [("spot", "diff_depth", PAYLOADS["spot", "diff_depth"] | c, {}) for c, _ in cases]), "spot", "diff_depth").orderBy("source_record_ordinal").collect()
    assert [(r.valid, r.error_code, r.event_kind, r.first_update_id) for r in rows] == [(False, f"SCHEMA_ERROR:{e}", "malformed", None) for _, e in cases]


def test_broken_payloads_stay(spark):
    rows = [("spot", "agg_trade", b"\xff{", {}), ("spot", "agg_trade", b"[1]", {}), ("spot", "agg_trade", b"{}", {"capture_flags": ["malformed"]}), ("um_perpetual", "funding_history", rest([{"symbol": "BTCUSDT"}]), {}), ("um_perpetual", "basis_5m", rest([], startTime=1, endTime=2), {}), ("spot", "diff_depth", {"e": "serverShutdown", "E": 7}, {})]
    streams = sorted({r[:2] for r in rows})
    found = {(r.stream, r.source_record_ordinal): r for r in parse(envelopes(spark, rows).coalesce(1), streams).collect()}
    assert found["agg_trade", 0].error_code == "SCHEMA_ERROR:payload is not valid UTF-8 JSON"
    assert found["agg_trade", 1].error_code == "SCHEMA_ERROR:payload must be an object"
    assert found["agg_trade", 2].error_code == "UPSTREAM_MALFORMED"
    assert found["funding_history", 3].observation_empty is False and not found["funding_history", 3].valid
    assert found["basis_5m", 4].observation_empty is True and found["basis_5m", 4].event_kind == "empty_observation"
    assert found["diff_depth", 5].event_kind == "server_shutdown" and found["diff_depth", 5].valid


def test_unsupported_stream_is_an_error(spark):
    with pytest.raises(schemas.UnsupportedStream):
        parse(envelopes(spark, [("spot", "mark_price", {}, {})]))


def test_dedup_keeps_conflicts_and_lineage(spark):
    trade = PAYLOADS["spot", "agg_trade"]
    rows = [("spot", "agg_trade", trade, {}), ("spot", "agg_trade", trade, {"connection_id": "c2"}), ("spot", "agg_trade", trade | {"p": "9"}, {}), ("spot", "agg_trade", b"{", {}), ("um_perpetual", "agg_trade", b"{", {})]
    candidates = parse(envelopes(spark, rows).coalesce(1), [("spot", "agg_trade"), ("um_perpetual", "agg_trade")]).cache()
    out = deduplicate_events(candidates)
    got = sorted((r.valid, r.identity_conflict, r.duplicate_count, len(json.loads(r.duplicate_sources_json))) for r in out.collect())
    assert got == [(False, False, 2, 2), (True, True, 1, 1), (True, True, 2, 2)]  # malformed bytes of two markets are one row
    assert deduplicate_events(candidates, scope="stream").where("not valid").count() == 2
    totals = build_totals(partition_statistics(out)).first()
    assert (totals.row_count, totals.input_candidate_count, totals.identity_conflicts) == (3, 5, 2)
    shuffled = deduplicate_events(candidates.orderBy(F.rand(3)).repartition(7)).select(sorted(out.columns))
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, out.select(sorted(out.columns)).collect()))
