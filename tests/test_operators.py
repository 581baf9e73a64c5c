"""Forecasts, ladders, lifecycles, gaps, quality and metrics on small hand-worked cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clocks, ladders
from tidemark.operators import backfill, book, forecast, gaps, lifecycle, metrics, quality

S, GIB = 1_000_000_000, 1 << 30


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_window_rates_and_medians(spark):
    now = 100_000 * S
    rows = [("v", now - 3600 * S - 60 * S, 100, 90, 0)] + [("v", now - 3000 * S + n * 600 * S, 100, 80 - n * 6, n) for n in range(6)]
    got = {r.window: r for r in forecast.window_rates(frame(spark, rows, "scope string, observed_at_utc_ns bigint, total_bytes bigint, free_bytes bigint, id int"), ["scope"], now, tie=["id"]).collect()}
    one = got["1h"]
    assert (one.sample_count, one.status) == (7, "AVAILABLE") and one.bytes_per_second == 0.01
    assert got["6h"].status == "INSUFFICIENT_DATA" and got["6h"].bytes_per_second is None


def test_a_window_without_cover_or_fresh_samples(spark):
    now = 100_000 * S
    late = [("v", now - 3500 * S, 100, 9, 0), ("v", now - 800 * S, 100, 5, 1)]
    resized = [("w", now - 3500 * S, 100, 9, 0), ("w", now, 200, 5, 1)]
    out = forecast.window_rates(frame(spark, late + resized, "scope string, observed_at_utc_ns bigint, total_bytes bigint, free_bytes bigint, id int"), ["scope"], now).where("window = '1h'").collect()
    assert {r.scope: r.status for r in out} == {"v": "INSUFFICIENT_DATA", "w": "INSUFFICIENT_DATA"}


def test_forecast_rows(spark):
    now = 100_000 * S
    rows = [("v", now - (6 - n) * 600 * S, 1000 * GIB, 500 * GIB - n * GIB) for n in range(7)]
    got = {r.threshold: r for r in forecast.forecast(frame(spark, rows, "scope string, observed_at_utc_ns bigint, total_bytes bigint, free_bytes bigint"), ["scope"], now).collect()}
    assert got["exhausted"].status == "FORECAST" and got["exhausted"].eta_ns > now and got["emergency"].threshold_bytes == 50 * GIB


def test_ladders(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    L = F.lit
    assert value(ladders.space_severity(L(100 * GIB), L(10 * GIB))) == "EMERGENCY"
    assert value(ladders.space_severity(L(1000 * GIB), L(150 * GIB))) == "CRITICAL"
    assert value(ladders.space_severity(L(1000 * GIB), L(400 * GIB))) == "WARNING"
    assert value(ladders.space_severity(L(1000 * GIB), L(400 * GIB + 1))) == "OK"
    assert value(ladders.space_severity(L(5), L(6))) is None
    assert value(ladders.worst(L("WARNING"), L("EMERGENCY"), L("NORMAL"))) == "EMERGENCY"
    assert value(ladders.eta(L(1), L(10), L(5), L(1e-300))[0]) == "BEYOND_SUPPORTED_RANGE"
    assert value(ladders.request_weight(L(0))) is None and value(ladders.request_weight(L(101))) == 25
    assert value(ladders.heartbeat_error(L(31 * S), L(10.0))) == "service_heartbeat_stale"
    assert value(ladders.heartbeat_error(L(-6 * S), L(10.0))) == "heartbeat_in_future" and value(ladders.heartbeat_error(L(30 * S), L(1.0))) is None
    status = lambda **k: value(ladders.application_status(*(L(v) for v in ({"active": "active", "error": None, "fresh": True, "service": 7, "seen": 7, "observed": "RUNNING"} | k).values())))
    assert [status(), status(active="failed"), status(active="idle"), status(fresh=False), status(seen=8), status(seen=None, service=None), status(error="x"), status(observed=None)] == ["RUNNING", "FAILED", "NOT_RUNNING", "STALE", "UNTRUSTED", "UNTRUSTED", "UNKNOWN", "UNKNOWN"]
    assert [value(ladders.canonical_decimal(ladders.decimal_of(L(t), False))) for t in ("1.500", "0.0", "100", "x", "-1")] == ["1.5", "0", "100", None, None]
    assert [value(ladders.is_safe_path(L(p))) for p in ("a/b", "/a", "a/../b", "", "a//b")] == [True, False, False, False, False]
    assert value(ladders.is_sha256(L("a" * 64))) and not value(ladders.is_sha256(L("A" * 64)))
    assert value(ladders.error_kind(L(""))) is None and value(ladders.error_kind(L("ArchiveError x"))) == "ARCHIVE_ERROR"


def test_clocks(spark):
    one = spark.range(1)
    ns = 1_767_225_600_000_000_000 + 86_399_999_999_999
    r = one.select(clocks.utc_date(F.lit(ns)).alias("d"), clocks.utc_hour(F.lit(ns)).alias("h"), clocks.closed_period(F.lit(899_999)).alias("p"), clocks.receive_lag(F.lit(5), F.lit(1)).alias("l"), clocks.floor_div(F.lit(-1), 10).alias("f"), clocks.next_month(F.lit(date(2024, 1, 31))).alias("m"), clocks.month_end(F.lit(date(2024, 2, 1))).alias("e")).first()
    assert (r.d, r.h, r.p, r.l, r.f, r.m, r.e) == ("2026-01-01", 23, 300_000, None, -1, date(2024, 2, 1), date(2024, 2, 29))
    a, b = one.select(*(c.alias(n) for n, c in zip("ab", clocks.day_bounds(F.lit("2026-01-01")), strict=True))).first()
    assert a <= ns < b


def test_chunk_statistics_and_completeness(spark):
    rows = [("k", n, "c1" if n < 2 else "c2", "i", 10 + n, n, None, None, None, {"u": str(n)} if n else {"u": '"x"'}, ["f"] if n else []) for n in range(4)]
    f = frame(spark, rows, "chunk_id string, source_record_ordinal bigint, connection_id string, collector_instance_id string, receive_time_utc_ns bigint, receive_monotonic_ns bigint, exchange_event_time bigint, exchange_transaction_time bigint, exchange_trade_time bigint, source_sequence map<string,string>, capture_flags array<string>")
    s = quality.chunk_statistics(f, ["chunk_id"]).first()
    assert s.record_count == 4 and s.capture_flags == ["f", "mixed_sequence_type"] and s.connection_ids == ["c1", "c2"] and s.sequences[0][1:] == (1, 3)
    t = quality.transitions(f, ["chunk_id"], ["source_record_ordinal"]).collect()
    assert [(r.old_connection, r.new_connection) for r in t] == [("c1", "c2")]
    chunk = frame(spark, [("k", ["c1", "c2"], ["f"])], "chunk_id string, connection_ids array<string>, capture_flags array<string>")
    done = quality.completeness(chunk, F.lit(True)).first()
    assert not done.complete and done.gap and "reconnect_gap" in done.capture_flags
    assert quality.completeness(chunk, F.lit(False)).first().complete


@pytest.mark.parametrize("old, new, ok", [(["sequence_gap"], [], True), (["blue_green_overlap"], [], False), (["blue_green_overlap"], ["blue_green_overlap"], True), (["blue_green_overlap", "deployment_id=a"], ["blue_green_overlap", "deployment_id=b"], False), (["blue_green_overlap", "deployment_id=a"], ["blue_green_overlap", "deployment_id=a"], True)])
def test_boundary_proof(spark, old, new, ok):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(quality.proven(arr(old), arr(new)).alias("x")).first().x is ok


def test_boundaries_gather_empty_chunks(spark):
    rows = [("s", 1, "a", "x", "x", 5), ("s", 2, "b", None, None, 0), ("s", 3, "c", None, None, 0), ("s", 4, "d", "y", "y", 5), ("s", 5, "e", "y", "y", 1)]
    out = quality.boundaries(frame(spark, rows, "stream string, at int, chunk_id string, first_connection string, last_connection string, record_count bigint"), ["stream"], ["at"]).orderBy("at").collect()
    assert [(r.previous_chunk, r.chunk_id, r.is_transition) for r in out] == [("a", "d", True), ("d", "e", False)]
    assert out[0].markers == ["b", "c"] and out[1].markers == []


def test_gaps_without_names(spark):
    rows = [("STARTED", "m", "s", None, 1), ("STARTED", "m", "s", "g", 2), ("COMPLETED", "m", "s", "g", 3), ("STARTED", "m", "s", "h", 4)]
    e = frame(spark, rows, "kind string, market string, stream string, gap_id string, at_ns bigint")
    assert gaps.open_gaps(e).count() == 1 and gaps.open_gaps(e, keep_unnamed=True).count() == 2


@pytest.mark.parametrize("intervals, expected", [
    ([("g", 0, 9, "a", "b")], ("MATCHED", "EXACT_PAIR", "g")), ([("g", 0, None, "a", "b")], ("PENDING", "PARTIAL_OLD", "g")), ([("g", 0, 9, "a", "b"), ("h", 0, 9, "a", "b")], ("AMBIGUOUS", "AMBIGUOUS", None)),
    ([("g", 0, 9, "a", "z"), ("t", 0, 9, "q", "r")], ("MATCHED", "PARTIAL_OLD", "g")), ([("t", 0, 9, "q", "r"), ("u", 0, 9, "q", "r")], ("AMBIGUOUS", "AMBIGUOUS", None)), ([("t", 4, 6, "q", "r")], ("MATCHED", "TIME_ONLY", "t")), ([("t", 6, 9, "q", "r")], ("UNMATCHED", "NONE", None)),
])
def test_interval_strength(spark, intervals, expected):
    t = frame(spark, [("m", "s", 1, 5, "a", "b")], "market string, stream string, id int, at_ns bigint, old_connection string, new_connection string")
    g = [("m", "s", i, a, b, o, None if b is None else n) for i, a, b, o, n in intervals]
    out = gaps.match_intervals(t, frame(spark, g, "market string, stream string, gap_id string, started_at_ns bigint, ended_at_ns bigint, original_connection string, new_connection string"), ["market", "stream"], 3).first()
    assert (out.match, out.identity_match, out.gap_id) == expected


def test_percentiles_round_up(spark):
    counts = frame(spark, [("a", "1000", 1), ("a", "overflow", 1), ("b", "10000", 99), ("b", "60000000000", 1)], "k string, bucket string, n bigint")
    got = {r.k: (r.p50, r.p99) for r in metrics.percentile(counts, ["k"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (1000, 60_000_000_000), "b": (10_000, 10_000)}
    waits = frame(spark, [("a", "100000", 0), ("b", "overflow", 3)], "k string, bucket string, n bigint")
    assert {r.k: r.p for r in metrics.wait_percentile(waits, ["k"], {"p": 0.5}).collect()} == {"a": "INSUFFICIENT_DATA", "b": "overflow"}


def test_metric_counters_and_merge(spark):
    from test_parse import PAYLOADS, envelopes

    e = envelopes(spark, [("spot", "diff_depth", PAYLOADS["spot", "diff_depth"], {}), ("spot", "diff_depth", b"{", {"capture_flags": ["malformed", "sequence_gap"]}), ("spot", "agg_trade", PAYLOADS["spot", "agg_trade"], {"module": "x.rest.v1"})])
    got = {r.stream: r for r in metrics.envelope_counters(e).collect()}
    d = got["diff_depth"]
    assert (d.accepted, d.malformed, d.sequence_gap, d.depth_bid_level_updates, d.depth_ask_level_updates, d.websocket_messages) == (1, 1, 1, 2, 0, 2)
    assert (got["agg_trade"].rest_responses, got["agg_trade"].websocket_payload_bytes, got["agg_trade"].agg_trade_records) == (1, 0, 1)
    b = frame(spark, [("d", 1, 5, 7, 2, 1, "x"), ("d", 2, 3, 9, 1, 2, "y")], "k string, n bigint, first bigint, last bigint, depth_max bigint, committed_at_ns bigint, batch_id string").withColumn("depth_last", F.col("depth_max"))
    m = metrics.merge(b, ["k"], ["n"], ("first",), ("last",), ("depth",)).first()
    assert (m.n, m.first, m.last, m.depth_max, m.depth_last) == (3, 3, 9, 2, 1)


def test_backfill(spark):
    with pytest.raises(ValueError):
        backfill.plan(spark, date(2024, 2, 1), date(2024, 1, 1), [])
    p = backfill.plan(spark, date(2024, 2, 1), date(2024, 3, 1), [("klines", 10)])
    assert sorted((r.granularity, str(r.first_day)) for r in p.collect()) == [("daily", "2024-03-01"), ("monthly", "2024-02-01")]
    assert backfill.totals(p).first().estimated_bytes == 300
    seen = frame(spark, [("k", 600_000)], "kind string, period_ms bigint")
    late = backfill.recovery_gaps(seen, ["kind"], now_ms=1_800_000, retention_ms=800_000).orderBy("period_ms").collect()
    assert [(r.period_ms, r.event) for r in late] == [(900_000, "SIDE_DATA_UNRECOVERABLE_GAP"), (1_200_000, "SIDE_DATA_CATCH_UP"), (1_500_000, "SIDE_DATA_CATCH_UP")]


def test_lifecycle_pieces(spark):
    chunks = frame(spark, [("a", "m", "s", "SEALED", 5), ("b", "m", "t", "ACTIVE", 9)], "chunk_id string, market string, stream string, state string, last_receive_ns bigint")
    flags = lifecycle.seal_flags(chunks, frame(spark, [("a", ["x"])], "chunk_id string, forced_flags array<string>"), frame(spark, [("m", "s"), ("m", "s")], "market string, stream string"))
    got = {r.chunk_id: (r.flags, r.conflict) for r in flags.collect()}
    assert got == {"a": (["reconnect_gap", "x"], True), "b": ([], False)}
    assert lifecycle.status_summary(chunks, 10, True).first().last_event_age_ns == 1 and lifecycle.status_summary(chunks, 10, False).first().last_event_age_ns is None
    targets = frame(spark, [("d1",), ("d2",)], "storage_id string")
    busy = lifecycle.eject_blocked(targets, frame(spark, [("d1", "COPYING"), ("d2", "VERIFIED")], "storage_id string, state string"))
    assert [r.storage_id for r in busy.collect()] == ["d1"]
    reason = spark.range(1).select(lifecycle.first_reason((F.lit(False), "FAILED", "a"), (F.lit(True), "NOT_READY", "b"), (F.lit(True), "FAILED", "c")).alias("r")).first().r
    assert (reason.state, reason.reason) == ("NOT_READY", "b")
    assert lifecycle.select_by(chunks, state="SEALED", market=None).count() == 1


def test_canonical_sides(spark):
    b = frame(spark, [("bid", 1, 5), ("bid", 3, 6), ("ask", 9, 1), ("ask", 7, 2)], "side string, price int, quantity int").withColumn("symbol", F.lit("x"))
    r = book.canonical_sides(b, ["symbol"], depth=1).first()
    assert ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) == ([(3, 6)], [(7, 2)])


def test_response_contract(spark):
    rows = [("a", 0, 300, 300, 900), ("a", 1, 600, 300, 900), ("b", 0, 300, 300, 900), ("b", 1, 900, 300, 900), ("c", 0, 0, 300, 900)]
    p = frame(spark, rows, "id string, position int, at bigint, start bigint, end bigint")
    assert {r.id: r.accepted for r in quality.response_contract(p, ["id"], "at", "start", "end", 300).collect()} == {"a": True, "b": False, "c": False}
    assert {r.id: r.accepted for r in quality.response_contract(p, ["id"], "at", "start", "end", 300, leading=1).collect()}["c"] is True
