"""The order-book machine: bridging, gaps, resynchronisation, checkpoints, and its run over DataFrames."""

import json
import random

import pytest

from tidemark.operators import book
from tidemark.operators.book import Machine, decimal, plain


def update(first, final, previous=None, bids=(), asks=(), at=0):
    return {"first": first, "final": final, "previous": previous, "bids": list(bids), "asks": list(asks), "at": at}


B, A = [["100", "1"]], [["101", "1"]]


def test_spot_bridge_gap_and_resync():
    m = Machine(spot=True)
    assert m.snapshot(157, B, A, 0) == "NEED_MORE_EVENTS"
    assert m.offer(update(150, 156)) == "BUFFERED"
    assert m.snapshot(157, B, A, 0) == "NEED_MORE_EVENTS" and m.buffer == []
    m.offer(update(160, 161))
    assert m.snapshot(157, B, A, 0) == "SNAPSHOT_TOO_OLD"
    m.buffer = []
    m.offer(update(157, 160, bids=[["100", "2"]]))
    assert m.snapshot(157, B, A, 0) == "SYNCHRONIZED" and m.update_id == 160
    assert m.offer(update(1, 160)) == "APPLIED" and m.audits[-1][0] == "duplicate_or_stale_depth"  # stale goes before the gap test
    assert m.offer(update(162, 163)) == "SEQUENCE_GAP" and not m.complete
    assert m.snapshot(162, B, A, 9) == "SYNCHRONIZED"
    assert m.gaps[-1]["ended_at_update_id"] == 163 and not m.complete  # closed, and still never complete
    assert m.audits[-1][0] == "orderbook_resync"


def test_futures_predecessor():
    m = Machine(spot=False)
    m.offer(update(157, 160, 149))
    assert m.snapshot(157, B, A, 0) == "SYNCHRONIZED"  # the bridging update needs no predecessor
    assert m.offer(update(161, 165, 160)) == "APPLIED"
    assert m.offer(update(166, 170, 164)) == "SEQUENCE_GAP"


def test_levels_and_audits():
    m = Machine(spot=True)
    m.offer(update(1, 2, asks=[["101", "0"], ["100", "1"]]))
    m.snapshot(1, B, A, 0)
    assert m.audits[-1][0] == "crossed_book"
    m.offer(update(3, 3, bids=[["100", "0"]]))
    assert m.audits[-1][0] == "empty_book_side"
    m.offer(update(4, 4, bids=[["99.50", "1"], ["99.50", "3.0"]]))
    assert m.document()["bids"] == [["99.5", "3"]]  # a later repeat wins
    for bad, positive in (("NaN", True), ("0", True), ("-1", False), ("x", False)):
        with pytest.raises(ValueError):
            decimal(bad, positive)
    assert plain(decimal("100.00", True)) == "100" and plain(decimal("0.000", False)) == "0"


def test_checkpoint_equals_origin():
    a = Machine(spot=True)
    a.offer(update(1, 2))
    a.snapshot(1, B, A, 0)
    b = Machine.restore(a.checkpoint())
    for m in (a, b):
        m.offer(update(3, 4, bids=[["98", "7"]]))
    assert a.logical_sha256() == b.logical_sha256()
    with pytest.raises(ValueError):
        Machine.restore(a.checkpoint().replace('"98"', '"97"'))


@pytest.mark.parametrize("spot", [True, False])
@pytest.mark.parametrize("seed", range(10))
def test_a_lost_update_never_looks_complete(spot, seed):
    rng = random.Random(seed)
    updates, last = [], 10
    for _ in range(30):
        size = rng.randint(1, 4)
        updates.append(update(last + 1, last + size, last, bids=[["100", str(rng.randint(1, 9))]]))
        last += size
    lost = rng.randint(1, len(updates) - 2)
    m = Machine(spot)
    m.offer(updates[0])
    assert m.snapshot(10 if spot else updates[0]["first"], B, A, 0) == "SYNCHRONIZED"
    results = [m.offer(u) for k, u in enumerate(updates[1:], 1) if k != lost]
    assert "SEQUENCE_GAP" in results and not m.complete


def test_overflow_refuses_until_restarted():
    m = Machine(spot=True)
    assert {m.offer(update(n, n)) for n in range(book.BUFFER)} == {"BUFFERED"}
    assert m.offer(update(8192, 8193, at=5)) == "REFUSED" == m.offer(update(9000, 9001)) and m.buffer == []
    assert [a[:2] for a in m.audits] == [("bootstrap_buffer_near_capacity", 6143), ("bootstrap_buffer_overflow", 8193)]
    assert m.snapshot(8999, B, A, 0) == "NEED_MORE_EVENTS"
    m.restart()
    m.offer(update(9002, 9003))
    assert m.snapshot(9001, B, A, 0) == "SYNCHRONIZED" and m.update_id == 9003
    m.offer(update(1, 7, at=3))
    assert m.audits[-1] == ("duplicate_or_stale_depth", 7, 3)


def test_tickers():
    m = Machine(spot=True)
    assert m.compare(2, ("1", "1"), ("2", "1"), 0) == "UNAVAILABLE"
    m.offer(update(1, 2))
    m.snapshot(1, B, A, 0)
    assert [m.compare(n, ("100.0", "1"), ("101", "1.00"), 0) for n in (1, 2, 3)] == ["STALE", "MATCH", "AHEAD"]
    assert m.compare(2, ("100", "2"), ("101", "1"), 4) == "MISMATCH" and m.audits[-1] == ("book_ticker_mismatch", 2, 4)


def test_run_over_frames_equals_the_machine(spark):
    rows, n = [], 0
    for market in ("spot", "um_perpetual"):
        for k in range(40):
            rows.append((market, "BTCUSDT", "depth", n, k, 10 + k, 10 + k, 9 + k, json.dumps([[str(100 - k % 3), str(k % 4)]]), json.dumps([["105", "1"]])))
            n += 1
            if k == 5:
                rows.append((market, "BTCUSDT", "snapshot", n, k, None, 12, None, json.dumps(B), json.dumps(A)))
                n += 1
    schema = "market string, symbol string, kind string, receive_time_utc_ns bigint, ordinal bigint, first bigint, final bigint, previous bigint, bids_json string, asks_json string"
    got = {(r.market, r.receive_time_utc_ns): r for r in book.run_machine(spark.createDataFrame(rows, schema).repartition(6), hashes=True).collect()}
    assert len(got) == len(rows)
    for market in ("spot", "um_perpetual"):
        m = Machine(market == "spot")
        for r in (r for r in rows if r[0] == market):
            bids, asks = json.loads(r[8]), json.loads(r[9])
            result = m.snapshot(r[6], bids, asks, r[3]) if r[2] == "snapshot" else m.offer(update(r[5], r[6], r[7], bids, asks, r[3]))
            assert (got[market, r[3]].result, got[market, r[3]].logical_sha256) == (result, m.logical_sha256())
    assert got["spot", n // 2 - 1].complete


def test_readiness(spark):
    rows = [("spot", s, True, s != "agg_trade", True, True) for s in ("diff_depth", "agg_trade", "book_ticker")]
    df = spark.createDataFrame(rows + [("um", s, True, True, True, True) for s in ("diff_depth", "agg_trade", "book_ticker")], "market string, stream string, connected boolean, persisted boolean, snapshot boolean, synchronized boolean")
    assert {r.market: r.ready for r in book.readiness(df, ["market"]).collect()} == {"spot": False, "um": True}
