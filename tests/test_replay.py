"""Replay policies on the seven-chunk example, dedup conservation and consumer digests."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.replay import ReplayError, ReplayQuery, consume, replay

BASE = 1_767_225_600_000_000_000


@pytest.fixture(scope="module")
def rows(spark):
    """(market, stream, receive offset ms, event ms, transaction ms, trade ms, id, final_update_id, gap)"""
    data = [("spot", "agg_trade", 20, 1500, None, 2000, 1, None, False), ("spot", "agg_trade", 10, 2500, None, 2000, 2, None, False), ("spot", "agg_trade", 5, 3500, None, 4000, 3, None, False), ("spot", "book_ticker", 30, None, None, None, 4, None, False), ("spot", "diff_depth", 40, 4000, None, None, 5, 160, False), ("spot", "diff_depth", 50, 5000, None, None, 6, 161, False), ("um_perpetual", "diff_depth", 60, 6000, 6100, None, 7, 160, True)]
    full = [(m, s, "BTCUSDT", BASE + o * 1_000_000, o, e, x, t, n, u, g, not g) for m, s, o, e, x, t, n, u, g in data]
    df = spark.createDataFrame(full, "market string, stream string, symbol string, receive_time_utc_ns bigint, receive_monotonic_ns bigint, exchange_event_time_ms bigint, exchange_transaction_time_ms bigint, exchange_trade_time_ms bigint, source_record_ordinal bigint, final_update_id bigint, source_gap boolean, source_complete boolean")
    return df.withColumns({"dataset_version": F.lit("normalized-dataset.v1"), "collector_instance_id": F.lit("k"), "connection_id": F.lit("c"), "source_sequence_json": F.lit("{}"), "source_chunk_sha256": F.lit("s"), "source_subrecord_ordinal": F.lit(0), "logical_record_sha256": F.sha2(F.col("source_record_ordinal").cast("string"), 256)})


def ids(df):
    return [r.source_record_ordinal for r in df.collect()]


def test_receive_order_and_gap_policies(rows):
    assert ids(replay(rows, ReplayQuery(gaps="include"))) == [3, 2, 1, 4, 5, 6, 7]
    assert ids(replay(rows, ReplayQuery(gaps="exclude"))) == [3, 2, 1, 4, 5, 6]
    with pytest.raises(ReplayError):
        replay(rows, ReplayQuery())
    assert ids(replay(rows, ReplayQuery(markets=("spot",)))) == [3, 2, 1, 4, 5, 6]


def test_exchange_clock(rows):
    with pytest.raises(ReplayError):
        replay(rows, ReplayQuery(clock="exchange", gaps="include"))
    assert ids(replay(rows, ReplayQuery(clock="exchange", gaps="include", missing_clock="exclude"))) == [2, 1, 3, 5, 6, 7]  # a tie goes by receipt
    found = replay(rows, ReplayQuery(clock="exchange", gaps="include", missing_clock="fallback_receive")).collect()
    assert [r.source_record_ordinal for r in found if r.used_receive_time_fallback] == [4]


def test_a_missing_clock_is_an_error_even_outside_the_range(rows):
    with pytest.raises(ReplayError):
        replay(rows, ReplayQuery(clock="exchange", gaps="include", start_ns=0, end_ns=1))


def test_stream_without_exchange_clock_fails_under_any_policy(rows):
    odd = rows.limit(1).withColumn("stream", F.lit("basis_5m"))
    with pytest.raises(ReplayError):
        replay(odd, ReplayQuery(clock="exchange", gaps="include", missing_clock="exclude"))


def test_half_open_range_and_checkpoint(rows):
    q = ReplayQuery(gaps="include", start_ns=BASE + 10_000_000, end_ns=BASE + 30_000_000)
    assert ids(replay(rows, q)) == [2, 1]
    assert ids(replay(rows, ReplayQuery(markets=("spot",), streams=("diff_depth",), after_update_id=160))) == [6]
    # the only unreliable row is one that the checkpoint covers
    assert ids(replay(rows, ReplayQuery(markets=("um_perpetual",), streams=("diff_depth",), after_update_id=160))) == []
    for bad in (dict(after_update_id=1), dict(after_update_id=1, streams=("diff_depth",)), dict(clock="x"), dict(start_ns=2, end_ns=2)):
        with pytest.raises(ReplayError):
            ReplayQuery(**bad)


def test_version_comes_first(rows):
    with pytest.raises(ReplayError):
        replay(rows.withColumn("dataset_version", F.lit("v9")), ReplayQuery(gaps="include", markets=("none",)))


def test_digest_doesnt_depend_on_dealing(rows):
    q = ReplayQuery(gaps="include")
    a, b = consume(replay(rows, q)), consume(replay(rows.repartition(5), q))
    assert a == b and a["events"] == 7 and consume(replay(rows, q), limit=2)["events"] == 2
