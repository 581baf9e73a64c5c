"""Operational metrics: counters, fixed-bucket histograms, percentiles, mergeable batches and daily rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import receive_lag, utc_date
from ..functions.ladders import ladder

# Counters, gauges, histograms and their bounds in nanoseconds.
COUNTERS = """websocket_messages websocket_payload_bytes rest_responses depth_bid_level_updates depth_ask_level_updates agg_trade_records book_ticker_records
accepted duplicate malformed out_of_order sequence_gap orderbook_resync planned_reconnect unexpected_disconnect server_shutdown checksum_failure
raw_records_written raw_bytes_written sealed_chunks compressed_bytes archived_files archived_bytes deleted_local_bytes archive_backlog_bytes normalized_rows normalized_bytes""".split()
GAUGES = ("queue_depth", "cpu_percent", "rss_memory_bytes", "internal_free_bytes")
HISTOGRAMS = ("receive_lag_ns", "write_latency_ns", "fsync_latency_ns")
BOUNDS = (1_000, 10_000, 100_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 5_000_000_000, 10_000_000_000, 60_000_000_000)
WAIT_BOUNDS = (100_000, 1_000_000, 10_000_000, 100_000_000, 1_000_000_000, 5_000_000_000)
# End of fixed values.
OVERFLOW = "overflow"


def bucket(value: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """The name of the first bound that is not below a value; null for a negative or unknown one."""
    return F.when(value >= 0, ladder(*((value <= b, str(b)) for b in bounds), otherwise=OVERFLOW))


def envelope_counters(envelopes: DataFrame, frame_bytes: Column | None = None) -> DataFrame:
    """Additive counters, the lag histogram and receive bounds of each (UTC day, market, stream)."""
    rest = F.col("module").contains(".rest.") | F.col("module").contains(".side_rest.")
    flag = lambda f: F.array_contains("capture_flags", f)
    bad = flag("malformed")
    levels = lambda side: F.when((F.col("stream") == "diff_depth") & ~bad, F.json_array_length(F.get_json_object(F.try_validate_utf8(F.col("raw_payload").cast("string")), f"$.{side}")))
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    size = F.length("raw_payload").cast("bigint")
    rows = envelopes.withColumn("utc_date", utc_date(F.col("receive_time_utc_ns"))).withColumn("__lag", bucket(receive_lag(F.col("receive_time_utc_ns"), F.col("exchange_event_time"))))
    flags = ("duplicate", "out_of_order", "sequence_gap", "orderbook_resync", "server_shutdown", "checksum_failure")
    return rows.groupBy("utc_date", "market", "stream").agg(
        one(rest).alias("rest_responses"), one(~rest).alias("websocket_messages"), F.coalesce(F.sum(F.when(~rest, size)), F.lit(0)).alias("websocket_payload_bytes"),
        one(bad).alias("malformed"), one(~bad).alias("accepted"), *(one(flag(f)).alias(f) for f in flags),
        F.coalesce(F.sum(levels("b")), F.lit(0)).cast("bigint").alias("depth_bid_level_updates"), F.coalesce(F.sum(levels("a")), F.lit(0)).cast("bigint").alias("depth_ask_level_updates"),
        one((F.col("stream") == "agg_trade") & ~bad).alias("agg_trade_records"), one((F.col("stream") == "book_ticker") & ~bad).alias("book_ticker_records"),
        F.count("*").alias("raw_records_written"), F.sum(size if frame_bytes is None else frame_bytes).alias("raw_bytes_written"),
        F.min("receive_time_utc_ns").alias("first_event_time_utc_ns"), F.max("receive_time_utc_ns").alias("last_event_time_utc_ns"),
        *(one(F.col("__lag") == str(b)).alias(f"receive_lag_ns_{b}") for b in (*BOUNDS, OVERFLOW)),
    )


def merge(batches: DataFrame, by: list[str], counters: list[str], firsts: tuple[str, ...] = (), lasts: tuple[str, ...] = (), gauges: tuple[str, ...] = (), at: tuple[str, ...] = ("committed_at_ns", "batch_id")) -> DataFrame:
    """Batches merged: counters add up, first times are least, last ones greatest, gauges keep their maximum and the value committed last."""
    out = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters] + [F.min(c).alias(c) for c in firsts] + [F.max(c).alias(c) for c in lasts]
    for g in gauges:
        out += [F.max(f"{g}_max").alias(f"{g}_max"), F.max_by(f"{g}_last", F.struct(*at)).alias(f"{g}_last")]
    return batches.groupBy(*by).agg(*out)


def histogram(values: DataFrame, by: list[str], value: str, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Rows of each bucket; negative and unknown values are in none."""
    return values.select(*by, bucket(F.col(value), bounds).alias("bucket")).where("bucket is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def percentile(counts: DataFrame, by: list[str], shares: dict[str, float], bounds: tuple[int, ...] = BOUNDS, overflow: int | None = BOUNDS[-1]) -> DataFrame:
    """The first bound whose running count reaches a share of the total, rounded up; above the last bound: `overflow`
    (null says so by a null). A key has at most a row for each bound here, so the window is small."""
    limit = F.when(F.col("bucket") == OVERFLOW, F.lit(1 << 62)).otherwise(F.col("bucket").try_cast("bigint"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("__b", limit).withColumn("__run", F.sum("n").over(w.orderBy("__b"))).withColumn("__all", F.sum("n").over(w))
    target = lambda p: F.greatest(F.lit(1), F.floor(F.col("__all") * p + 0.999999999)).cast("bigint")
    value = lambda p: F.min(F.when(F.col("__run") >= target(p), F.col("__b")))
    return run.groupBy(*by).agg(*(F.when(value(p) == 1 << 62, F.lit(overflow)).otherwise(value(p)).alias(name) for name, p in shares.items()), F.max("__all").alias("total"))


def wait_percentile(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Queue waits: a bound as text, "overflow" above the last, "INSUFFICIENT_DATA" where there are none."""
    found = percentile(counts, by, shares, WAIT_BOUNDS, overflow=None)
    return found.select(*by, *(F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, "INSUFFICIENT_DATA").otherwise(F.coalesce(F.col(n).cast("string"), F.lit(OVERFLOW))).alias(n) for n in shares))


def daily_report(batches: DataFrame, day: str, authorized: DataFrame | None = None) -> DataFrame:
    """A day's counters of each (market, stream) beside those of its lifetime up to that day, and the archive backlog left.

    batches(utc_date, market, stream, counters...); authorized(utc_date, market, stream, deleted_local_bytes, archived_files,
    archived_bytes) are merged by day like any batch.
    """
    counters = [c for c in COUNTERS if c in batches.columns]
    own = batches.select("utc_date", "market", "stream", *counters)
    if authorized is not None:
        own = own.unionByName(authorized, allowMissingColumns=True)
    upto = own.where(F.col("utc_date") <= day)
    today = [F.coalesce(F.sum(F.when(F.col("utc_date") == day, F.col(c))), F.lit(0)).alias(c) for c in counters]
    life = [F.coalesce(F.sum(c), F.lit(0)).alias(f"lifetime_{c}") for c in counters]
    out = upto.groupBy("market", "stream").agg(*today, *life)
    if {"archive_backlog_bytes", "archived_bytes"} <= set(counters):
        out = out.withColumn("backlog_bytes", F.greatest(F.lit(0), F.col("lifetime_archive_backlog_bytes") - F.col("lifetime_archived_bytes")))
    return out.withColumn("current_rss_bytes_status", F.lit("INSUFFICIENT_DATA")).withColumn("peak_rss_bytes_status", F.lit("INSUFFICIENT_DATA"))
