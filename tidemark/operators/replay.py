"""Deterministic replay: a selected clock, half-open ranges, policies for gaps and missing clocks, one total order."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import floor_div, ms_to_ns

# The exchange clocks of each stream, the first one that is there counts.
EXCHANGE_CLOCKS = {
    "diff_depth": "exchange_transaction_time_ms exchange_event_time_ms", "agg_trade": "exchange_trade_time_ms exchange_event_time_ms",
    "book_ticker": "exchange_transaction_time_ms exchange_event_time_ms", "depth_snapshot": "", "mark_price": "exchange_event_time_ms",
    "liquidation": "exchange_event_time_ms order_trade_time_ms", "premium_index_snapshot": "observation_time_ms", "funding_history": "funding_time_ms",
    "funding_info": "", "open_interest": "observation_time_ms", "exchange_info": "server_time_ms",
}
# End of fixed values.
ORDER = ("market", "stream", "symbol", "collector_instance_id", "connection_id", "receive_monotonic_ns", "source_sequence_json", "source_chunk_sha256", "source_record_ordinal", "source_subrecord_ordinal", "logical_record_sha256")


class ReplayError(ValueError):
    """A replay that its policies don't allow."""


@dataclass(frozen=True)
class ReplayQuery:
    clock: str = "receive"  # or "exchange"
    start_ns: int | None = None
    end_ns: int | None = None
    markets: tuple[str, ...] = ()
    streams: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    gaps: str = "error"  # or "include", "exclude"
    missing_clock: str = "error"  # or "exclude", "fallback_receive"
    after_update_id: int | None = None  # a checkpoint's; needs one market's diff_depth
    versions: tuple[str, ...] = field(default=("normalized-dataset.v1",))

    def __post_init__(self) -> None:
        if self.clock not in ("receive", "exchange") or self.gaps not in ("error", "include", "exclude") or self.missing_clock not in ("error", "exclude", "fallback_receive"):
            raise ReplayError("unknown clock or policy")
        if self.start_ns is not None and self.end_ns is not None and self.end_ns <= self.start_ns:
            raise ReplayError("an empty range")
        if self.after_update_id is not None and (self.streams != ("diff_depth",) or len(self.markets) != 1):
            raise ReplayError("a checkpoint needs diff_depth of one market")


def exchange_clock(columns: list[str]) -> Column:
    """Nanoseconds of a stream's exchange clock; null if none of its columns is there."""
    out = F.lit(None).cast("bigint")
    for stream, names in EXCHANGE_CLOCKS.items():
        if own := [F.col(n) for n in names.split() if n in columns]:
            out = F.when(F.col("stream") == stream, ms_to_ns(F.coalesce(*own))).otherwise(out)
    return out


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def wanted(query: ReplayQuery) -> Column:
    """Whose rows are asked for; an empty list asks for all."""
    return all_of(*(F.col(c).isin(*values) for c, values in (("market", query.markets), ("stream", query.streams), ("symbol", query.symbols)) if values))


def partition_range(query: ReplayQuery) -> Column:
    """What the receive range says about partition columns, so that the scan can skip files."""
    if query.clock != "receive":
        return F.lit(True)
    day = lambda ns: F.date_format(F.timestamp_micros(floor_div(F.lit(ns), 1_000)), "yyyy-MM-dd")
    low = [F.col("receive_date") >= day(query.start_ns)] if query.start_ns is not None else []
    high = [F.col("receive_date") <= day(query.end_ns - 1)] if query.end_ns is not None else []
    return all_of(*low, *high)


def raise_if(rows: DataFrame, bad: Column, message: str) -> None:
    """Policies that fail do so before a row is handed out: one existence check, which stops at the first."""
    if not rows.where(bad).limit(1).isEmpty():
        raise ReplayError(message)


def replay(rows: DataFrame, query: ReplayQuery, ordered: bool = True) -> DataFrame:
    """rows' columns, event_time_ns, used_receive_time_fallback, unreliable; in total order.

    Tests come in the order version, match, clock, range, checkpoint, gap; so a missing clock is an error even
    outside the range, and an unreliable row that the checkpoint covers is none.
    """
    if "dataset_version" in rows.columns:
        raise_if(rows, ~F.coalesce(F.col("dataset_version").isin(*query.versions), F.lit(False)), "a row of an unsupported dataset version")
    found = rows.where(wanted(query))
    if "receive_date" in rows.columns:
        found = found.where(partition_range(query))
    if query.clock == "receive":
        found = found.withColumn("event_time_ns", F.col("receive_time_utc_ns")).withColumn("used_receive_time_fallback", F.lit(False))
    else:
        raise_if(found, ~F.col("stream").isin(*EXCHANGE_CLOCKS), "a stream without an exchange clock, whatever the policy")
        found = found.withColumn("event_time_ns", exchange_clock(rows.columns))
        if query.missing_clock == "error":
            raise_if(found, F.col("event_time_ns").isNull(), "a row without its exchange time")
        missing = F.col("event_time_ns").isNull()
        found = found.withColumn("used_receive_time_fallback", missing)
        found = found.where(~missing) if query.missing_clock == "exclude" else found.withColumn("event_time_ns", F.coalesce("event_time_ns", "receive_time_utc_ns"))
    if query.start_ns is not None:
        found = found.where(F.col("event_time_ns") >= query.start_ns)
    if query.end_ns is not None:
        found = found.where(F.col("event_time_ns") < query.end_ns)
    if query.after_update_id is not None:
        found = found.where(F.col("final_update_id") > query.after_update_id)
    found = found.withColumn("unreliable", F.col("source_gap") | ~F.col("source_complete"))
    if query.gaps == "error":
        raise_if(found, F.col("unreliable"), "an unreliable row")
    if query.gaps == "exclude":
        found = found.where(~F.col("unreliable"))
    return found.orderBy(*order_key(query.clock)) if ordered else found


def order_key(clock: str) -> list[str]:
    return ["event_time_ns", *(["receive_time_utc_ns"] if clock == "exchange" else []), *ORDER]


def consume(ordered: DataFrame, limit: int | None = None) -> dict:
    """A consumer's digest over an ordered replay: a fold, so it streams a partition at a time to the driver."""
    digest, n, first, last = hashlib.sha256(), 0, None, None
    rows = ordered.select("event_time_ns", "logical_record_sha256")
    for row in (rows.limit(limit) if limit is not None else rows).toLocalIterator():
        digest.update(f"{row[0]}:{row[1]}\n".encode())
        n, first, last = n + 1, row[0] if first is None else first, row[0]
    return {"events": n, "first_event_time_ns": first, "last_event_time_ns": last, "sha256": digest.hexdigest()}
