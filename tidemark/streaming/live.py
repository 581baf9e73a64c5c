"""Structured Streaming: live metrics, previews of dedup, resumable book state, and batches that are written once.

The reference semantics never drop late rows, so the archival path is batch. Here a watermark only bounds the state of
previews, and daily metrics are additive, so a late row is one more increment of its own day.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.book import Machine, plain


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """The event time as a timestamp: watermarks don't take one without a zone."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def daily_counts(events: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """Counts of each UTC day and key, in update mode: every batch gives the days that it changes, late ones included."""
    return timed(events, at).groupBy(F.window(at, "1 day").alias("day"), *by).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), *by, "n")


def preview_dedup(events: DataFrame, key: list[str], at: str = "ts", within: str = "10 minutes") -> DataFrame:
    """First sights of each key within a span. State is bounded, so a repeat that comes later is shown again."""
    return timed(events, at).withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def sliding_counts(events: DataFrame, by: list[str], length: str, slide: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    return timed(events, at).withWatermark(at, late).groupBy(F.window(at, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def connection_sessions(events: DataFrame, connection: str, at: str = "ts") -> DataFrame:
    """A connection is a session, however long it pauses."""
    return timed(events, at).groupBy(connection).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


BOOK_OUT = "market string, symbol string, update_id bigint, result string, best_bid string, best_ask string, complete boolean"


def live_book(events: DataFrame) -> DataFrame:
    """A book for each (market, symbol), kept between batches as the machine's own checkpoint and buffer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            saved, buffer = state.get
            machine = Machine.restore(saved) if saved else Machine(key[0] == "spot")
            kept = json.loads(buffer)
            machine.buffer, machine.state = kept["updates"], kept["state"]
        else:
            machine = Machine(key[0] == "spot")
        out = []
        whole = list(batches)  # a group's part of a micro-batch may come in several Arrow batches, in any order
        if whole:
            for r in pd.concat(whole).sort_values(["receive_time_utc_ns", "ordinal"]).itertuples(index=False):
                bids, asks = json.loads(r.bids_json), json.loads(r.asks_json)
                if r.kind == "snapshot":
                    result = machine.snapshot(int(r.final), bids, asks, int(r.receive_time_utc_ns))
                else:
                    result = machine.offer({"first": int(r.first), "final": int(r.final), "previous": None if pd.isna(r.previous) else int(r.previous), "bids": bids, "asks": asks, "at": int(r.receive_time_utc_ns)})
                bid, ask = machine.best("bid"), machine.best("ask")
                out.append((*key, machine.update_id, result, None if bid is None else plain(bid), None if ask is None else plain(ask), machine.book is not None and machine.complete and not machine.resync))
        machine.audits = []
        state.update((machine.checkpoint() if machine.book is not None else "", json.dumps({"updates": machine.buffer, "state": machine.state})))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in BOOK_OUT.split(", ")])

    return events.groupBy("market", "symbol").applyInPandasWithState(step, BOOK_OUT, "book string, buffer string", "append", GroupStateTimeout.NoTimeout)


def write_batches_once(stream: DataFrame, path: str, checkpoint: str, prepare=None):
    """foreachBatch into a folder for each batch id: a batch that is tried again replaces its own folder and no other."""

    def put(batch: DataFrame, number: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rotating_files(stream: DataFrame, path: str, checkpoint: str, seconds: int = 60, rows: int = 1_000_000):
    """Files by trigger interval and size."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows).trigger(processingTime=f"{seconds} seconds").start()


def saturation_flag(depth: Column, capacity: int) -> Column:
    """Back pressure is data: a queue that was full lost frames, and the next frame says so."""
    return F.when(depth >= capacity, F.array(F.lit("sequence_gap"))).otherwise(F.array().cast("array<string>"))
