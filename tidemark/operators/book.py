"""Order books: the relational state of levels, and the sequential machine that decides what may be applied.

Latest levels, best levels and comparisons are aggregates. Bootstrapping, gaps and resynchronisation depend on
every event before, so they run as a fold over one (market, symbol) at a time, in Arrow batches: its state is
a book and a bounded buffer, whatever the length of the stream.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import floor_div

BUFFER, WARN_AT = 8192, 0.75


def latest_levels(levels: DataFrame, by: list[str], price: str, quantity: str, order: list[str]) -> DataFrame:
    """The last absolute quantity of each price level; zero removes it. max_by needs no sort and combines before the shuffle."""
    out = levels.groupBy(*by, price).agg(F.max_by(F.col(quantity), F.struct(*order)).alias(quantity))
    return out.where(F.col(quantity) > 0)


def segments(events: DataFrame, by: list[str], order: list[str], starts: Column) -> DataFrame:
    """Numbers runs of events that begin at each snapshot or gap, so that level state is taken inside one run."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("segment", F.sum(starts.cast("int")).over(w))


def best_levels(book: DataFrame, by: list[str], side: str = "side", price: str = "price", quantity: str = "quantity") -> DataFrame:
    """Highest bid and lowest ask, with their quantities; crossed where they meet, empty where a side is missing."""
    is_bid = F.col(side) == "bid"
    bid, ask = F.when(is_bid, F.col(price)), F.when(~is_bid, F.col(price))
    out = book.groupBy(*by).agg(F.max(bid).alias("best_bid"), F.max_by(quantity, bid).alias("bid_quantity"), F.min(ask).alias("best_ask"), F.min_by(quantity, ask).alias("ask_quantity"))
    return out.withColumn("crossed", F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False))).withColumn("empty_side", F.col("best_bid").isNull() | F.col("best_ask").isNull())


def canonical_sides(book: DataFrame, by: list[str], depth: int | None = None) -> DataFrame:
    """Bids from the highest, asks from the lowest, as arrays of (price, quantity)."""
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("price", "quantity")))
    out = book.groupBy(*by).agg(F.sort_array(side("bid"), asc=False).alias("bids"), F.sort_array(side("ask")).alias("asks"))
    return out if depth is None else out.withColumn("bids", F.slice("bids", 1, depth)).withColumn("asks", F.slice("asks", 1, depth))


def compare_ticker(tickers: DataFrame, books: DataFrame, by: list[str]) -> DataFrame:
    """Each ticker against the book of its key: UNAVAILABLE, STALE, AHEAD, MATCH or MISMATCH."""
    b = books.select(*by, F.col("update_id").alias("book_update_id"), "reliable", "best_bid", "bid_quantity", "best_ask", "ask_quantity")
    j = tickers.join(b, by, "left")
    equal = F.lit(True)
    for mine, theirs in (("t_bid", "best_bid"), ("t_bid_quantity", "bid_quantity"), ("t_ask", "best_ask"), ("t_ask_quantity", "ask_quantity")):
        equal = equal & F.coalesce(F.col(mine) == F.col(theirs), F.lit(False))
    state = F.when(~F.coalesce(F.col("reliable"), F.lit(False)), "UNAVAILABLE").when(F.col("update_id") < F.col("book_update_id"), "STALE").when(F.col("update_id") > F.col("book_update_id"), "AHEAD")
    return j.withColumn("comparison", state.when(equal, "MATCH").otherwise("MISMATCH"))


def bridging_update(updates: DataFrame, snapshots: DataFrame, by: list[str], spot: bool, bucket: int = 1 << 16) -> DataFrame:
    """For each snapshot, the first update that reaches its target, and whether it covers it.

    As-of without a range join: updates and targets are sorted together from the last id down, and each target takes the
    update seen last. Sorting is inside buckets of ids; a bucket without an update above the target takes the least of
    the next bucket that has one, so a symbol is as many tasks as its ids need.
    """
    target = F.col("last_update_id") + (1 if spot else 0)
    points = snapshots.select(*by, target.alias("at"), F.lit(0).alias("side"), "last_update_id", F.lit(None).cast("struct<u:bigint,first:bigint>").alias("up"))
    steps = updates.select(*by, F.col("final_update_id").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("last_update_id"), F.struct(F.col("final_update_id").alias("u"), F.col("first_update_id").alias("first")).alias("up"))
    rows = points.unionByName(steps).withColumn("bucket", floor_div(F.col("at"), bucket))
    down = Window.partitionBy(*by, "bucket").orderBy(F.desc("at"), F.desc("side"), F.desc(F.col("up.first"))).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    carried = rows.groupBy(*by, "bucket").agg(F.min("up").alias("up")).select(*by, "bucket", F.last("up", ignorenulls=True).over(above).alias("carry"))
    found = rows.withColumn("own", F.last("up", ignorenulls=True).over(down)).where("side = 0").join(carried, [*by, "bucket"]).withColumn("next", F.coalesce("own", "carry"))
    return found.select(*by, "last_update_id", F.col("next.first").alias("first_update_id"), F.col("next.u").alias("final_update_id"), F.when(F.col("next").isNull(), "NEED_MORE_EVENTS").when(F.col("next.first") <= F.col("at"), "SYNCHRONIZED").otherwise("SNAPSHOT_TOO_OLD").alias("result"))


def plain(value: Decimal) -> str:
    text = format(value, "f")
    return "0" if value == 0 else text.rstrip("0").rstrip(".") if "." in text else text


def decimal(text: str, positive: bool) -> Decimal:
    try:
        value = Decimal(text)
    except InvalidOperation as e:
        raise ValueError(f"not a decimal: {text!r}") from e
    if not value.is_finite() or (value <= 0 if positive else value < 0):
        raise ValueError(f"out of range: {text!r}")
    return value


#: What a depth update does in each state of a book, and what a snapshot does.
ON_DEPTH = {"filling": "hold", "full": "refuse", "live": "follow", "broken": "hold"}
ON_SNAPSHOT = {"filling": "bridge", "full": "refuse", "live": "bridge", "broken": "bridge"}


@dataclass
class Machine:
    """One market's and symbol's book, in one of four states. Feed it depth updates and snapshots in receive order.

    filling: updates wait for a snapshot. full: too many did; they are gone, and nothing is taken until restart(). live: updates are
    applied. broken: an update was missed, and updates wait for a snapshot again.

    spot: an update may start at most one past the book's id; otherwise it must name the book's id as its
    predecessor. A stale update is skipped before that test; the update that bridges a snapshot is applied
    without it. An unreliable interval, once open, leaves the book incomplete for good.
    """

    spot: bool
    book: dict | None = None
    update_id: int = 0
    buffer: list = field(default_factory=list)
    audits: list = field(default_factory=list)
    gaps: list = field(default_factory=list)
    state: str = "filling"
    complete: bool = True
    warned: bool = False
    prices: dict = field(default_factory=dict)  # of each side, in order

    @property
    def resync(self) -> bool:
        return self.state == "broken" or (self.state == "full" and self.book is not None)

    def clear(self) -> None:
        self.book, self.prices = {"bid": {}, "ask": {}}, {"bid": [], "ask": []}

    def best(self, side: str) -> Decimal | None:
        prices = self.prices[side] if self.book is not None else []
        return prices[-1 if side == "bid" else 0] if prices else None

    def audit(self, kind: str, update_id: int, at: int) -> None:
        self.audits.append((kind, update_id, at))

    def restart(self) -> None:
        """Forgets what was derived, before a fresh connection and snapshot; gaps and audits stay."""
        self.book, self.buffer, self.warned, self.state = None, [], False, "filling"

    def offer(self, update: dict) -> str:
        return getattr(self, ON_DEPTH[self.state])(update)

    def snapshot(self, last_update_id: int, bids: list, asks: list, at: int) -> str:
        if ON_SNAPSHOT[self.state] == "refuse":
            return "NEED_MORE_EVENTS"
        return self.bridge(last_update_id, bids, asks)

    def refuse(self, update: dict) -> str:
        return "REFUSED"

    def hold(self, update: dict) -> str:
        if len(self.buffer) == BUFFER:
            self.buffer, self.state = [], "full"
            self.audit("bootstrap_buffer_overflow", update["final"], update["at"])
            return "REFUSED"
        self.buffer.append(update)
        if len(self.buffer) >= WARN_AT * BUFFER and not self.warned:
            self.warned = True
            self.audit("bootstrap_buffer_near_capacity", update["final"], update["at"])
        return "BUFFERED"

    def follow(self, update: dict) -> str:
        if update["final"] <= self.update_id:
            self.audit("duplicate_or_stale_depth", update["final"], update["at"])
        elif self.connects(update):
            self.apply(update)
        else:
            self.gaps.append({"last_reliable_update_id": self.update_id, "first": update["first"], "final": update["final"], "started_at_ns": update["at"], "ended_at_update_id": None})
            self.audit("sequence_gap", update["final"], update["at"])
            self.state, self.complete, self.buffer = "broken", False, [update]
            return "SEQUENCE_GAP"
        return "APPLIED"

    def connects(self, update: dict) -> bool:
        return update["first"] <= self.update_id + 1 if self.spot else update["previous"] == self.update_id

    def bridge(self, last_update_id: int, bids: list, asks: list) -> str:
        target = last_update_id + self.spot
        first = next((k for k, u in enumerate(self.buffer) if u["final"] >= target), None)
        if first is None:
            self.buffer = []
            return "NEED_MORE_EVENTS"
        if self.buffer[first]["first"] > target:
            return "SNAPSHOT_TOO_OLD"
        waiting = deque(u for u in self.buffer[first:] if u["final"] >= target)
        again, self.state, self.buffer, self.warned, self.update_id = self.state == "broken", "live", [], False, last_update_id
        self.clear()
        self.put(bids, asks)
        last = waiting[-1]["at"]
        self.apply(waiting.popleft())
        while waiting and self.state == "live":
            self.follow(waiting.popleft())
        if self.state != "live":
            self.buffer += waiting
            return "SEQUENCE_GAP"
        if again:
            if self.gaps and self.gaps[-1]["ended_at_update_id"] is None:
                self.gaps[-1]["ended_at_update_id"] = self.update_id
            self.audit("orderbook_resync", self.update_id, last)
        return "SYNCHRONIZED"

    def compare(self, update_id: int, bid: tuple, ask: tuple, at: int) -> str:
        """A ticker (price and quantity of both sides, as texts) against the book; equal ids with other best levels are audited."""
        if self.state != "live":
            return "UNAVAILABLE"
        if update_id != self.update_id:
            return "STALE" if update_id < self.update_id else "AHEAD"
        theirs = [(decimal(p, True), decimal(q, False)) for p, q in (bid, ask)]
        if [(p, self.book[side].get(p)) if (p := self.best(side)) is not None else None for side in ("bid", "ask")] == theirs:
            return "MATCH"
        self.audit("book_ticker_mismatch", self.update_id, at)
        return "MISMATCH"

    def put(self, bids: list, asks: list) -> None:
        for side, levels in (("bid", bids), ("ask", asks)):
            for price, quantity in levels:
                p, q, known, order = decimal(price, True), decimal(quantity, False), self.book[side], self.prices[side]
                if q and p not in known:
                    insort(order, p)
                if q:
                    known[p] = q
                elif known.pop(p, None) is not None:
                    del order[bisect_left(order, p)]

    def apply(self, update: dict) -> None:
        self.put(update["bids"], update["asks"])
        self.update_id = update["final"]
        if not self.book["bid"] or not self.book["ask"]:
            self.audit("empty_book_side", self.update_id, update["at"])
        elif self.best("bid") >= self.best("ask"):
            self.audit("crossed_book", self.update_id, update["at"])

    def document(self) -> dict:
        """The canonical book: bids from the highest, asks from the lowest."""
        sides = {s: [[plain(p), plain(q)] for p, q in sorted((self.book or {s: {}})[s].items(), reverse=s == "bid")] for s in ("bid", "ask")}
        return {"update_id": self.update_id, "bids": sides["bid"], "asks": sides["ask"], "complete": self.complete}

    def logical_sha256(self) -> str:
        return sha256(json.dumps(self.document(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def checkpoint(self) -> str:
        """JSON of the book and its intervals, with a hash over both that restore() checks."""
        body = {"spot": self.spot, "book": self.document(), "gaps": self.gaps, "state": self.state}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        return json.dumps({"body": body, "sha256": sha256(text.encode()).hexdigest()}, sort_keys=True)

    @classmethod
    def restore(cls, text: str) -> Machine:
        found = json.loads(text)
        body = found["body"]
        if sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != found["sha256"]:
            raise ValueError("a checkpoint whose hash differs")
        out = cls(body["spot"], update_id=body["book"]["update_id"], gaps=body["gaps"], state=body["state"], complete=body["book"]["complete"] and not body["gaps"])
        out.clear()
        out.put(body["book"]["bids"], body["book"]["asks"])
        return out


OUT = "market string, symbol string, receive_time_utc_ns bigint, result string, update_id bigint, best_bid string, best_ask string, bid_levels int, ask_levels int, complete boolean, logical_sha256 string, audits array<string>"


def run_machine(events: DataFrame, hashes: bool = False) -> DataFrame:
    """The machine over events(market, symbol, kind, receive_time_utc_ns, ordinal, first, final, previous, bids_json, asks_json):
    the state after each event. kind is "snapshot" (final: its id) or "depth". `hashes` adds each state's, over all its levels."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Machine(key[0] == "spot")
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                seen = len(machine.audits)
                bids, asks = json.loads(r.bids_json), json.loads(r.asks_json)
                if r.kind == "snapshot":
                    result = machine.snapshot(int(r.final), bids, asks, int(r.receive_time_utc_ns))
                else:
                    result = machine.offer({"first": int(r.first), "final": int(r.final), "previous": None if pd.isna(r.previous) else int(r.previous), "bids": bids, "asks": asks, "at": int(r.receive_time_utc_ns)})
                book, bid, ask = machine.book or {"bid": {}, "ask": {}}, machine.best("bid"), machine.best("ask")
                out.append((key[0], key[1], r.receive_time_utc_ns, result, machine.update_id, None if bid is None else plain(bid), None if ask is None else plain(ask), len(book["bid"]), len(book["ask"]), machine.complete and machine.book is not None and not machine.resync, machine.logical_sha256() if hashes else None, [a[0] for a in machine.audits[seen:]]))
                del machine.audits[: max(0, len(machine.audits) - 1)]
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUT.split(", ")])

    # rows of a group come sorted because each group is one partition's run in this order
    return grouped_in_order(events, ["market", "symbol"], ["receive_time_utc_ns", "ordinal"], fold)


def grouped_in_order(events: DataFrame, by: list[str], order: list[str], fold) -> DataFrame:
    """fold over each group's rows in order, without ever holding a whole group: partitions are sorted by key and
    order, and a group is the run of rows between two key changes."""
    columns = events.columns

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list = []
        source = iter(batches)

        def more() -> bool:
            for batch in source:
                if len(batch):
                    keys = batch[by].apply(tuple, axis=1)
                    cut = keys.ne(keys.shift()).cumsum()
                    pending.extend((keys[part.index[0]], part[columns]) for _, part in batch.groupby(cut, sort=False))
                    return True
            return False

        while pending or more():
            key = pending[0][0]

            def own(key=key) -> Iterator[pd.DataFrame]:
                while (pending or more()) and pending[0][0] == key:
                    yield pending.pop(0)[1]

            yield from fold(key, own())

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(n, *by).sortWithinPartitions(*by, *order).mapInPandas(runs, OUT)


def readiness(streams: DataFrame, by: list[str], core: tuple[str, ...] = ("diff_depth", "agg_trade", "book_ticker")) -> DataFrame:
    """Ready if all core streams are connected and persisted, a snapshot is there and the book is synchronized."""
    good = F.col("connected") & F.col("persisted")
    return streams.groupBy(*by).agg((F.size(F.array_except(F.array(*map(F.lit, core)), F.collect_set(F.when(good, F.col("stream"))))) == 0).alias("streams_ready"), F.bool_or("snapshot").alias("snapshot"), F.bool_or("synchronized").alias("synchronized")).withColumn("ready", F.col("streams_ready") & F.col("snapshot") & F.col("synchronized"))


def resync_events(states: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Where a book's need to resynchronise is requested, and where it completes."""
    w = Window.partitionBy(*by).orderBy(*order)
    old = F.lag("result").over(w)
    return states.withColumn("event", F.when(F.col("result") == "SEQUENCE_GAP", "RESYNC_REQUESTED").when((F.col("result") == "SYNCHRONIZED") & old.isNotNull(), "RESYNC_COMPLETED")).where("event is not null")
