"""Connection transitions, chunk statistics and completeness evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Flags that make a chunk incomplete.
INCOMPLETE = ("checksum_failure", "mixed_sequence_type", "orderbook_resync", "recovered_tail", "sequence_gap", "reconnect_gap")
# End of fixed values.
OVERLAP = "blue_green_overlap"


def transitions(frames: DataFrame, by: list[str], order: list[str], connection: str = "connection_id", flags: str | None = "capture_flags") -> DataFrame:
    """Rows whose connection differs from the row before: old and new connection, and both frames' flags."""
    w = Window.partitionBy(*by).orderBy(*order)
    carried = [c for c in (connection, flags) if c]
    before = frames.withColumn("__old", F.lag(F.struct(*carried)).over(w))
    changed = before.where(F.col("__old").isNotNull() & ~F.col(f"__old.{connection}").eqNullSafe(F.col(connection)))
    out = [*by, *order, F.col(f"__old.{connection}").alias("old_connection"), F.col(connection).alias("new_connection")]
    return changed.select(*out, *([F.col(f"__old.{flags}").alias("old_flags"), F.col(flags).alias("new_flags")] if flags else []))


def first_frames(frames: DataFrame, by: list[str], order: list[str], connection: str = "connection_id") -> DataFrame:
    """The first frame of each run of one connection."""
    old = F.lag(connection).over(Window.partitionBy(*by).orderBy(*order))
    return frames.withColumn("__old", old).where(F.col("__old").isNull() | (F.col("__old") != F.col(connection))).drop("__old")


def proven(old_flags: Column, new_flags: Column) -> Column:
    """A transition with proof on its own two frames: a gap that is owned up to, or an overlap of one deployment on both."""
    has = lambda f, x: F.array_contains(f, x)
    ids = lambda f: F.filter(f, lambda x: x.startswith("deployment_id="))
    shared = ((F.size(ids(old_flags)) == 0) & (F.size(ids(new_flags)) == 0)) | F.arrays_overlap(ids(old_flags), ids(new_flags))
    return has(old_flags, "sequence_gap") | has(new_flags, "sequence_gap") | (has(old_flags, OVERLAP) & has(new_flags, OVERLAP) & shared)


def boundaries(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of chunks(first_connection, last_connection, record_count, chunk_id): each non-empty one against the last non-empty
    one before it, with the empty ones between."""
    w = Window.partitionBy(*by).orderBy(*order)
    filled = F.col("record_count") > 0
    marked = chunks.withColumn("__before", F.last(F.when(filled, F.struct(F.col("last_connection").alias("connection"), F.col("chunk_id").alias("chunk"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.coalesce(F.sum(filled.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("__island", island)
    empties = F.collect_list(F.when(~filled, F.col("chunk_id"))).over(Window.partitionBy(*by, "__island").orderBy(*order))
    return marked.withColumn("markers", empties).where(filled & F.col("__before").isNotNull()).select(*by, *order, F.col("__before.chunk").alias("previous_chunk"), "chunk_id", F.col("__before.connection").alias("old_connection"), F.col("first_connection").alias("new_connection"), "markers", (~F.col("__before.connection").eqNullSafe(F.col("first_connection"))).alias("is_transition"))


def chunk_statistics(frames: DataFrame, by: list[str]) -> DataFrame:
    """Counts, clock bounds, distinct names and flags of each chunk; a sequence name with both numbers and texts is flagged."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("receive_time_utc_ns", "receive_monotonic_ns", "exchange_event_time", "exchange_transaction_time", "exchange_trade_time") for n, f in (("min", F.min), ("max", F.max))]
    base = frames.groupBy(*by).agg(F.count("*").alias("record_count"), *bounds, F.array_sort(F.collect_set("connection_id")).alias("connection_ids"), F.array_sort(F.collect_set("collector_instance_id")).alias("collector_ids"))
    flags = frames.select(*by, F.explode("capture_flags").alias("f")).groupBy(*by).agg(F.array_sort(F.collect_set("f")).alias("capture_flags"))
    named = frames.select(*by, F.explode("source_sequence").alias("name", "raw"))
    text = F.col("raw").startswith('"')
    ranges = named.groupBy(*by, "name").agg(F.min(F.when(~text, F.col("raw").try_cast("bigint"))).alias("low"), F.max(F.when(~text, F.col("raw").try_cast("bigint"))).alias("high"), (F.bool_or(text) & F.bool_or(~text)).alias("mixed"))
    sequences = ranges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("name", "low", "high"))).alias("sequences"), F.bool_or("mixed").alias("mixed_sequence_type"))
    none = F.array().cast("array<string>")
    return base.join(flags, by, "left").join(sequences, by, "left").withColumn("capture_flags", F.when(F.coalesce("mixed_sequence_type", F.lit(False)), F.array_sort(F.array_union(F.coalesce("capture_flags", none), F.array(F.lit("mixed_sequence_type"))))).otherwise(F.coalesce("capture_flags", none)))


def completeness(chunks: DataFrame, unproven: Column) -> DataFrame:
    """complete and gap of chunks(capture_flags, connection_ids); several connections without proof at their boundaries make a gap."""
    incomplete = F.array(*map(F.lit, INCOMPLETE))
    flags = F.col("capture_flags")
    forced = (F.size("connection_ids") > 1) & ~F.arrays_overlap(flags, incomplete) & unproven
    out = chunks.withColumn("capture_flags", F.when(forced, F.array_sort(F.array_union(flags, F.array(F.lit("reconnect_gap"))))).otherwise(flags))
    return out.withColumn("complete", ~F.arrays_overlap("capture_flags", incomplete)).withColumn("gap", F.arrays_overlap("capture_flags", F.array(F.lit("sequence_gap"), F.lit("reconnect_gap"))))


def continuity(updates: DataFrame, by: list[str], order: list[str], first: str, final: str, previous: str | None = None) -> DataFrame:
    """Each update against the highest final id before it: STALE, GAP or OK; START for the first. `previous` gives the rule
    of markets that name their predecessor."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(final).over(w)
    gap = ~F.col(previous).eqNullSafe(F.col("__top")) if previous else F.col(first) > F.col("__top") + 1
    return updates.withColumn("__top", top).withColumn("continuity", F.when(F.col("__top").isNull(), "START").when(F.col(final) <= F.col("__top"), "STALE").when(gap, "GAP").otherwise("OK")).withColumnRenamed("__top", "previous_top")


def clock_discontinuities(samples: DataFrame, by: list[str], wall: str, monotonic: str, threshold_ns: int = 30_000_000_000) -> DataFrame:
    """Suspensions: the wall clock gained on the monotonic one by the threshold or more."""
    w = Window.partitionBy(*by).orderBy(monotonic, wall)
    d = samples.withColumn("__w", F.lag(wall).over(w)).withColumn("__m", F.col(monotonic) - F.lag(monotonic).over(w))
    lost = F.col(wall) - F.col("__w") - F.col("__m")
    return d.where(lost >= threshold_ns).select(*by, (F.col("__w") + F.greatest(F.col("__m"), F.lit(0))).alias("started_at_ns"), F.col(wall).alias("ended_at_ns"), lost.alias("duration_ns"))


def severity_changes(samples: DataFrame, by: list[str], order: list[str], severity: str) -> DataFrame:
    """The first sample of each scope and those whose severity differs from the one before."""
    old = F.lag(severity).over(Window.partitionBy(*by).orderBy(*order))
    return samples.withColumn("previous_severity", old).where(~F.col("previous_severity").eqNullSafe(F.col(severity)))


def missing_periods(observed: DataFrame, by: list[str], period: str, step: int) -> DataFrame:
    """Periods between the first and last observed of each key that are not there."""
    span = observed.groupBy(*by).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    expected = span.select(*by, F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias(period))
    return expected.join(observed.select(*by, period).distinct(), [*by, period], "left_anti")


def response_contract(periods: DataFrame, by: list[str], at: str, start: str, end: str, step: int, leading: int = 0) -> DataFrame:
    """Whether each response's periods start where asked (or `leading` periods earlier), step evenly and stay inside the range."""
    w = Window.partitionBy(*by).orderBy("position")
    d = periods.withColumn("__step", F.col(at) - F.lag(at).over(w))
    return d.groupBy(*by).agg(
        (F.min(at).between(F.min(F.col(start)) - leading * step, F.min(start)) & F.bool_and(F.coalesce(F.col("__step") == step, F.lit(True))) & F.bool_and(F.col(at) <= F.col(end))).alias("accepted"),
        F.count("*").alias("periods"),
    )
