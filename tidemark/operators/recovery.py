"""What recovery may conclude from durable facts: source ownership cases, and old reconnect intents partitioned in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recovery_case(chunk: Column, same_host: Column, remote: Column, seen: Column, evidence_ok: Column) -> Column:
    """The case of a chunk from its state, its owners' states, and what was seen of its source.

    seen: PRESENT_MATCHING, PRESENT_MISMATCH, ABSENT or UNKNOWN. evidence_ok: the retained manifest and the remote
    descriptor, if any, bind to the chunk. The first rule that holds decides.
    """
    owned, away = same_host.isNotNull(), remote.isNotNull()
    present, absent = seen == "PRESENT_MATCHING", seen == "ABSENT"
    sealed = F.coalesce(chunk == "SEALED", F.lit(False))
    pending = remote == "REMOTE_DELETE_PENDING"
    rules = [
        (chunk.isNull(), "CASE_D"), (owned & away, "IMPOSSIBLE_OVERLAP"), (away & ~sealed, "IMPOSSIBLE_OVERLAP"), (owned, "NORMAL"), (~sealed, "CASE_D"),
        (~F.coalesce(evidence_ok, F.lit(False)), "CASE_D"),
        (~away & present, "NORMAL"), (~away & absent, "CASE_C"), (~away, "CASE_D"),
        (pending & present, "CASE_A"), (pending & absent, "CASE_B"), (pending, "CASE_D"),
        (remote != "REMOTE_DELETED", "CASE_D"), (absent, "TERMINAL_ABSENT"), (seen.isin("PRESENT_MATCHING", "PRESENT_MISMATCH"), "TERMINAL_PRESENT_CONTRADICTION"),
    ]
    out = None
    for condition, case in rules:
        out = F.when(condition, case) if out is None else out.when(condition, case)
    return out.otherwise("CASE_D")


def legitimate(trusted_frames: Column, versioned: Column, completes: Column) -> Column:
    """Positive proof that an intent without a gap was a real one; the absence of a parent never is."""
    return F.coalesce(trusted_frames > 0, F.lit(False)) | F.coalesce(versioned, F.lit(False)) | F.coalesce(completes, F.lit(False))


def partition_intents(intents: DataFrame, lifecycle: DataFrame, completions: DataFrame) -> DataFrame:
    """Each intent's decision, in order of transition_id within its stream.

    intents(transition_id, market, stream, gap_id, connection, generation, trusted_frames, versioned);
    lifecycle(market, stream, gap_id, state); completions(market, stream, new_connection, new_generation).
    An intent that is taken as real opens its gap for those after it: the same gap must then agree on connection and
    generation, and another gap of that stream competes with it.
    """
    key = ["market", "stream", "gap_id"]
    done = completions.select("market", "stream", F.col("new_connection").alias("connection"), F.col("new_generation").alias("generation")).distinct().withColumn("completes", F.lit(True))
    rows = intents.join(lifecycle.select(*key, "state"), key, "left").join(done, ["market", "stream", "connection", "generation"], "left")
    rows = rows.withColumn("state", F.coalesce("state", F.lit("ABSENT"))).withColumn("real", (F.col("state") == "ABSENT") & legitimate(F.col("trusted_frames"), F.col("versioned"), F.col("completes")))
    before = Window.partitionBy(*key).orderBy("transition_id").rowsBetween(Window.unboundedPreceding, -1)
    stream = Window.partitionBy("market", "stream").orderBy("transition_id").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.col("real") | (F.col("state") == "OPEN")
    who = F.struct("connection", "generation")
    rows = rows.withColumn("first", F.first(F.when(opened, who), ignorenulls=True).over(before))
    names = F.when(opened, F.col("gap_id"))
    rows = rows.withColumns({"low": F.min(names).over(stream), "high": F.max(names).over(stream)})
    competing = F.coalesce((F.col("low") != F.col("gap_id")) | (F.col("high") != F.col("gap_id")), F.lit(False))
    decision = (
        F.when(F.col("state") == "CLOSED", "historical_closed")
        .when(F.col("first").isNotNull(), F.when(F.col("first") == who, "open_validated").otherwise("conflict"))
        .when(F.col("state") == "OPEN", "open_validated")
        .when(competing, "competing_open")
        .when(F.col("real"), "proven_legitimate")
        .otherwise("ambiguous")
    )
    return rows.select("transition_id", *key, decision.alias("decision"))
