"""Discontinuity intervals from start and end events, and how connection transitions match them."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import floor_div

KEY = ["market", "stream", "gap_id"]


def open_gaps(events: DataFrame, started: str = "STARTED", completed: str = "COMPLETED", keep_unnamed: bool = False) -> DataFrame:
    """Started and never completed. Starts without a gap_id stay if asked for, since nothing can complete them."""
    starts, ends = events.where(F.col("kind") == started), events.where(F.col("kind") == completed).select(*KEY).distinct()
    named = starts.where("gap_id is not null").join(ends, KEY, "left_anti")
    return named.unionByName(starts.where("gap_id is null")) if keep_unnamed else named


def last_per_key(events: DataFrame, kind: str, order: list[str], prefix: str) -> DataFrame:
    """For each gap, the last event of a kind."""
    rest = [c for c in events.columns if c not in KEY]
    return events.where((F.col("kind") == kind) & F.col("gap_id").isNotNull()).groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias(prefix))


def closed_gaps(events: DataFrame, order: list[str], started: str = "STARTED", completed: str = "COMPLETED") -> DataFrame:
    """Pairs of the last start and the last end of each gap, as structs `s` and `e`."""
    return last_per_key(events, started, order, "s").join(last_per_key(events, completed, order, "e"), KEY)


def identity_valid(s: str = "s", e: str = "e") -> Column:
    """Both times known, both connections named, both generations counted. Clocks may run backwards."""
    named = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    counted = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    return F.col(f"{s}.at_ns").isNotNull() & F.col(f"{e}.at_ns").isNotNull() & named(F.col(f"{s}.connection")) & named(F.col(f"{e}.connection")) & counted(f"{s}.generation") & counted(f"{e}.generation")


def degraded_pairs(events: DataFrame, order: list[str]) -> DataFrame:
    return closed_gaps(events, order).where(~identity_valid())


def malformed_reason(evidence: Column | None = None) -> Column:
    """The first thing that a gap event lacks; null if nothing. `evidence` is its JSON text, where the events carry it."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = [(empty("market"), "missing_market"), (empty("stream"), "missing_stream"), (empty("gap_id"), "missing_gap_id")]
    if evidence is not None:
        value = F.try_parse_json(evidence)
        rules = [(value.isNull(), "evidence_not_json"), (~F.schema_of_variant(value).startswith("OBJECT"), "evidence_not_object"), *rules]
    return F.coalesce(*(F.when(bad, name) for bad, name in rules))


def malformed_events(events: DataFrame, evidence: str | None = None) -> DataFrame:
    """Gap events whose identity can't be told, with the reason. Times, connections and generations that lack are another matter: see identity_valid()."""
    return events.withColumn("reason", malformed_reason(None if evidence is None else F.col(evidence))).where("reason is not null")


def lifecycle(events: DataFrame, by: list[str], started: Column, completed: Column) -> DataFrame:
    """ABSENT, OPEN or CLOSED for each key."""
    agg = events.groupBy(*by).agg(F.bool_or(started).alias("s"), F.bool_or(completed).alias("c"))
    return agg.select(*by, F.when(F.col("s") & F.col("c"), "CLOSED").when(F.col("s"), "OPEN").otherwise("ABSENT").alias("state"))


def intervals(events: DataFrame, order: list[str]) -> DataFrame:
    """One interval for each gap that started; its end is null while it's open."""
    s, e = last_per_key(events, "STARTED", order, "s"), last_per_key(events, "COMPLETED", order, "e")
    return s.join(e, KEY, "left").select(*KEY, F.col("s.at_ns").alias("started_at_ns"), F.col("e.at_ns").alias("ended_at_ns"), F.col("s.connection").alias("original_connection"), F.col("e.connection").alias("new_connection"))


def covering(points: DataFrame, spans: DataFrame, by: list[str], bin_ns: int) -> DataFrame:
    """points(by..., id, at_ns) with n_time, how many spans(by..., gap_id, started_at_ns, ended_at_ns or null) hold each, and, of
    one alone, its `code`. Starts, points and ends go through one running sum of counts, and one exclusive or of
    hashes, which is the hash itself where one is left. Both run inside time bins; what is open at a bin's start is carried
    into it, so no task sees more than a bin of a stream, and no pair is made."""
    code = F.xxhash64(*by, "gap_id")
    step = lambda at, side, sign: [*by, F.col(at).alias("at_ns"), F.lit(side).alias("side"), F.lit(None).cast("bigint").alias("id"), F.lit(sign).alias("n"), code.alias("code")]
    right = spans.where("started_at_ns is not null and (ended_at_ns is null or ended_at_ns >= started_at_ns)")
    steps = right.select(*step("started_at_ns", 0, 1)).unionByName(right.where("ended_at_ns is not null").select(*step("ended_at_ns", 2, -1)))
    asked = points.select(*by, "at_ns", F.lit(1).alias("side"), F.col("id").cast("bigint").alias("id"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("code"))
    rows = steps.unionByName(asked).withColumn("bin", floor_div(F.col("at_ns"), bin_ns))
    earlier = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    before = rows.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.bit_xor("code").alias("code")).select(*by, "bin", F.sum("n").over(earlier).alias("n_before"), F.bit_xor("code").over(earlier).alias("code_before"))
    inside = Window.partitionBy(*by, "bin").orderBy("at_ns", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"n_in": F.sum("n").over(inside), "code_in": F.bit_xor("code").over(inside)}).where("side = 1").join(before, [*by, "bin"])
    n = F.col("n_in") + F.coalesce("n_before", F.lit(0))
    return run.select(*by, "id", n.cast("bigint").alias("n_time"), F.when(n == 1, F.col("code_in").bitwiseXOR(F.coalesce("code_before", F.lit(0).cast("bigint")))).alias("code"))


def match_intervals(transitions: DataFrame, gaps: DataFrame, by: list[str], bin_ns: int) -> DataFrame:
    """Each transition's match among intervals: by both connections, by one, or by time, in that order.

    transitions(id, by..., at_ns, old_connection, new_connection); gaps(by..., gap_id, started_at_ns, ended_at_ns,
    original_connection, new_connection), a row for each gap_id. Several candidates of the deciding strength are AMBIGUOUS; an
    open interval is PENDING. Only counts and single candidates are ever needed, so intervals are counted by connection
    before they meet transitions, and time decides only where no connection does: see covering().
    """
    t, g = transitions, gaps.select(*by, "gap_id", "started_at_ns", "ended_at_ns", "original_connection", F.col("new_connection").alias("renewed_connection"))
    one = F.min(F.struct("gap_id", "ended_at_ns"))
    renamed = {"old_connection": F.col("original_connection"), "new_connection": F.col("renewed_connection")}
    out = t
    for name, columns in (("old", ["old_connection"]), ("new", ["new_connection"]), ("both", ["old_connection", "new_connection"])):
        tallied = g.withColumns({c: renamed[c] for c in columns}).groupBy(*by, *columns).agg(F.count("*").alias(f"n_{name}"), one.alias(f"g_{name}"))
        out = out.join(tallied, [*by, *columns], "left")
    out = out.fillna(0, ["n_old", "n_new", "n_both"])
    unnamed = out.where("n_old = 0 and n_new = 0")
    timed = covering(unnamed, g, by, bin_ns)
    spans = g.select(*by, F.xxhash64(*by, "gap_id").alias("code"), F.struct("gap_id", "ended_at_ns").alias("g_time"))
    out = out.join(timed, [*by, "id"], "left").join(spans, [*by, "code"], "left").fillna(0, ["n_time"])
    partial = F.col("n_old") + F.col("n_new") - 2 * F.col("n_both")
    exact, some = F.col("n_both"), F.col("n_old") + F.col("n_new") > 0
    ambiguous = F.when(exact > 0, exact > 1).when(some, partial > 1).otherwise(F.col("n_time") > 1)
    kind = F.when(exact > 0, "EXACT_PAIR").when(F.col("n_old") > 0, "PARTIAL_OLD").when(F.col("n_new") > 0, "PARTIAL_NEW").when(F.col("n_time") > 0, "TIME_ONLY")
    chosen = F.when(exact > 0, F.col("g_both")).when(F.col("n_old") > 0, F.col("g_old")).when(F.col("n_new") > 0, F.col("g_new")).otherwise(F.col("g_time"))
    rows = out.withColumns({"__c": F.when(~ambiguous, chosen), "__k": kind})
    return rows.select(
        *by, "id", "at_ns",
        F.when(ambiguous, "AMBIGUOUS").when(F.col("__c").isNull(), "UNMATCHED").when(F.col("__c.ended_at_ns").isNull(), "PENDING").otherwise("MATCHED").alias("match"),
        F.when(ambiguous, "AMBIGUOUS").when(F.col("__c").isNull(), "NONE").otherwise(F.col("__k")).alias("identity_match"), F.col("__c.gap_id").alias("gap_id"),
    )


EXPLICIT, OVERLAP, UNMARKED, UNKNOWN = "EXPLICIT_SEQUENCE_GAP", "BLUE_GREEN_OVERLAP", "UNMARKED_RECONNECT", "UNKNOWN"
#: The order in which transitions are told (missing connections first).
TRANSITION_ORDER = ("occurred_at_utc_ns", "old_chunk_id", "new_chunk_id", "old_connection_id", "new_connection_id", "boundary_kind")
#: Evidence about one transition, as boolean columns: the first that holds decides. False where it isn't known.
EVIDENCE = (
    ("new_marked", EXPLICIT),  # the new connection's first frame owns up to a gap
    ("old_end_marked", EXPLICIT),  # the old one's last frame does, and isn't its first as well
    ("old_marked", UNKNOWN),  # it does, and may mean the boundary before
    ("overlapped", OVERLAP),  # both frames were caught by deployments that ran at once
    ("old_chunk_marked", EXPLICIT),  # a chunk of one connection was sealed as ended by a reconnect
    ("between_marked", EXPLICIT),  # a chunk without frames, between the two, was
    ("pair_recorded", EXPLICIT),  # an interval names exactly these two connections
    ("partly_recorded", UNKNOWN),  # an interval names one of them, or holds the time, or several do
    ("chunk_evidence", UNKNOWN),  # a chunk has a gap or overlap that can't be told to be here
)


def overlapping(old_flags: Column, new_flags: Column) -> Column:
    """Both frames are marked as overlap, by deployments that are the same or not told."""
    ids = lambda f: F.filter(f, lambda x: x.startswith("deployment_id="))
    same = ((F.size(ids(old_flags)) == 0) & (F.size(ids(new_flags)) == 0)) | F.arrays_overlap(ids(old_flags), ids(new_flags))
    return F.array_contains(old_flags, "blue_green_overlap") & F.array_contains(new_flags, "blue_green_overlap") & same


def frame_transitions(frames: DataFrame, by: list[str], order: list[str], connection: str = "connection_id", flags: str = "capture_flags") -> DataFrame:
    """by..., order..., the two connections, and what the two frames say, wherever a frame's connection isn't the one before's."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = ~F.coalesce(F.lag(connection).over(w).eqNullSafe(F.col(connection)), F.lit(False)) | F.lag(F.lit(1)).over(w).isNull()
    starts = frames.withColumn("__starts", changed)
    before = F.lag(F.struct(F.col(connection).alias("connection"), F.coalesce(F.col(flags), F.array().cast("array<string>")).alias("flags"), F.col("__starts").alias("starts"))).over(w)
    rows = starts.withColumn("__before", before).where(F.col("__starts") & F.col("__before").isNotNull())
    old, new = F.col("__before.flags"), F.coalesce(F.col(flags), F.array().cast("array<string>"))
    marked = F.array_contains(old, "sequence_gap")
    return rows.select(
        *by, *order, F.col("__before.connection").alias("old_connection_id"), F.col(connection).alias("new_connection_id"),
        F.array_contains(new, "sequence_gap").alias("new_marked"), (marked & ~F.col("__before.starts")).alias("old_end_marked"), marked.alias("old_marked"), overlapping(old, new).alias("overlapped"),
    )


def recorded(identity_match: Column) -> list[Column]:
    """Evidence columns of match_intervals()' identity_match."""
    return [(identity_match == "EXACT_PAIR").alias("pair_recorded"), identity_match.isin("PARTIAL_OLD", "PARTIAL_NEW", "TIME_ONLY", "AMBIGUOUS").alias("partly_recorded")]


def transition_kinds(transitions: DataFrame) -> DataFrame:
    """transitions with `kind`, by whichever columns of EVIDENCE they have, in TRANSITION_ORDER as far as they have its columns."""
    kind = F.lit(UNMARKED)
    for name, found in reversed([(n, k) for n, k in EVIDENCE if n in transitions.columns]):
        kind = F.when(F.coalesce(F.col(name), F.lit(False)), found).otherwise(kind)
    out = transitions.withColumn("kind", kind)
    keys = [F.coalesce(F.col(c), F.lit("")) if c.endswith("connection_id") else F.col(c) for c in TRANSITION_ORDER if c in transitions.columns]
    return out.orderBy(*keys) if keys else out


def kind_tallies(classified: DataFrame, by: list[str]) -> DataFrame:
    """Transitions of each key, in all and by kind."""
    of = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    return classified.groupBy(*by).agg(F.count("*").alias("transitions_total"), of(EXPLICIT, "explicit_gap"), of(OVERLAP, "blue_green_overlap"), of(UNMARKED, "unmarked_reconnect"), of(UNKNOWN, "unknown"))


def audit_tallies(classified: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Counts by kind for each key and in all; the total has null keys."""
    return classified.rollup(*by).agg(F.count("*").alias("total"), F.count_if(F.col(kind) == "MATCHED").alias("matched"), F.count_if(F.col(kind) == "UNMATCHED").alias("unmatched"), F.count_if(F.col(kind) == "AMBIGUOUS").alias("ambiguous"), F.count_if(F.col(kind) == "PENDING").alias("pending"))


def gap_counts(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct gaps started, completed and matched."""
    of = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("gap_id")))
    return events.agg(of("STARTED").alias("started"), of("COMPLETED").alias("completed")).crossJoin(matches.agg(F.count_distinct("gap_id").alias("matched")))  # two rows of one


def inventory_digest(paths: DataFrame, path: str = "path") -> dict:
    """SHA-256 of an inventory's paths in order, one to a line, and their count. The sort is distributed; the fold over it streams a
    partition at a time through the driver, since a hash of all has no parts."""
    digest, n = sha256(), 0
    for (one,) in paths.select(path).orderBy(path).toLocalIterator():
        digest.update(b"\n" * (n > 0) + one.encode())
        n += 1
    return {"digest": digest.hexdigest(), "n": n}
