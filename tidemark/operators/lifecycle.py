"""Chunk, archive and deployment lifecycles: aggregates, ownership, backlogs and allowed steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Allowed steps of each state machine.
CHUNK_STEPS = "ACTIVE>RECOVERED ACTIVE>SEALING ACTIVE>QUARANTINED RECOVERED>SEALING RECOVERED>QUARANTINED SEALING>SEALED SEALING>QUARANTINED SEALED>ARCHIVE_COPYING ARCHIVE_COPYING>ARCHIVE_VERIFYING ARCHIVE_VERIFYING>ARCHIVED_VERIFIED ARCHIVED_VERIFIED>LOCAL_DELETE_PENDING LOCAL_DELETE_PENDING>LOCAL_DELETED"
ARCHIVE_STEPS = "COPYING>VERIFYING VERIFYING>VERIFIED VERIFIED>LOCAL_DELETE_PENDING LOCAL_DELETE_PENDING>LOCAL_DELETED"
DEPLOYMENT_STEPS = "CANDIDATE_STARTING>CANDIDATE_READY CANDIDATE_STARTING>ROLLED_BACK CANDIDATE_READY>OVERLAP_CONFIRMED CANDIDATE_READY>ROLLED_BACK OVERLAP_CONFIRMED>CUTOVER_COMPLETE OVERLAP_CONFIRMED>ROLLED_BACK"
# End of fixed values.
VERIFIED = ("VERIFIED", "LOCAL_DELETE_PENDING", "LOCAL_DELETED")


def steps(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.split(F.lit(text), " ")).alias("s")).select(F.substring_index("s", ">", 1).alias("from_state"), F.substring_index("s", ">", -1).alias("to_state"))


def forbidden_steps(log: DataFrame, key: str, order: list[str], text: str, state: str = "state") -> DataFrame:
    """Log rows whose step from the state before is not allowed. The table of steps is a constant, so it's broadcast."""
    w = Window.partitionBy(key).orderBy(*order)
    moved = log.withColumn("from_state", F.lag(state).over(w)).where("from_state is not null").withColumnRenamed(state, "to_state")
    return moved.join(F.broadcast(steps(log.sparkSession, text)), ["from_state", "to_state"], "left_anti")


def with_archive(chunks: DataFrame, archive: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with their archive transaction, if any."""
    return chunks.join(archive, key, "left")


def unassigned(sealed: DataFrame, *owners: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Sealed chunks that no owner table has."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), owners, sealed)


def ownership(chunks: DataFrame, local: DataFrame, remote: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Who owns each chunk; both at once is a conflict."""
    l, r = local.select(key, F.col("state").alias("local_state")), remote.select(key, F.col("state").alias("remote_state"))
    own = F.when(F.col("local_state").isNotNull() & F.col("remote_state").isNotNull(), "CONFLICT").when(F.col("remote_state").isNotNull(), "REMOTE").when(F.col("local_state").isNotNull(), "LOCAL").otherwise("NONE")
    return chunks.join(l, key, "left").join(r, key, "left").withColumn("owner", own)


def lifecycle_aggregate(chunks: DataFrame, state: str, size: str, created: str) -> DataFrame:
    """Counts, bytes and the oldest of sealed chunks, in one pass."""
    sealed = F.col(state) == "SEALED"
    return chunks.agg(F.count("*").alias("files"), F.count_if(sealed).alias("sealed_files"), F.coalesce(F.sum(F.when(sealed, F.col(size))), F.lit(0)).alias("sealed_bytes"), F.min(F.when(sealed, F.col(created))).alias("oldest_sealed"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def state_counts(rows: DataFrame, state: str = "state") -> DataFrame:
    return rows.groupBy(state).agg(F.count("*").alias("n"))


def archive_aggregate(chunks: DataFrame, archive: DataFrame, errors: Column, key: str = "chunk_id") -> DataFrame:
    """One row: verified and deleted files and bytes, the backlog, the last verification and the class of the latest error."""
    verified, deleted = F.col("state").isin(*VERIFIED), F.col("state") == "LOCAL_DELETED"
    of = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    has_error = F.length("last_error") > 0
    done = archive.agg(
        F.count_if(verified).alias("verified_files"), of(verified, "bytes").alias("verified_bytes"), F.count_if(deleted).alias("local_deleted_files"), of(deleted, "bytes").alias("local_deleted_bytes"),
        F.count_if(~verified).alias("inflight_files"), F.max("verified_at").alias("last_verified_at"), F.max_by(F.when(has_error, errors), F.when(has_error, F.struct("updated_at", key))).alias("latest_error_type"),
    )
    waiting = unassigned(chunks.where("state = 'SEALED'"), archive, key=key).agg(F.count("*").alias("unassigned_files"))
    return done.crossJoin(waiting).withColumn("backlog_files", F.col("inflight_files") + F.col("unassigned_files"))  # two rows of one


def verify_summary(files: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return files.agg(one("VERIFIED"), one("FAILED"), one("PENDING"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an order whose tail is unique; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def oldest(rows: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def key_conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with several values."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def archive_set_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("set_id").alias("sets"), F.count_distinct("media_id").alias("media"), F.count_distinct("artifact_id").alias("artifacts"))


def select_by(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; None asks nothing."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in wanted.items() if v is not None), F.lit(True)))


def authorized_between(rows: DataFrame, at: str, start, end) -> DataFrame:
    return rows.where((F.col(at) >= start) & (F.col(at) < end))


def match_authority(candidates: DataFrame, authority: DataFrame, key: list[str], digest: str = "sha256") -> DataFrame:
    """Each candidate MATCHED, STALE (another digest) or MISSING in an authority."""
    a = authority.select(*key, F.col(digest).alias("__known"))
    j = candidates.join(a, key, "left")
    return j.withColumn("decision", F.when(F.col("__known").isNull(), "MISSING").when(F.col("__known") == F.col(digest), "MATCHED").otherwise("STALE")).drop("__known")


def decision_counts(decided: DataFrame, column: str = "decision", values: tuple[str, ...] = ("MATCHED", "STALE", "MISSING")) -> DataFrame:
    return decided.agg(*(F.count_if(F.col(column) == v).alias(v.lower()) for v in values))


def seal_flags(chunks: DataFrame, intents: DataFrame, open_gaps: DataFrame) -> DataFrame:
    """Flags that sealing must force on each chunk: those of its intent, and a gap's if its stream has one open; several open ones are a conflict."""
    n = open_gaps.groupBy("market", "stream").agg(F.count("*").alias("n_open"))
    none = F.array().cast("array<string>")
    j = chunks.join(intents.select("chunk_id", "forced_flags"), "chunk_id", "left").join(n, ["market", "stream"], "left")
    flags = F.array_sort(F.array_union(F.coalesce("forced_flags", none), F.when(F.col("n_open") > 0, F.array(F.lit("reconnect_gap"))).otherwise(none)))
    return j.withColumn("flags", flags).withColumn("conflict", F.coalesce(F.col("n_open") > 1, F.lit(False))).drop("forced_flags", "n_open")


def eject_blocked(targets: DataFrame, archive: DataFrame, key: str = "storage_id", final: tuple[str, ...] = ("VERIFIED", "LOCAL_DELETED")) -> DataFrame:
    """Targets that an unfinished transaction still needs."""
    return targets.join(archive.where(~F.col("state").isin(*final)), key, "left_semi")


def status_summary(chunks: DataFrame, now_ns: int, running: bool) -> DataFrame:
    live, sealed = F.col("state").isin("ACTIVE", "RECOVERED", "SEALING"), F.col("state").isin("SEALED", "ARCHIVE_COPYING", "ARCHIVE_VERIFYING")
    age = F.lit(now_ns) - F.max("last_receive_ns") if running else F.lit(None).cast("bigint")
    return chunks.agg(F.count_if(live).alias("open_chunks"), F.count_if(sealed).alias("sealed_chunks"), F.count_if(F.col("state").startswith("LOCAL") | (F.col("state") == "ARCHIVED_VERIFIED")).alias("archived_chunks"), F.count_if(F.col("state") == "QUARANTINED").alias("quarantined_chunks"), age.alias("last_event_age_ns"))


def first_reason(*rules: tuple[Column, str, str]) -> Column:
    """(state, reason) of the first rule that holds: (condition, state, reason); READY if none does."""
    out = None
    for condition, state, reason in rules:
        value = F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    ready = F.struct(F.lit("READY").alias("state"), F.lit(None).cast("string").alias("reason"))
    return ready if out is None else out.otherwise(ready)
