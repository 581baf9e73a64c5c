"""Table writers that commit whole builds, refuse conflicting repeats and keep states monotone.

Each works on any path that Spark can write. A table that a sink merges into is read, merged and written as a new
version beside the old one; nothing is overwritten in place.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import build_totals, partition_statistics
from ..schemas import partition_columns


class Conflict(ValueError):
    """What is to be written contradicts what is there."""


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; the same bytes again are fine (False), other bytes are an error. The name appears whole or not at all."""
    fs, where = file_system(spark, path)
    if fs.exists(where):
        stream = fs.open(where)
        try:
            old = bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()
        if old != text.encode():
            raise Conflict(path)
        return False
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".partial")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, where):
        raise Conflict(path)
    return True


def write_rows(rows: DataFrame, path: str, files_per_partition: int = 1) -> None:
    """Normalized rows as zstd Parquet by market, stream, date and hour. Rows of a partition meet in a few tasks, so
    it has few files; a hot partition is dealt to more with files_per_partition."""
    keys = partition_columns()
    salt = [] if files_per_partition == 1 else [F.pmod(F.xxhash64("logical_record_sha256"), F.lit(files_per_partition))]
    rows.repartition(*keys, *salt).sortWithinPartitions(*keys, "receive_time_utc_ns").write.option("compression", "zstd").partitionBy(*keys).parquet(path)


def build_id(sources: DataFrame, checkpoints: list[str] | None = None) -> str:
    """A content address over source chunks (one short row for each) and checkpoints."""
    h = hashlib.sha256()
    for row in sources.select("uncompressed_sha256", "chunk_id").distinct().orderBy("uncompressed_sha256", "chunk_id").toLocalIterator():
        h.update(f"{row[0]}:{row[1]}\n".encode())
    for c in sorted(checkpoints or []):
        h.update(f"checkpoint:{c}\n".encode())
    return h.hexdigest()


def write_build(rows: DataFrame, path: str, identity: str) -> dict:
    """Rows, then statistics read back from them, then a manifest; without the manifest there is no build."""
    spark = rows.sparkSession
    write_rows(rows, f"{path}/{identity}/rows")
    back = spark.read.schema(rows.schema).parquet(f"{path}/{identity}/rows")
    statistics = partition_statistics(back)
    statistics.write.parquet(f"{path}/{identity}/statistics")
    totals = build_totals(spark.read.schema(statistics.schema).parquet(f"{path}/{identity}/statistics")).first().asDict()
    body = {"build_id": identity, **totals}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    write_once(spark, f"{path}/{identity}/manifest.json", json.dumps({"body": body, "sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True))
    return body


def append_new(batch: DataFrame, table: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Of rows of metric batches, those whose batch the table hasn't: a batch is written whole once, however often it comes,
    and a batch that is known is left out whole, even where a retry brings other rows."""
    return batch.join(table.select(batch_id).distinct(), batch_id, "left_anti").select(*(F.col(f"`{c}`") for c in batch.columns))


def insert_events(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows to add: exact repeats of known events are left out; a known key with other content is an error."""
    content = [c for c in batch.columns if c != key]
    digest = lambda d: d.select(key, F.sha2(F.to_json(F.struct(*content)), 256).alias("d"))
    both = digest(batch).unionByName(digest(table)).groupBy(key).agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").limit(1).collect()
    if both:
        raise Conflict(f"event {both[0][0]}")
    return batch.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def advance_cursors(batch: DataFrame, cursors: DataFrame, key: str, position: str) -> DataFrame:
    """New cursors: the greatest position of each key. Going back is an error, standing still is nothing."""
    new = batch.groupBy(key).agg(F.max(position).alias("__new"))
    j = cursors.join(new, key, "full")
    back = j.where(F.col("__new") < F.col(position)).limit(1).collect()
    if back:
        raise Conflict(f"cursor {back[0][key]} goes back")
    return j.select(key, F.coalesce("__new", position).alias(position))


def apply_transitions(requests: DataFrame, current: DataFrame, allowed: DataFrame, key: str, log: DataFrame | None = None, order: tuple[str, ...] = ("requested_at_ns", "idempotency_key")) -> tuple[DataFrame, DataFrame]:
    """(states after the requests, rows to add to the log of transitions).

    requests(key, from_state, to_state, idempotency_key, requested_at_ns) of one key are taken in `order`, each from the state that the one
    before it reached; a request whose idempotency_key the log has already happened and is nothing. One that doesn't start where its
    key stands, a step that isn't allowed, an unknown key, or two contents of one idempotency_key are errors, and nothing is applied.
    """
    content = F.struct(key, "from_state", "to_state")
    twice = requests.groupBy("idempotency_key").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").limit(1).collect()
    if twice:
        raise Conflict(f"idempotency key {twice[0][0]}")
    new = requests.groupBy("idempotency_key", key, "from_state", "to_state").agg(*(F.min(c).alias(c) for c in order if c != "idempotency_key"))
    if log is not None:
        new = new.join(log.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    chain = Window.partitionBy(key).orderBy(*order)
    steps = new.join(current.select(key, F.col("state").alias("__now")), key, "left").withColumn("__at", F.coalesce(F.lag("to_state").over(chain), "__now"))
    steps = steps.join(F.broadcast(allowed.select("from_state", "to_state").distinct().withColumn("__ok", F.lit(True))), ["from_state", "to_state"], "left")  # a fixed table of states
    bad = steps.where(~(F.coalesce(F.col("__at") == F.col("from_state"), F.lit(False)) & F.coalesce("__ok", F.lit(False)))).limit(1).collect()
    if bad:
        raise Conflict(f"{bad[0][key]}: {bad[0]['from_state']} to {bad[0]['to_state']}")
    moved = new.groupBy(key).agg(F.max_by("to_state", F.struct(*order)).alias("__to"))
    states = current.join(moved, key, "left").withColumn("state", F.coalesce("__to", "state")).drop("__to")
    return states, steps.select(key, "from_state", "to_state", *dict.fromkeys(("idempotency_key", *order)))


def severity_log(samples: DataFrame, by: list[str], order: list[str], severity: Column) -> DataFrame:
    """One alert for each change of severity."""
    from ..operators.quality import severity_changes

    return severity_changes(samples.withColumn("severity", severity), by, order, "severity")


def flat_columns(df: DataFrame) -> list[Column]:
    """Every leaf of nested structs as a column of its own, named by its path; arrays and maps as JSON."""
    out: list[Column] = []

    def walk(path: str, kind) -> None:
        if kind.typeName() == "struct":
            for f in kind.fields:
                walk(f"{path}.`{f.name}`", f.dataType)
        else:
            name = path.replace("`", "")
            column = F.col(path)
            out.append((F.to_json(column) if kind.typeName() in ("array", "map") else column).alias(name))

    for f in df.schema.fields:
        walk(f"`{f.name}`", f.dataType)
    return sorted(out, key=lambda c: c._jc.toString())


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines and as flat CSV."""
    report.write.mode("error").json(f"{path}/json")
    report.select(*flat_columns(report)).write.mode("error").option("header", True).csv(f"{path}/csv")


def write_audit(spark: SparkSession, path: str, body: dict) -> str:
    """A canonical JSON body in a wrapper with its hash."""
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    digest = hashlib.sha256(text.encode()).hexdigest()
    write_once(spark, path, json.dumps({"body": body, "sha256": digest}, sort_keys=True, ensure_ascii=False))
    return digest
