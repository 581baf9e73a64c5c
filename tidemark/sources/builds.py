"""Builds by their explicit id, operational catalogs, and small files that the driver reads."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema_for, supported
from ..sinks.tables import file_system
from .tables import IncompleteSource, read_build, verify_rows


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        raise IncompleteSource(path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest's body, if its hash is right."""
    found = json.loads(read_text(spark, path))
    text = json.dumps(found["body"], sort_keys=True, separators=(",", ":"))
    if hashlib.sha256(text.encode()).hexdigest() != found["sha256"]:
        raise IncompleteSource(f"{path}: hash differs")
    return found["body"]


def list_builds(spark: SparkSession, root: str) -> list[str]:
    """Ids of builds that have a manifest. There is no latest one: a reader names the build it wants."""
    fs, where = file_system(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    has = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/manifest.json"))
    return sorted(n for n in names if has(n))


class Build:
    """One verified build: its manifest, statistics, and rows of a stream by the partitions its statistics list."""

    def __init__(self, spark: SparkSession, root: str, build_id: str):
        if len(build_id) != 64 or not set(build_id) <= set("0123456789abcdef"):
            raise IncompleteSource(f"not a build id: {build_id}")
        self.spark, self.path = spark, f"{root}/{build_id}"
        self.manifest = read_manifest(spark, f"{self.path}/manifest.json")
        if self.manifest["build_id"] != build_id:
            raise IncompleteSource("the manifest is another build's")

    def statistics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/statistics")

    def rows(self, market: str, stream: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """A stream's rows, of some days if asked: files of other days aren't listed, let alone read."""
        own = self.statistics().where((F.col("market") == market) & (F.col("stream") == stream))
        own = own if first_day is None else own.where(F.col("receive_date") >= first_day)
        own = own if last_day is None else own.where(F.col("receive_date") <= last_day)
        listed = own.select("receive_date", "receive_hour", "row_count").collect()  # a row for each hour
        if not listed:
            return self.spark.createDataFrame([], schema_for(market, stream))
        paths = [f"{self.path}/rows/market={market}/stream={stream}/receive_date={r.receive_date}/receive_hour={r.receive_hour}" for r in listed]
        return read_build(self.spark, paths, market, stream)

    def verify(self) -> None:
        """Row counts of every stream against its statistics; the totals against the manifest."""
        counts = {(r.market, r.stream): r.n for r in self.statistics().groupBy("market", "stream").agg(F.sum("row_count").alias("n")).collect()}
        if sum(counts.values()) != self.manifest["row_count"]:
            raise IncompleteSource("totals differ from the manifest's")
        for (market, stream), n in counts.items():
            if (market, stream) not in supported():
                raise IncompleteSource(f"{market}/{stream}")
            verify_rows(self.rows(market, stream), n)


def read_catalog(spark: SparkSession, table: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A catalog table, read only: from its Parquet export, or by JDBC where a driver is on the class path."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc, dbtable=table).load()
    return spark.read.parquet(f"{path}/{table}")


def config_hash(config: dict, removed: tuple[str, ...] = ()) -> str:
    """SHA-256 of a configuration without keys that don't change what it does."""
    kept = {k: v for k, v in config.items() if k not in removed}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
