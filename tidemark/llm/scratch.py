"""Intermediate tables in the folder that the whole cluster shares.

A table written there outlives lost executors, cuts lineage, and is never computed twice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Settings for tables whose rows are whole texts. They bound what one batch holds, and change no result.
LONG_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def long_rows(spark: SparkSession) -> None:
    """Smaller batches between scans, the JVM and Python, where the session leaves their size open."""
    for key, value in LONG_ROWS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own, on one machine (tests); a cluster must name its shared one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str = "part", **options: str) -> DataFrame:
    """Writes df as a shared Parquet table and returns that table."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path  # for drop()
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that keep() made and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
