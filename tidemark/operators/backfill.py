"""Which archive files cover a range of days, and how large they are."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan(spark: SparkSession, start: date, end: date, datasets: list[tuple[str, int]], monthly_only: tuple[str, ...] = ("fundingRate",)) -> DataFrame:
    """(data_type, granularity, first_day, last_day, estimated_bytes): a whole month inside the range is one monthly file, other days daily ones.

    datasets: (data type, estimated bytes a day). Monthly-only types take every month that the range touches.
    """
    if end < start:
        raise ValueError("the end precedes the start")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day")).withColumn("month", F.trunc("day", "month").cast("date"))
    months = days.groupBy("month").agg(F.count("*").alias("n")).withColumn("month_last", F.last_day("month"))
    whole = months.withColumn("whole", F.col("n") == F.dayofmonth("month_last"))
    types = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(t).alias("data_type"), F.lit(b).cast("bigint").alias("per_day")) for t, b in datasets))))
    every = whole.join(F.broadcast(types))  # a constant list of data types
    only = F.col("data_type").isin(*monthly_only)
    monthly = every.where(only | F.col("whole")).select("data_type", F.lit("monthly").alias("granularity"), F.col("month").alias("first_day"), F.col("month_last").alias("last_day"), (F.col("per_day") * F.dayofmonth("month_last")).alias("estimated_bytes"))
    daily = days.join(every.where(~only & ~F.col("whole")).select("month", "data_type", "per_day"), "month").select("data_type", F.lit("daily").alias("granularity"), F.col("day").alias("first_day"), F.col("day").alias("last_day"), F.col("per_day").alias("estimated_bytes"))
    return monthly.unionByName(daily)


def totals(planned: DataFrame) -> DataFrame:
    return planned.agg(F.count("*").alias("files"), F.sum("estimated_bytes").alias("estimated_bytes"))


def recovery_gaps(observed: DataFrame, by: list[str], now_ms: int, retention_ms: int, step: int = 300_000) -> DataFrame:
    """Closed periods since each key's cursor that were never observed, and whether the source still has them."""
    span = observed.groupBy(*by).agg(F.max("period_ms").alias("cursor"))
    last = now_ms // step * step - step
    due = span.where(F.col("cursor") < last).select(*by, F.explode(F.sequence(F.col("cursor") + step, F.lit(last).cast("bigint"), F.lit(step).cast("bigint"))).alias("period_ms"))
    return due.withColumn("event", F.when(F.col("period_ms") < now_ms - retention_ms, "SIDE_DATA_UNRECOVERABLE_GAP").otherwise("SIDE_DATA_CATCH_UP"))
