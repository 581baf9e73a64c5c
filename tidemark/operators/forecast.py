"""Storage growth: rates between samples, medians over windows, and when space runs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import emergency_bytes, eta, hard_reserve_bytes, percent

WINDOWS = {"1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}
SECOND = 1_000_000_000


def pair_rates(samples: DataFrame, by: list[str], at: str, total: str, free: str, tie: list[str] | None = None) -> DataFrame:
    """Bytes used a second from each sample to the next; pairs of another total, or without time between them, have none."""
    w = Window.partitionBy(*by).orderBy(at, *(tie or []))
    d = samples.withColumn("__t", F.lag(total).over(w)).withColumn("__f", F.lag(free).over(w)).withColumn("__at", F.lag(at).over(w))
    elapsed = F.col(at) - F.col("__at")
    rate = F.when((F.col(total) == F.col("__t")) & (elapsed > 0), (F.col("__f") - F.col(free)).cast("double") * SECOND / elapsed)
    return d.withColumn("rate", rate).withColumn("previous_at", F.col("__at")).drop("__t", "__f", "__at")


def window_rates(samples: DataFrame, by: list[str], now_ns: int, at: str = "observed_at_utc_ns", total: str = "total_bytes", free: str = "free_bytes", tie: list[str] | None = None) -> DataFrame:
    """The median rate of each window that ends now: AVAILABLE if samples cover 80 % of it and the last is at most 20 % old.

    A window takes its own samples and, as an anchor, the last one before it if that is at most 20 % of the window
    early. Each sample is copied to at most four windows.
    """
    seen = samples.where(F.col(at) <= now_ns)
    rates = pair_rates(seen, by, at, total, free, tie)
    spans = F.array(*(F.struct(F.lit(name).alias("window"), F.lit(s * SECOND).cast("bigint").alias("span")) for name, s in WINDOWS.items()))
    each = rates.select("*", F.inline(spans)).withColumn("cutoff", F.lit(now_ns) - F.col("span"))
    after = F.lead(at).over(Window.partitionBy(*by, "window").orderBy(at, *(tie or [])))
    inside = F.col(at) > F.col("cutoff")
    last_before = ~inside & (after.isNull() | (after > F.col("cutoff")))
    each = each.withColumn("__anchor", last_before & (F.col("cutoff") - F.col(at) <= F.col("span") * 0.2)).withColumn("__inside", inside).where("__anchor or __inside")
    first = F.min(at).over(Window.partitionBy(*by, "window"))
    each = each.withColumn("rate", F.when(F.col("previous_at") >= first, F.col("rate")))
    agg = each.groupBy(*by, "window").agg(F.count("*").alias("sample_count"), F.min(at).alias("a"), F.max(at).alias("b"), F.first("span").alias("span"), F.percentile("rate", F.lit(0.5)).alias("median"))
    covered = (F.col("b") - F.col("a")) / SECOND
    enough = (F.col("sample_count") >= 2) & (covered >= F.col("span") / SECOND * 0.8) & (now_ns - F.col("b") <= F.col("span") * 0.2) & F.col("median").isNotNull()
    return agg.select(*by, "window", "sample_count", F.round(covered, 6).alias("covered_seconds"), F.when(enough, "AVAILABLE").otherwise("INSUFFICIENT_DATA").alias("status"), F.when(enough, F.round("median", 6)).alias("bytes_per_second"))


def conservative_rate(windows: DataFrame, by: list[str]) -> DataFrame:
    """The greatest of the windows' medians."""
    return windows.groupBy(*by).agg(F.max("bytes_per_second").alias("bytes_per_second"))


def thresholds(total: Column, rotation_bytes: int) -> dict[str, Column]:
    return {"warning_40_percent": percent(total, 40), "critical_15_percent": percent(total, 15), "emergency": emergency_bytes(total), "hard_reserve": hard_reserve_bytes(total, rotation_bytes), "exhausted": F.lit(0)}


def forecast(samples: DataFrame, by: list[str], now_ns: int, rotation_bytes: int = 128 << 20, at: str = "observed_at_utc_ns") -> DataFrame:
    """For each scope and threshold: when free space falls to it, at the greatest of the window medians."""
    rate = conservative_rate(window_rates(samples, by, now_ns, at), by)
    last = samples.where(F.col(at) <= now_ns).groupBy(*by).agg(F.max_by(F.struct("total_bytes", "free_bytes"), at).alias("s")).select(*by, "s.*")
    limits = F.array(*(F.struct(F.lit(n).alias("threshold"), c.cast("bigint").alias("threshold_bytes")) for n, c in thresholds(F.col("total_bytes"), rotation_bytes).items()))
    rows = last.join(rate, by, "left").select("*", F.inline(limits))
    status, when = eta(F.lit(now_ns), F.col("free_bytes"), F.col("threshold_bytes"), F.col("bytes_per_second"))
    return rows.withColumn("status", status).withColumn("eta_ns", when)
