"""Decision ladders: ordered conditions of which the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1 << 30
STATES = ("NORMAL", "WARNING", "CRITICAL", "EMERGENCY", "HARD_RESERVE")
HOUR_NS = 3_600_000_000_000
#: The last nanosecond of the year 9999.
LAST_NS = 253_402_300_799_999_999_999


def ladder(*steps: tuple[Column, object], otherwise: object) -> Column:
    out = None
    for condition, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def percent(total: Column, n: int) -> Column:
    """n hundredths, rounded down in integers."""
    return F.floor(total.cast("decimal(38,0)") * n / 100).cast("bigint")


def emergency_bytes(total: Column) -> Column:
    return F.greatest(F.lit(10 * GIB), percent(total, 5))


def hard_reserve_bytes(total: Column, rotation_bytes: int) -> Column:
    return F.greatest(F.lit(5 * GIB), percent(total, 2), F.lit(2 * rotation_bytes))


def space_severity(total: Column, free: Column) -> Column:
    """Null for an observation that can't be: no capacity, or free space outside it."""
    sane = (total > 0) & (free >= 0) & (free <= total)
    big = lambda c, n: c.cast("decimal(38,0)") * n
    return F.when(sane, ladder((free <= emergency_bytes(total), "EMERGENCY"), (big(free, 100) <= big(total, 15), "CRITICAL"), (big(free, 100) <= big(total, 40), "WARNING"), otherwise="OK"))


def capacity_state(free: Column, hard_reserve: int, emergency: int, critical: int, warning: int) -> Column:
    """By absolute bytes, the worst limit first."""
    return ladder((free <= hard_reserve, "HARD_RESERVE"), (free <= emergency, "EMERGENCY"), (free <= critical, "CRITICAL"), (free <= warning, "WARNING"), otherwise="NORMAL")


def eta(now_ns: Column, free: Column, threshold: Column, rate: Column) -> tuple[Column, Column]:
    """(status, nanosecond) at which free space falls to a threshold, at `rate` bytes a second (null: unknown)."""
    seconds = (free - threshold) / rate
    soon = seconds <= (F.lit(str(LAST_NS)).cast("decimal(38,0)") - now_ns).cast("double") / 1_000_000_000
    at = now_ns.cast("decimal(38,0)") + F.floor(F.when(soon, seconds * 1_000_000_000).try_cast("decimal(38,6)"))
    forecast = (free > threshold) & (rate > 0)
    status = ladder((free <= threshold, "REACHED"), (rate.isNull(), "INSUFFICIENT_DATA"), (rate <= 0, "NOT_APPROACHING"), (~soon, "BEYOND_SUPPORTED_RANGE"), otherwise="FORECAST")
    return status, F.when(free <= threshold, now_ns.cast("decimal(38,0)")).when(forecast & (status == "FORECAST"), at)


def eta_state(status: Column, eta_ns: Column, now_ns: Column) -> Column:
    """Null for a status that doesn't exist."""
    left = eta_ns - now_ns
    by_time = ladder((left <= 24 * HOUR_NS, "EMERGENCY"), (left <= 72 * HOUR_NS, "CRITICAL"), (left <= 7 * 24 * HOUR_NS, "WARNING"), otherwise="NORMAL")
    return F.when(status == "REACHED", "HARD_RESERVE").when(status == "INSUFFICIENT_DATA", "WARNING").when(status.isin("NOT_APPROACHING", "BEYOND_SUPPORTED_RANGE"), "NORMAL").when(status == "FORECAST", by_time)


def worst(*states: Column) -> Column:
    """The gravest of several states."""
    order = F.array(*map(F.lit, STATES))
    return F.element_at(order, F.greatest(*(F.array_position(order, s).cast("int") for s in states)))


def error_kind(text: Column) -> Column:
    """Class of an archive error's text; null for none."""
    low = F.lower(text)
    found = ladder(
        (text.contains("DISAPPEARED"), "DISAPPEARED_DURING_COPY"), (text.contains("SHA") | low.contains("hash"), "HASH_MISMATCH"),
        (low.contains("size") | low.contains("missing"), "MISSING"), (text.contains("ArchiveError"), "ARCHIVE_ERROR"), otherwise="UNKNOWN",
    )
    return F.when(F.length(text) > 0, found)


def request_weight(limit: Column) -> Column:
    """Cost of a depth request; null outside 1 to 5000."""
    return F.when((limit >= 1) & (limit <= 5000), ladder((limit <= 100, 5), (limit <= 500, 25), (limit <= 1000, 50), otherwise=250))


def heartbeat_error(age_ns: Column, interval_seconds: Column) -> Column:
    """Null while fresh: not over 5 s ahead, and not older than three intervals or 30 s."""
    most = (F.greatest(F.lit(30.0), interval_seconds * 3) * 1_000_000_000).cast("bigint")
    return F.when(age_ns < -5_000_000_000, "heartbeat_in_future").when(age_ns > most, "service_heartbeat_stale")


def application_status(active: Column, error: Column, fresh: Column, service_pid: Column, seen_pid: Column, observed: Column) -> Column:
    same = F.when(service_pid.isNull() & seen_pid.isNull(), F.lit(None).cast("boolean")).otherwise(service_pid.eqNullSafe(seen_pid))
    return ladder(
        (error.isNotNull() | active.isNull() | (active == "UNKNOWN"), "UNKNOWN"), (active == "failed", "FAILED"), (active != "active", "NOT_RUNNING"),
        (~F.coalesce(fresh, F.lit(False)), "STALE"), (~F.coalesce(same, F.lit(False)), "UNTRUSTED"), otherwise=F.coalesce(observed, F.lit("UNKNOWN")),
    )


def decimal_of(text: Column, positive: bool) -> Column:
    """A finite decimal that is positive (or not negative); null otherwise, never rounded to fit."""
    value = text.try_cast("decimal(38,18)")
    return F.when(value > 0 if positive else value >= 0, value)


def canonical_decimal(value: Column) -> Column:
    """Plain digits without zeros at the end."""
    text = value.cast("string")
    short = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(F.format_string("%s", value.cast("decimal(38,18)").cast("string")), "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(value == 0, "0").otherwise(short)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_safe_path(text: Column) -> Column:
    """Relative, and never leaving its root."""
    return F.coalesce((F.length(text) > 0) & ~text.startswith("/") & ~text.contains("\\") & ~F.exists(F.split(text, "/"), lambda p: p.isin("", ".", "..")), F.lit(False))
