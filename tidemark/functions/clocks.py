"""Integer clocks. Nanoseconds are never a timestamp: Spark's have microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS, FIVE_MINUTES_MS = 86_400_000_000_000, 300_000
#: Where archive rows keep their time; every other data type has it first.
TIMESTAMP_COLUMN = {"aggTrades": 5, "trades": 4}


def ms_to_ns(ms: Column) -> Column:
    return ms.cast("bigint") * 1_000_000


def us_to_ns(us: Column) -> Column:
    return us.cast("bigint") * 1_000


def micros_of(timestamp: Column) -> Column:
    """Microseconds of a timestamp, with or without a zone, read as UTC."""
    return F.unix_micros(timestamp.cast("timestamp"))


def floor_div(x: Column, by: int) -> Column:
    """x / by rounded down, in 64-bit integers all the way."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def as_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1_000))


def utc_date(ns: Column) -> Column:
    return F.date_format(as_timestamp(ns), "yyyy-MM-dd")


def utc_hour(ns: Column) -> Column:
    return F.pmod(floor_div(ns, 3_600_000_000_000), F.lit(24)).cast("tinyint")


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First nanosecond of a UTC day and of the next."""
    start = F.unix_date(F.to_date(day)).cast("bigint") * DAY_NS
    return start, start + DAY_NS


def closed_period(now_ms: Column) -> Column:
    """Start of the last five-minute period that has ended."""
    return floor_div(now_ms, FIVE_MINUTES_MS) * FIVE_MINUTES_MS - FIVE_MINUTES_MS


def receive_lag(receive_ns: Column, event_ms: Column) -> Column:
    """Nanoseconds between event and receipt; null if unknown or negative."""
    lag = receive_ns - ms_to_ns(event_ms)
    return F.when(lag >= 0, lag)


def archive_time_ns(data_type: str, values: Column, unit: str = "ms") -> Column:
    raw = F.get(values, F.lit(TIMESTAMP_COLUMN.get(data_type, 0))).cast("bigint")
    return us_to_ns(raw) if unit == "us" else ms_to_ns(raw)


def month_end(day: Column) -> Column:
    return F.last_day(day)


def next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), 1)


def exchange_gap_seconds(before_ms: Column, after_ms: Column, legacy_units: bool = False) -> Column:
    """Seconds between two exchange clocks; legacy_units takes their milliseconds for nanoseconds, as old reports did."""
    return (after_ms - before_ms) / (1_000_000_000 if legacy_units else 1_000)
