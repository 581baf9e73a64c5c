"""The shared `events` table in the shape of captured frames, and the named queries over it.

ts is the receive clock, event_type the stream, user_id the connection, value the content and props.k a sequence number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import floor_div, micros_of, us_to_ns, utc_date, utc_hour
from ..operators import gaps, metrics, quality
from ..operators.dedup import content_digest, deduplicate
from ..operators.forecast import pair_rates

HOUR_NS, FIVE_MINUTES_NS = 3_600_000_000_000, 300_000_000_000

#: The same shape in DuckDB.
BASE = """WITH e AS (SELECT event_id, epoch_us(ts) * 1000 AS receive_ns, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  strftime(ts, '%Y-%m-%d') AS receive_date, CAST(extract(hour FROM ts) AS INTEGER) AS receive_hour FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ns = us_to_ns(micros_of(F.col("ts")))
    e = e.select("event_id", ns.alias("receive_ns"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.withColumns({"receive_date": utc_date(F.col("receive_ns")), "receive_hour": utc_hour(F.col("receive_ns")).cast("int")})


def envelope_projection(spark, sf_dir):
    return frames(spark, sf_dir).where("k is not null").select("event_id", "receive_ns", "receive_date", "receive_hour", F.col("event_type").alias("stream"), "k")


def keyed(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("semantic", F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "receive_date")).withColumn("logical", F.pmod("cents", F.lit(3)).cast("string"))


def semantic_dedup(spark, sf_dir):
    out = deduplicate(keyed(spark, sf_dir), ["semantic"], ["logical"], ["receive_ns", "event_id"])
    return out.select("semantic", "logical", "event_id", "duplicate_count", "identity_conflict")


def identity_conflicts(spark, sf_dir):
    out = deduplicate(keyed(spark, sf_dir), ["semantic"], ["logical"], ["receive_ns", "event_id"])
    return out.agg(F.count_if("identity_conflict").alias("conflict_rows"), F.count("*").alias("n_rows"), F.sum("duplicate_count").alias("candidates"))


def dup_lineage_rows(spark, sf_dir):
    from ..operators.dedup import lineage_rows

    return lineage_rows(keyed(spark, sf_dir), ["semantic"], ["logical"], ["receive_ns", "event_id"])


def dup_lineage(spark, sf_dir):
    out = deduplicate(keyed(spark, sf_dir), ["semantic"], ["logical"], ["receive_ns", "event_id"])
    return out.select("semantic", "logical", F.array_join(F.transform("sources", lambda s: s["event_id"].cast("string")), ",").alias("lineage"))


def connection_transitions(spark, sf_dir):
    e = frames(spark, sf_dir)
    return quality.transitions(e, ["event_type", "receive_date"], ["receive_ns", "event_id"], connection="user_id", flags=None)


def first_connection_frames(spark, sf_dir):
    e = frames(spark, sf_dir)
    return quality.first_frames(e, ["event_type", "receive_date"], ["receive_ns", "event_id"], connection="user_id").select("event_id", "event_type", "user_id")


def gap_events(spark, sf_dir):
    """Clicks start a gap of their user and day, purchases end it."""
    e = frames(spark, sf_dir)
    return e.where(F.col("event_type").isin("click", "purchase")).select(
        F.when(F.col("event_type") == "click", "STARTED").otherwise("COMPLETED").alias("kind"), F.lit("m").alias("market"), F.lit("s").alias("stream"),
        F.concat_ws("/", F.col("user_id").cast("string"), "receive_date").alias("gap_id"), F.col("receive_ns").alias("at_ns"), F.col("k").cast("string").alias("connection"), F.col("k").alias("generation"), "event_id",
    )


GAPS = BASE + """, g AS (SELECT CASE event_type WHEN 'click' THEN 'STARTED' ELSE 'COMPLETED' END AS kind, user_id || '/' || receive_date AS gap_id, receive_ns AS at_ns, CAST(k AS VARCHAR) AS connection, k AS generation, event_id
  FROM e WHERE event_type IN ('click', 'purchase')),
s AS (SELECT * FROM g WHERE kind = 'STARTED' QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY at_ns DESC, event_id DESC) = 1),
c AS (SELECT * FROM g WHERE kind = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY at_ns DESC, event_id DESC) = 1)
"""


def open_gaps(spark, sf_dir):
    return gaps.open_gaps(gap_events(spark, sf_dir)).select("gap_id", "at_ns", "event_id")


def closed_gap_pairs(spark, sf_dir):
    return gaps.closed_gaps(gap_events(spark, sf_dir), ["at_ns", "event_id"]).select("gap_id", F.col("s.at_ns").alias("started_ns"), F.col("e.at_ns").alias("ended_ns"), F.col("s.event_id").alias("start_event"), F.col("e.event_id").alias("end_event"))


def degraded_pairs(spark, sf_dir):
    """Generations count from 50 here, so that some are negative."""
    return gaps.degraded_pairs(gap_events(spark, sf_dir).withColumn("generation", F.col("generation") - 50), ["at_ns", "event_id"]).select("gap_id")


def malformed_gap_events(spark, sf_dir):
    """Evidence of which some is cut off, some a list, and some without a market, stream or gap_id."""
    case = F.pmod("event_id", F.lit(8))
    e = gap_events(spark, sf_dir).withColumn("evidence", F.when(case == 0, '{"market":').when(case == 1, '["m"]').otherwise('{"market":"m"}'))
    e = e.withColumns({"market": F.when(case != 2, F.col("market")), "stream": F.when(case == 3, "").otherwise(F.col("stream")), "gap_id": F.when(case != 4, F.col("gap_id"))})
    return gaps.malformed_events(e, "evidence").select("event_id", "reason")


def gap_lifecycle(spark, sf_dir):
    e = frames(spark, sf_dir)
    return gaps.lifecycle(e, ["user_id"], F.col("event_type") == "click", F.col("event_type") == "purchase")


def interval_match(spark, sf_dir):
    """Frames as transitions between neighbours in a stream and day, against the gaps of clicks and purchases."""
    e = frames(spark, sf_dir)
    t = e.select(F.lit("m").alias("market"), F.lit("s").alias("stream"), F.col("event_id").alias("id"), F.col("receive_ns").alias("at_ns"), F.concat_ws("/", F.col("user_id").cast("string"), "receive_date").alias("old_connection"), F.col("k").cast("string").alias("new_connection"))
    g = gaps.intervals(gap_events(spark, sf_dir), ["at_ns", "event_id"]).withColumn("original_connection", F.col("gap_id")).where("ended_at_ns is null or ended_at_ns - started_at_ns between 0 and 3600000000000")
    return gaps.match_intervals(t, g, ["market", "stream"], HOUR_NS).select("id", "match", "identity_match", "gap_id")


def lags(spark, sf_dir):
    """Nanoseconds that a frame's content stands for, over the histogram's whole range."""
    return frames(spark, sf_dir).withColumn("lag", F.abs("cents") * 1_000_003)


def histogram_counts(spark, sf_dir):
    return metrics.histogram(lags(spark, sf_dir), ["event_type"], "lag")


def histogram_percentiles(spark, sf_dir):
    counts = metrics.histogram(lags(spark, sf_dir), ["event_type"], "lag")
    return metrics.percentile(counts, ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def daily_rollup(spark, sf_dir):
    e = frames(spark, sf_dir)
    day = e.groupBy("receive_date", "event_type").agg(F.count("*").alias("websocket_messages"), F.sum("cents").alias("raw_bytes_written"))
    batches = day.select(F.col("receive_date").alias("utc_date"), F.lit("m").alias("market"), F.col("event_type").alias("stream"), "websocket_messages", "raw_bytes_written")
    return metrics.daily_report(batches, "2024-01-10").select("stream", "websocket_messages", "raw_bytes_written", "lifetime_websocket_messages", "lifetime_raw_bytes_written")


def pair_rate_median(spark, sf_dir):
    """Each connection's samples as free space: the median rate between neighbours."""
    e = frames(spark, sf_dir).withColumn("total", F.lit(1))
    rates = pair_rates(e, ["user_id"], "receive_ns", "total", "cents", ["event_id"])
    return rates.groupBy("user_id").agg((F.round(F.percentile("rate", F.lit(0.5)), 4) + 0.0).alias("median_rate"), F.count("rate").alias("n_rates"))


def period_gaps(spark, sf_dir):
    """Half-hours of a stream's own span without a frame."""
    e = frames(spark, sf_dir).select("event_type", (floor_div(F.col("receive_ns"), 6 * FIVE_MINUTES_NS)).alias("period")).distinct()
    return quality.missing_periods(e, ["event_type"], "period", 1)


def severity_changes(spark, sf_dir):
    e = frames(spark, sf_dir).withColumn("severity", F.when(F.col("cents") <= 500, "CRITICAL").when(F.col("cents") <= 2000, "WARNING").otherwise("OK"))
    return quality.severity_changes(e, ["user_id"], ["receive_ns", "event_id"], "severity").select("event_id", "user_id", "severity", "previous_severity")


def clock_jumps(spark, sf_dir):
    """Wall clocks against a monotonic one that counts frames: jumps of over an hour."""
    return quality.clock_discontinuities(frames(spark, sf_dir), ["event_type"], "receive_ns", "event_id", HOUR_NS).select("event_type", "started_at_ns", "ended_at_ns", "duration_ns")


def stream_union(spark, sf_dir):
    e = frames(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("event_id", "receive_ns", F.col("k").alias("update_id"))
    buys = e.where("event_type = 'purchase'").select("event_id", "receive_ns", F.col("cents").alias("price"))
    return clicks.unionByName(buys, allowMissingColumns=True)


def audit_rollup(spark, sf_dir):
    e = frames(spark, sf_dir).withColumn("kind", F.when(F.pmod("event_id", F.lit(3)) == 0, "MATCHED").when(F.pmod("event_id", F.lit(3)) == 1, "UNMATCHED").otherwise("PENDING"))
    return gaps.audit_tallies(e, ["event_type"], "kind")


def wait_percentiles(spark, sf_dir):
    counts = metrics.histogram(lags(spark, sf_dir).withColumn("lag", F.col("lag") * 10), ["event_type"], "lag", metrics.WAIT_BOUNDS)
    return metrics.wait_percentile(counts, ["event_type"], {"p50": 0.5, "p99": 0.99})


def metric_merge(spark, sf_dir):
    """A user's frames as batches: additive counts, bounds, and a gauge's greatest and last value."""
    e = frames(spark, sf_dir).select("user_id", F.lit(1).cast("bigint").alias("n"), F.col("receive_ns").alias("first"), F.col("receive_ns").alias("last"), F.col("cents").alias("depth_max"), F.col("cents").alias("depth_last"), F.col("receive_ns").alias("committed_at_ns"), F.col("event_id").alias("batch_id"))
    return metrics.merge(e, ["user_id"], ["n"], ("first",), ("last",), ("depth",))


def chunk_boundaries(spark, sf_dir):
    """Hours of a stream as chunks; every third is empty and marks the boundary after it."""
    e = frames(spark, sf_dir)
    h = e.groupBy("event_type", floor_div(F.col("receive_ns"), HOUR_NS).alias("hour")).agg(F.min_by("user_id", F.struct("receive_ns", "event_id")).alias("first_connection"), F.max_by("user_id", F.struct("receive_ns", "event_id")).alias("last_connection"), F.count("*").alias("record_count"))
    empty = F.pmod("hour", F.lit(3)) == 0
    h = h.withColumns({"chunk_id": F.col("hour").cast("string"), "record_count": F.when(empty, 0).otherwise(F.col("record_count"))})
    b = quality.boundaries(h, ["event_type"], ["hour"])
    return b.select("event_type", "hour", "previous_chunk", "chunk_id", "old_connection", "new_connection", F.array_join("markers", ",").alias("markers"), "is_transition")


def recovery_gaps(spark, sf_dir):
    """Periods since each stream's last that a source may still have, or has no longer."""
    from ..operators.backfill import recovery_gaps as gaps_of

    e = frames(spark, sf_dir)
    seen = e.select("event_type", (floor_div(F.col("receive_ns"), FIVE_MINUTES_NS) * 300_000).alias("period_ms"))
    return gaps_of(seen, ["event_type"], now_ms=1_706_800_000_000, retention_ms=3_600_000)


def chunk_completeness(spark, sf_dir):
    """Hours of a stream as chunks with flags: complete, gap, and the flag that unproven reconnects force."""
    e = frames(spark, sf_dir)
    h = e.groupBy("event_type", floor_div(F.col("receive_ns"), HOUR_NS).alias("hour")).agg(F.array_sort(F.collect_set(F.col("user_id").cast("string"))).alias("connection_ids"), F.min("event_id").alias("least"))
    flags = F.when(F.pmod("least", F.lit(3)) == 0, F.array(F.lit("sequence_gap"))).when(F.pmod("least", F.lit(3)) == 1, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))
    done = quality.completeness(h.withColumn("capture_flags", flags), F.pmod("least", F.lit(2)) == 0)
    return done.select("event_type", "hour", F.array_join("capture_flags", ",").alias("flags"), "complete", "gap")


def content_digests(spark, sf_dir):
    """Order-free digests agree however rows are dealt: the difference of two ways is zero."""
    e = frames(spark, sf_dir)
    digest = lambda d: d.groupBy("event_type").agg(content_digest(F.col("event_type"), F.col("event_id")).alias("d"))
    both = digest(e).withColumnRenamed("d", "a").join(digest(e.repartition(5, "user_id")), "event_type")
    return both.select("event_type", (F.col("a") == F.col("d")).alias("same"))


SQL = {
    "envelope_projection": BASE + "SELECT event_id, receive_ns, receive_date, receive_hour, event_type AS stream, k FROM e WHERE k IS NOT NULL",
    "connection_transitions": BASE + "SELECT * FROM (SELECT event_type, receive_date, receive_ns, event_id, lag(user_id) OVER (PARTITION BY event_type, receive_date ORDER BY receive_ns, event_id) AS old_connection, user_id AS new_connection FROM e) WHERE old_connection <> new_connection",
    "first_connection_frames": BASE + "SELECT event_id, event_type, user_id FROM (SELECT *, lag(user_id) OVER (PARTITION BY event_type, receive_date ORDER BY receive_ns, event_id) AS o FROM e) WHERE o IS NULL OR o <> user_id",
    "open_gaps": GAPS + "SELECT gap_id, at_ns, event_id FROM g WHERE kind = 'STARTED' AND gap_id NOT IN (SELECT gap_id FROM g WHERE kind = 'COMPLETED')",
    "closed_gap_pairs": GAPS + "SELECT s.gap_id, s.at_ns AS started_ns, c.at_ns AS ended_ns, s.event_id AS start_event, c.event_id AS end_event FROM s JOIN c USING (gap_id)",
    "degraded_pairs": GAPS + "SELECT s.gap_id FROM s JOIN c USING (gap_id) WHERE s.generation < 50 OR c.generation < 50",
    "malformed_gap_events": GAPS + "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'evidence_not_json' WHEN 1 THEN 'evidence_not_object' WHEN 2 THEN 'missing_market' WHEN 3 THEN 'missing_stream' ELSE 'missing_gap_id' END AS reason FROM g WHERE event_id % 8 < 5",
    "gap_lifecycle": BASE + "SELECT user_id, CASE WHEN bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') THEN 'CLOSED' WHEN bool_or(event_type = 'click') THEN 'OPEN' ELSE 'ABSENT' END AS state FROM e GROUP BY user_id",
    "interval_match": GAPS + """, i AS (SELECT s.gap_id, s.at_ns AS a, c.at_ns AS b, c.connection AS nc FROM s LEFT JOIN c USING (gap_id) WHERE c.at_ns IS NULL OR c.at_ns - s.at_ns BETWEEN 0 AND 3600000000000),
t AS (SELECT event_id AS id, receive_ns AS at, user_id || '/' || receive_date AS oc, CAST(k AS VARCHAR) AS nc FROM e),
p AS (SELECT t.id, i.gap_id, i.b, CASE WHEN t.oc = i.gap_id AND t.nc = i.nc THEN 'EXACT_PAIR' WHEN t.oc = i.gap_id THEN 'PARTIAL_OLD' WHEN t.nc = i.nc THEN 'PARTIAL_NEW' ELSE 'TIME_ONLY' END AS kind
  FROM t JOIN i ON t.oc = i.gap_id OR t.nc = i.nc OR (i.a <= t.at AND (i.b IS NULL OR t.at <= i.b))),
q AS (SELECT id, count(*) FILTER (kind = 'EXACT_PAIR') AS x, count(*) FILTER (kind LIKE 'PARTIAL%') AS y, count(*) FILTER (kind = 'TIME_ONLY') AS z FROM p GROUP BY id),
r AS (SELECT q.*, CASE WHEN x = 1 THEN 'EXACT_PAIR' WHEN x = 0 AND y = 1 THEN 'PARTIAL' WHEN x = 0 AND y = 0 AND z = 1 THEN 'TIME_ONLY' ELSE 'AMBIGUOUS' END AS d FROM q),
w AS (SELECT r.id, r.d, p.gap_id, p.b, p.kind FROM r LEFT JOIN p ON p.id = r.id AND r.d <> 'AMBIGUOUS' AND p.kind LIKE r.d || '%')
SELECT t.id, CASE WHEN w.id IS NULL THEN 'UNMATCHED' WHEN w.d = 'AMBIGUOUS' THEN 'AMBIGUOUS' WHEN w.b IS NULL THEN 'PENDING' ELSE 'MATCHED' END AS match,
  CASE WHEN w.id IS NULL THEN 'NONE' WHEN w.d = 'AMBIGUOUS' THEN 'AMBIGUOUS' ELSE w.kind END AS identity_match, w.gap_id FROM t LEFT JOIN w USING (id)""",
    "daily_rollup": BASE + "SELECT event_type AS stream, count(*) FILTER (receive_date = '2024-01-10') AS websocket_messages, CAST(coalesce(sum(cents) FILTER (receive_date = '2024-01-10'), 0) AS BIGINT) AS raw_bytes_written, count(*) AS lifetime_websocket_messages, CAST(sum(cents) AS BIGINT) AS lifetime_raw_bytes_written FROM e WHERE receive_date <= '2024-01-10' GROUP BY event_type",
    "pair_rate_median": BASE + "SELECT user_id, round(quantile_cont(rate, 0.5), 4) + 0.0 AS median_rate, count(rate) AS n_rates FROM (SELECT user_id, CASE WHEN receive_ns > lag(receive_ns) OVER w THEN CAST(lag(cents) OVER w - cents AS DOUBLE) * 1000000000 / (receive_ns - lag(receive_ns) OVER w) END AS rate FROM e WINDOW w AS (PARTITION BY user_id ORDER BY receive_ns, event_id)) GROUP BY user_id",
    "period_gaps": BASE + ", p AS (SELECT DISTINCT event_type, receive_ns // 1800000000000 AS period FROM e), s AS (SELECT event_type, min(period) AS a, max(period) AS b FROM p GROUP BY event_type), x AS (SELECT event_type, unnest(range(a, b + 1)) AS period FROM s) SELECT event_type, period FROM x WHERE (event_type, period) NOT IN (SELECT event_type, period FROM p)",
    "severity_changes": BASE + "SELECT event_id, user_id, severity, previous_severity FROM (SELECT *, lag(severity) OVER (PARTITION BY user_id ORDER BY receive_ns, event_id) AS previous_severity FROM (SELECT *, CASE WHEN cents <= 500 THEN 'CRITICAL' WHEN cents <= 2000 THEN 'WARNING' ELSE 'OK' END AS severity FROM e)) WHERE previous_severity IS DISTINCT FROM severity",
    "clock_jumps": BASE + "SELECT event_type, w + greatest(m, 0) AS started_at_ns, receive_ns AS ended_at_ns, receive_ns - w - m AS duration_ns FROM (SELECT *, lag(receive_ns) OVER x AS w, event_id - lag(event_id) OVER x AS m FROM e WINDOW x AS (PARTITION BY event_type ORDER BY event_id, receive_ns)) WHERE receive_ns - w - m >= 3600000000000",
    "metric_merge": BASE + "SELECT user_id, count(*) AS n, min(receive_ns) AS first, max(receive_ns) AS last, max(cents) AS depth_max, arg_max(cents, (receive_ns, event_id)) AS depth_last FROM e GROUP BY user_id",
    "chunk_boundaries": BASE + ", h AS (SELECT event_type, receive_ns // 3600000000000 AS hour, arg_min(user_id, (receive_ns, event_id)) AS fc, arg_max(user_id, (receive_ns, event_id)) AS lc FROM e GROUP BY ALL), f AS (SELECT *, lag(hour) OVER w AS p, lag(lc) OVER w AS oc FROM h WHERE hour % 3 <> 0 WINDOW w AS (PARTITION BY event_type ORDER BY hour)) SELECT f.event_type, f.hour, CAST(p AS VARCHAR) AS previous_chunk, CAST(f.hour AS VARCHAR) AS chunk_id, oc AS old_connection, fc AS new_connection, coalesce((SELECT string_agg(CAST(m.hour AS VARCHAR), ',' ORDER BY m.hour) FROM h m WHERE m.event_type = f.event_type AND m.hour % 3 = 0 AND m.hour > f.p AND m.hour < f.hour), '') AS markers, oc <> fc AS is_transition FROM f WHERE p IS NOT NULL",
    "recovery_gaps": BASE + ", c AS (SELECT event_type, max(receive_ns // 300000000000) * 300000 AS cursor FROM e GROUP BY event_type), d AS (SELECT event_type, unnest(range(cursor + 300000, 1706800000000 // 300000 * 300000, 300000)) AS period_ms FROM c) SELECT event_type, period_ms, CASE WHEN period_ms < 1706800000000 - 3600000 THEN 'SIDE_DATA_UNRECOVERABLE_GAP' ELSE 'SIDE_DATA_CATCH_UP' END AS event FROM d",
    "chunk_completeness": BASE + ", h AS (SELECT event_type, receive_ns // 3600000000000 AS hour, count(DISTINCT user_id) AS n, min(event_id) AS least FROM e GROUP BY ALL), x AS (SELECT *, least % 3 <> 0 AND n > 1 AND least % 2 = 0 AS forced FROM h) SELECT event_type, hour, CASE WHEN least % 3 = 0 THEN 'sequence_gap' WHEN least % 3 = 1 AND forced THEN 'duplicate,reconnect_gap' WHEN least % 3 = 1 THEN 'duplicate' WHEN forced THEN 'reconnect_gap' ELSE '' END AS flags, NOT (least % 3 = 0 OR forced) AS complete, least % 3 = 0 OR forced AS gap FROM x",
    "stream_union": BASE + "SELECT event_id, receive_ns, k AS update_id, NULL::BIGINT AS price FROM e WHERE event_type = 'click' UNION ALL SELECT event_id, receive_ns, NULL, cents FROM e WHERE event_type = 'purchase'",
    "audit_rollup": BASE + "SELECT event_type, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS matched, count(*) FILTER (event_id % 3 = 1) AS unmatched, 0::BIGINT AS ambiguous, count(*) FILTER (event_id % 3 = 2) AS pending FROM e GROUP BY ROLLUP (event_type)",
    "content_digests": BASE + "SELECT DISTINCT event_type, true AS same FROM e",
}
KEYED = BASE + ", y AS (SELECT *, user_id || '|' || event_type || '|' || receive_date AS semantic, CAST(((cents % 3) + 3) % 3 AS VARCHAR) AS logical FROM e), d AS (SELECT semantic, logical, arg_min(event_id, (receive_ns, event_id)) AS event_id, CAST(count(*) AS INTEGER) AS duplicate_count, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY receive_ns, event_id) AS lineage FROM y GROUP BY semantic, logical), v AS (SELECT *, count(*) OVER (PARTITION BY semantic) > 1 AS identity_conflict FROM d) "
BOUNDS = ", ".join(f"({b})" for b in metrics.BOUNDS)
HISTOGRAM = BASE + f", b AS (SELECT * FROM (VALUES {BOUNDS}) t(bound)), l AS (SELECT event_type, abs(cents) * 1000003 AS lag FROM e), h AS (SELECT event_type, (SELECT min(bound) FROM b WHERE bound >= lag) AS bound, count(*) AS n FROM l GROUP BY ALL) "
SQL |= {
    "semantic_dedup": KEYED + "SELECT semantic, logical, event_id, duplicate_count, identity_conflict FROM v",
    "identity_conflicts": KEYED + "SELECT count(*) FILTER (identity_conflict) AS conflict_rows, count(*) AS n_rows, CAST(sum(duplicate_count) AS BIGINT) AS candidates FROM v",
    "dup_lineage_rows": KEYED + "SELECT y.semantic, y.logical, y.receive_ns, y.event_id, y.event_id = d.event_id AS is_winner FROM y JOIN d USING (semantic, logical)",
    "dup_lineage": KEYED + "SELECT semantic, logical, lineage FROM v",
    "histogram_counts": HISTOGRAM + "SELECT event_type, coalesce(CAST(bound AS VARCHAR), 'overflow') AS bucket, n FROM h",
    "histogram_percentiles": HISTOGRAM + ", r AS (SELECT event_type, coalesce(bound, 60000000000) AS v, sum(n) OVER (PARTITION BY event_type ORDER BY coalesce(bound, 4611686018427387904)) AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM h) SELECT event_type, CAST(min(v) FILTER (run >= greatest(1, floor(total * 0.5 + 0.999999999))) AS BIGINT) AS p50, CAST(min(v) FILTER (run >= greatest(1, floor(total * 0.95 + 0.999999999))) AS BIGINT) AS p95, CAST(min(v) FILTER (run >= greatest(1, floor(total * 0.99 + 0.999999999))) AS BIGINT) AS p99, CAST(max(total) AS BIGINT) AS total FROM r GROUP BY event_type",
}
WAITS = ", ".join(f"({b})" for b in metrics.WAIT_BOUNDS)
SQL["wait_percentiles"] = BASE + f", b AS (SELECT * FROM (VALUES {WAITS}) t(bound)), l AS (SELECT event_type, abs(cents) * 10000030 AS lag FROM e), h AS (SELECT event_type, coalesce((SELECT min(bound) FROM b WHERE bound >= lag), 4611686018427387904) AS bound, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bound) AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM h), p AS (SELECT event_type, min(bound) FILTER (run >= ceil(total * 0.5)) AS a, min(bound) FILTER (run >= ceil(total * 0.99)) AS b FROM r GROUP BY event_type) SELECT event_type, CASE WHEN a = 4611686018427387904 THEN 'overflow' ELSE CAST(a AS VARCHAR) END AS p50, CASE WHEN b = 4611686018427387904 THEN 'overflow' ELSE CAST(b AS VARCHAR) END AS p99 FROM p"
QUERIES = {name: globals()[name] for name in SQL}
