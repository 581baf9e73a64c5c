"""The shared `events` table as captured envelopes, and the named queries that parse, deduplicate, replay and count them.

Each event is a frame of a stream by its type; event_id is its place and its update id, user_id its connection. Every
thirteenth payload is cut off, every eleventh frame is marked as after a gap, and every seventh k has no exchange clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clocks import floor_div
from ..operators import gaps
from ..operators.dedup import build_totals, deduplicate_events, partition_statistics
from ..operators.metrics import envelope_counters
from ..operators.parse import parse
from ..operators.replay import ReplayError, ReplayQuery, consume, order_key, replay
from ..schemas import ENVELOPE, SOURCE
from . import events
from .events import BASE, frames

STREAMS = {"click": ("spot", "diff_depth"), "view": ("spot", "agg_trade"), "purchase": ("spot", "book_ticker"), "signup": ("um_perpetual", "diff_depth"), "error": ("um_perpetual", "agg_trade")}
DAY = "2024-01-10"
DAY_NS = 1_704_844_800_000_000_000
LENGTH_NS = 86_400_000_000_000


def by_type(pick: int) -> Column:
    return reduce(lambda out, t: F.when(F.col("event_type") == t, STREAMS[t][pick]).otherwise(out), STREAMS, F.lit(None).cast("string"))


def payload() -> Column:
    """JSON of each stream's shape."""
    ms, number, price = floor_div(F.col("receive_ns"), 1_000_000).cast("string"), F.col("event_id").cast("string"), F.concat(F.abs("cents").cast("string"), F.lit(".5"))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    depth = lambda more: text('{"e":"depthUpdate","E":', ms, ',"s":"BTCUSDT","U":', number, ',"u":', number, more, ',"b":[["', price, '","1"]],"a":[]}')
    trade = lambda more: text('{"e":"aggTrade","E":', ms, ',"s":"BTCUSDT","a":', number, ',"p":"', price, '","q":"1","f":1,"l":2,"T":', ms, ',"m":true', more, "}")
    ticker = text('{"u":', number, ',"s":"BTCUSDT","b":"', price, '","B":"1","a":"', price, '","A":"2"}')
    own = {"click": depth(F.lit("")), "view": trade(F.lit(',"M":true')), "purchase": ticker, "signup": depth(text(',"T":', ms, ',"pu":', (F.col("event_id") - 1).cast("string"))), "error": trade(F.lit(""))}
    whole = reduce(lambda out, t: F.when(F.col("event_type") == t, own[t]).otherwise(out), own, F.lit(None).cast("string"))
    return F.when(F.pmod("event_id", F.lit(13)) == 0, F.substring(whole, 1, 9)).otherwise(whole)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.pmod("event_id", F.lit(11)) == 0
    none = F.array().cast("array<string>")
    values = {
        "schema_version": F.lit("event-envelope.v1"), "venue": F.lit("v"), "market": by_type(0), "symbol": F.lit("BTCUSDT"), "stream": by_type(1), "module": F.lit("v.spot.v1"),
        "connection_id": F.col("user_id").cast("string"), "collector_instance_id": F.lit("c"), "collector_version": F.lit("1"), "receive_time_utc_ns": F.col("receive_ns"), "receive_monotonic_ns": F.col("event_id"),
        "exchange_event_time": F.when(F.pmod(F.coalesce("k", F.lit(0)), F.lit(7)) != 0, floor_div(F.col("receive_ns"), 1_000_000) - F.col("k")), "exchange_transaction_time": F.lit(None), "exchange_trade_time": F.lit(None),
        "source_sequence": F.create_map(F.lit("u"), F.col("event_id").cast("string")), "payload_encoding": F.lit("utf-8-json"), "raw_payload": payload().cast("binary"),
        "capture_flags": F.when(gap, F.array(F.lit("sequence_gap"))).otherwise(none), "source_chunk_id": F.col("receive_date"), "source_chunk_sha256": F.sha2("receive_date", 256), "source_record_ordinal": F.col("event_id"),
        "source_complete": ~gap, "source_gap": gap, "source_resync": F.lit(False), "source_recovered": F.lit(False), "source_capture_flags": none,
    }
    rows = frames(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism  # parsing is work for each row: a table of fewer splits than cores is dealt out
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    return rows.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in [*ENVELOPE.fields, *SOURCE.fields]))


def parsed(spark, sf_dir) -> DataFrame:
    return parse(envelopes(spark, sf_dir), list(STREAMS.values())).withColumn("event_id", F.col("source_record_ordinal").cast("bigint"))


def replayed(spark, sf_dir, ordered: bool = False, **query) -> DataFrame:
    return replay(parsed(spark, sf_dir), ReplayQuery(**{"gaps": "include", **query}), ordered)


def parse_streams(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", "market", "stream", "event_kind", "valid", "error_code", "first_update_id", "final_update_id", "bids_json")


def replay_receive_order(spark, sf_dir):
    """The order made checkable: each row's place in its stream, by the replay's own key."""
    place = F.row_number().over(Window.partitionBy("market", "stream").orderBy(*order_key("receive"))).cast("bigint")
    return replayed(spark, sf_dir).select("event_id", "market", "stream", "event_time_ns", "unreliable", place.alias("place"))


def replay_exchange_fallback(spark, sf_dir):
    return replayed(spark, sf_dir, clock="exchange", missing_clock="fallback_receive").select("event_id", "event_time_ns", "used_receive_time_fallback")


def replay_exchange_exclude(spark, sf_dir):
    return replayed(spark, sf_dir, clock="exchange", missing_clock="exclude").select("event_id", "event_time_ns")


def gap_policy_exclude(spark, sf_dir):
    return replayed(spark, sf_dir, gaps="exclude").select("event_id", "event_time_ns")


def gap_policy_include(spark, sf_dir):
    return replayed(spark, sf_dir).select("event_id", "event_time_ns", "unreliable")


def replay_refusals(spark, sf_dir):
    """Which policies that fail do fail."""
    cases = {"gaps": {"gaps": "error"}, "gaps of a stream": {"gaps": "error", "markets": ("spot",), "streams": ("none",)}, "missing clock": {"clock": "exchange", "missing_clock": "error"}}
    rows = []
    for name, query in cases.items():
        try:
            replayed(spark, sf_dir, **query)
            rows.append((name, False))
        except ReplayError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "policy string, refused boolean")


def stream_range_filter(spark, sf_dir):
    """Half-open: a day from its first nanosecond to before the next one's, for two streams of a market."""
    return replayed(spark, sf_dir, start_ns=DAY_NS, end_ns=DAY_NS + LENGTH_NS, markets=("spot",), streams=("diff_depth", "agg_trade")).select("event_id", "stream", "event_time_ns")


def checkpoint_seek(spark, sf_dir):
    return replayed(spark, sf_dir, markets=("spot",), streams=("diff_depth",), after_update_id=500).select("event_id", "final_update_id")


def replay_consumer(spark, sf_dir):
    """A consumer's counts and bounds over one day in order."""
    found = consume(replayed(spark, sf_dir, True, start_ns=DAY_NS, end_ns=DAY_NS + LENGTH_NS))
    return spark.createDataFrame([(found["events"], found["first_event_time_ns"], found["last_event_time_ns"])], "events bigint, first_ns bigint, last_ns bigint")


def normalized(spark, sf_dir) -> DataFrame:
    """Valid frames, a fifth of which came over a second connection as well, deduplicated."""
    once = envelopes(spark, sf_dir).where("source_record_ordinal % 13 <> 0")
    again = once.where("source_record_ordinal % 5 = 0").withColumns({"connection_id": F.lit("again"), "receive_time_utc_ns": F.col("receive_time_utc_ns") + 1})
    return deduplicate_events(parse(once.unionByName(again), list(STREAMS.values())))


def dedup_events(spark, sf_dir):
    return normalized(spark, sf_dir).select(F.col("source_record_ordinal").cast("bigint").alias("event_id"), "market", "stream", "connection_id", F.col("duplicate_count").cast("int").alias("duplicate_count"), "identity_conflict")


def partition_stats(spark, sf_dir):
    found = partition_statistics(normalized(spark, sf_dir))
    return found.select("market", "stream", F.col("receive_date").cast("string").alias("receive_date"), F.col("receive_hour").cast("int").alias("receive_hour"), "row_count", F.col("input_candidate_count").cast("bigint").alias("input_candidate_count"), "identity_conflicts", "receive_time_utc_min_ns", "receive_time_utc_max_ns")


def build_total(spark, sf_dir):
    return build_totals(partition_statistics(normalized(spark, sf_dir)))


def metric_counters(spark, sf_dir):
    wanted = ["utc_date", "market", "stream", "websocket_messages", "rest_responses", "accepted", "sequence_gap", "depth_bid_level_updates", "depth_ask_level_updates", "agg_trade_records", "book_ticker_records", "raw_records_written", "first_event_time_utc_ns", "last_event_time_utc_ns"]
    return envelope_counters(envelopes(spark, sf_dir)).select(*(F.col(c).cast("string").alias(c) if c == "utc_date" else F.col(c) for c in wanted))


def path_inventory(spark, sf_dir):
    found = gaps.inventory_digest(frames(spark, sf_dir).select(F.concat(F.lit("raw/"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("path")))
    return spark.createDataFrame([(found["digest"], found["n"])], "digest string, n bigint")


def transition_kinds(spark, sf_dir):
    """Frames of a stream whose connection differs from the one before, told by their own flags and by recorded intervals."""
    e = frames(spark, sf_dir).withColumn("flags", F.when(F.pmod("event_id", F.lit(11)) == 0, F.array(F.lit("sequence_gap"))).when(F.pmod("event_id", F.lit(3)) == 0, F.array(F.lit("blue_green_overlap"))))
    moves = gaps.frame_transitions(e, ["event_type"], ["receive_ns", "event_id"], "user_id", "flags")
    found = events.interval_match(spark, sf_dir).select(F.col("id").alias("event_id"), *gaps.recorded(F.col("identity_match")))
    return gaps.transition_kinds(moves.join(found, "event_id", "left").withColumnRenamed("receive_ns", "occurred_at_utc_ns")).select("event_id", "event_type", "occurred_at_utc_ns", "old_connection_id", "new_connection_id", "kind")


def transition_tallies(spark, sf_dir):
    return gaps.kind_tallies(transition_kinds(spark, sf_dir), ["event_type"])


def cases(pick: int, column: str = "event_type") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN '{s[pick]}'" for t, s in STREAMS.items()) + " END"


#: The same shape in DuckDB.
CAPTURED = BASE + f", c AS (SELECT *, {cases(0)} AS market, {cases(1)} AS stream, event_id % 11 = 0 AS unreliable, event_id % 13 <> 0 AS valid, CASE WHEN coalesce(k, 0) % 7 <> 0 THEN receive_ns // 1000000 - k END AS exchange_ms FROM e) "
DEDUPED = CAPTURED + ", d AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM c WHERE valid) "
KINDS = "WITH m AS (" + events.SQL["interval_match"] + """), f AS (SELECT event_id, event_type, epoch_us(ts) * 1000 AS seen, user_id, event_id % 11 = 0 AS g, event_id % 11 <> 0 AND event_id % 3 = 0 AS o FROM events),
w AS (SELECT *, lag(user_id) OVER x AS oc, lag(g) OVER x AS og, lag(o) OVER x AS oo, lag(user_id, 2) OVER x AS ooc, row_number() OVER x AS n FROM f WINDOW x AS (PARTITION BY event_type ORDER BY seen, event_id)),
k AS (SELECT w.event_id, w.event_type, seen AS occurred_at_utc_ns, oc AS old_connection_id, user_id AS new_connection_id, CASE WHEN g THEN 'EXPLICIT_SEQUENCE_GAP' WHEN og AND n > 2 AND ooc = oc THEN 'EXPLICIT_SEQUENCE_GAP' WHEN og THEN 'UNKNOWN' WHEN oo AND o THEN 'BLUE_GREEN_OVERLAP'
  WHEN m.identity_match = 'EXACT_PAIR' THEN 'EXPLICIT_SEQUENCE_GAP' WHEN m.identity_match <> 'NONE' THEN 'UNKNOWN' ELSE 'UNMARKED_RECONNECT' END AS kind FROM w LEFT JOIN m ON m.id = w.event_id WHERE oc IS NOT NULL AND oc <> user_id) """
SQL = {
    "parse_streams": CAPTURED + "SELECT event_id, market, stream, CASE WHEN valid THEN 'market_event' ELSE 'malformed' END AS event_kind, valid, CASE WHEN NOT valid THEN 'SCHEMA_ERROR:payload is not valid UTF-8 JSON' END AS error_code, CASE WHEN valid AND stream = 'diff_depth' THEN event_id END AS first_update_id, CASE WHEN valid AND stream = 'diff_depth' THEN event_id END AS final_update_id, CASE WHEN valid AND stream = 'diff_depth' THEN '[[\"' || abs(cents) || '.5\",\"1\"]]' END AS bids_json FROM c",
    "replay_receive_order": CAPTURED + "SELECT event_id, market, stream, receive_ns AS event_time_ns, unreliable, row_number() OVER (PARTITION BY market, stream ORDER BY receive_ns, CAST(user_id AS VARCHAR), event_id) AS place FROM c",
    "replay_exchange_fallback": CAPTURED + "SELECT event_id, coalesce(exchange_ms * 1000000, receive_ns) AS event_time_ns, exchange_ms IS NULL AS used_receive_time_fallback FROM c",
    "replay_exchange_exclude": CAPTURED + "SELECT event_id, exchange_ms * 1000000 AS event_time_ns FROM c WHERE exchange_ms IS NOT NULL",
    "gap_policy_exclude": CAPTURED + "SELECT event_id, receive_ns AS event_time_ns FROM c WHERE NOT unreliable",
    "gap_policy_include": CAPTURED + "SELECT event_id, receive_ns AS event_time_ns, unreliable FROM c",
    "replay_refusals": CAPTURED + "SELECT 'gaps' AS policy, bool_or(unreliable) AS refused FROM c UNION ALL SELECT 'gaps of a stream', false UNION ALL SELECT 'missing clock', bool_or(exchange_ms IS NULL) FROM c",
    "stream_range_filter": CAPTURED + f"SELECT event_id, stream, receive_ns AS event_time_ns FROM c WHERE market = 'spot' AND stream IN ('diff_depth', 'agg_trade') AND receive_ns >= {DAY_NS} AND receive_ns < {DAY_NS + LENGTH_NS}",
    "checkpoint_seek": CAPTURED + "SELECT event_id, event_id AS final_update_id FROM c WHERE market = 'spot' AND stream = 'diff_depth' AND valid AND event_id > 500",
    "replay_consumer": CAPTURED + f"SELECT count(*) AS events, min(receive_ns) AS first_ns, max(receive_ns) AS last_ns FROM c WHERE receive_ns >= {DAY_NS} AND receive_ns < {DAY_NS + LENGTH_NS}",
    "dedup_events": DEDUPED + "SELECT event_id, market, stream, CAST(user_id AS VARCHAR) AS connection_id, n AS duplicate_count, false AS identity_conflict FROM d",
    "partition_stats": DEDUPED + "SELECT market, stream, receive_date, receive_hour, count(*) AS row_count, CAST(sum(n) AS BIGINT) AS input_candidate_count, 0::BIGINT AS identity_conflicts, min(receive_ns) AS receive_time_utc_min_ns, max(receive_ns) AS receive_time_utc_max_ns FROM d GROUP BY ALL",
    "build_total": DEDUPED + "SELECT count(DISTINCT (market, stream, receive_date, receive_hour)) AS partitions, count(*) AS row_count, CAST(sum(n) AS BIGINT) AS input_candidate_count, 0::BIGINT AS identity_conflicts FROM d",
    "metric_counters": CAPTURED + "SELECT receive_date AS utc_date, market, stream, count(*) AS websocket_messages, 0::BIGINT AS rest_responses, count(*) AS accepted, count(*) FILTER (unreliable) AS sequence_gap, count(*) FILTER (valid AND stream = 'diff_depth') AS depth_bid_level_updates, 0::BIGINT AS depth_ask_level_updates, count(*) FILTER (stream = 'agg_trade') AS agg_trade_records, count(*) FILTER (stream = 'book_ticker') AS book_ticker_records, count(*) AS raw_records_written, min(receive_ns) AS first_event_time_utc_ns, max(receive_ns) AS last_event_time_utc_ns FROM c GROUP BY ALL",
    "path_inventory": BASE + "SELECT sha256(string_agg('raw/' || lpad(CAST(event_id AS VARCHAR), 9, '0'), chr(10) ORDER BY event_id)) AS digest, count(*) AS n FROM e",
    "transition_kinds": KINDS + "SELECT * FROM k",
    "transition_tallies": KINDS + "SELECT event_type, count(*) AS transitions_total, count(*) FILTER (kind = 'EXPLICIT_SEQUENCE_GAP') AS explicit_gap, count(*) FILTER (kind = 'BLUE_GREEN_OVERLAP') AS blue_green_overlap, count(*) FILTER (kind = 'UNMARKED_RECONNECT') AS unmarked_reconnect, count(*) FILTER (kind = 'UNKNOWN') AS unknown FROM k GROUP BY event_type",
}
QUERIES = {name: globals()[name] for name in SQL}
