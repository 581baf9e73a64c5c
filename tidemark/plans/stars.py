"""Named queries over the shared star tables: books from line items, lifecycles from orders, capacity from accounts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import ladders
from ..functions.clocks import micros_of, us_to_ns
from ..operators import backfill, book, gaps, lifecycle, quality
from .events import frames, table

GIB = 1 << 30
#: Orders as chunks: their status is the state, their price in cents the size.
ORDERS = "WITH o AS (SELECT o_orderkey AS chunk_id, CASE o_orderstatus WHEN 'F' THEN 'SEALED' WHEN 'O' THEN 'ACTIVE' ELSE 'QUARANTINED' END AS state, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, epoch_us(o_orderdate) * 1000 AS created_ns, o_custkey, o_orderpriority FROM orders) "


def chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "SEALED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("QUARANTINED")
    return o.select(F.col("o_orderkey").alias("chunk_id"), state.alias("state"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("bytes"), us_to_ns(micros_of(F.col("o_orderdate"))).alias("created_ns"), "o_custkey", "o_orderpriority")


#: Line items as levels: the supplier is the symbol, the part the price, the quantity absolute; quantities below 5 remove the level.
LEVELS = "WITH l AS (SELECT l_suppkey AS symbol, CASE WHEN l_partkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE l_partkey + 2000000 END AS price, CASE WHEN l_quantity < 5 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS t FROM lineitem), s AS (SELECT symbol, side, price, arg_max(quantity, (l_orderkey, l_linenumber, t)) AS quantity FROM l GROUP BY ALL HAVING arg_max(quantity, (l_orderkey, l_linenumber, t)) > 0) "


def levels(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    even = F.pmod("l_partkey", F.lit(2)) == 0
    return l.select(F.col("l_suppkey").alias("symbol"), F.when(even, "bid").otherwise("ask").alias("side"), F.when(even, F.col("l_partkey")).otherwise(F.col("l_partkey") + 2_000_000).alias("price"), F.when(F.col("l_quantity") < 5, 0).otherwise(F.col("l_quantity").cast("bigint")).cast("bigint").alias("quantity"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("t"))


def book_latest_level(spark, sf_dir):
    return book.latest_levels(levels(spark, sf_dir), ["symbol", "side"], "price", "quantity", ["l_orderkey", "l_linenumber", "t"])


def best_level(spark, sf_dir):
    return book.best_levels(book_latest_level(spark, sf_dir), ["symbol"])


def ticker_compare(spark, sf_dir):
    """Tickers that tell every third symbol's best prices wrong, against the books."""
    b = best_level(spark, sf_dir).withColumn("update_id", F.lit(10).cast("bigint")).withColumn("reliable", F.pmod("symbol", F.lit(5)) != 0)
    wrong = (F.pmod("symbol", F.lit(3)) == 0).cast("bigint")
    t = best_level(spark, sf_dir).select("symbol", (F.lit(9) + F.pmod("symbol", F.lit(4))).cast("bigint").alias("update_id"), (F.col("best_bid") + wrong).alias("t_bid"), F.col("bid_quantity").alias("t_bid_quantity"), F.col("best_ask").alias("t_ask"), F.col("ask_quantity").alias("t_ask_quantity"))
    return book.compare_ticker(t, b, ["symbol"]).select("symbol", "comparison")


def sequence_continuity(spark, sf_dir):
    """Orders of a customer as updates: the key is the final id, a span of 50 its first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("final"), (F.col("o_orderkey") - 4000).alias("first"), us_to_ns(micros_of(F.col("o_orderdate"))).alias("at"))
    return quality.continuity(o, ["o_custkey"], ["at", "final"], "first", "final").select("final", "continuity", "previous_top")


def bridging(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    updates = o.where("o_orderstatus <> 'P'").select(F.pmod("o_custkey", F.lit(7)).alias("symbol"), (F.col("o_orderkey") - 3).alias("first_update_id"), F.col("o_orderkey").alias("final_update_id"))
    snapshots = o.where("o_orderstatus = 'P'").select(F.pmod("o_custkey", F.lit(7)).alias("symbol"), F.col("o_orderkey").alias("last_update_id"))
    return book.bridging_update(updates, snapshots, ["symbol"], spot=True)


def lifecycle_aggregate(spark, sf_dir):
    return lifecycle.lifecycle_aggregate(chunks(spark, sf_dir), "state", "bytes", "created_ns")


def archive_rows(spark, sf_dir):
    """Archive transactions: the first line item of every other order."""
    l = table(spark, sf_dir, "lineitem").where((F.col("l_linenumber") == 1) & (F.pmod("l_orderkey", F.lit(2)) == 0))
    return l.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.max(F.when(F.col("l_returnflag") == "R", "VERIFIED").when(F.col("l_returnflag") == "A", "LOCAL_DELETED").otherwise("COPYING")).alias("state"), F.max(F.col("l_quantity").cast("bigint")).alias("bytes"), F.max(us_to_ns(micros_of(F.col("l_shipdate")))).alias("updated_at"))


ARCHIVE = "a AS (SELECT l_orderkey AS chunk_id, max(CASE l_returnflag WHEN 'R' THEN 'VERIFIED' WHEN 'A' THEN 'LOCAL_DELETED' ELSE 'COPYING' END) AS state, max(CAST(l_quantity AS BIGINT)) AS bytes, max(epoch_us(l_shipdate) * 1000) AS updated_at FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0 GROUP BY l_orderkey) "


def archive_aggregate(spark, sf_dir):
    a = archive_rows(spark, sf_dir).withColumn("verified_at", F.when(F.col("state") != "COPYING", F.col("updated_at"))).withColumn("last_error", F.when(F.pmod("chunk_id", F.lit(6)) == 0, "SHA differs").when(F.pmod("chunk_id", F.lit(6)) == 2, "size differs"))
    return lifecycle.archive_aggregate(chunks(spark, sf_dir).select("chunk_id", "state"), a, ladders.error_kind(F.col("last_error")))


def unassigned_anti(spark, sf_dir):
    sealed = chunks(spark, sf_dir).where("state = 'SEALED'")
    remote = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("chunk_id"))
    return lifecycle.unassigned(sealed, archive_rows(spark, sf_dir), remote).select("chunk_id", "bytes")


def ownership_left_join(spark, sf_dir):
    remote = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.max("l_linestatus").alias("state"))
    return lifecycle.ownership(chunks(spark, sf_dir).select("chunk_id"), archive_rows(spark, sf_dir), remote).select("chunk_id", "local_state", "remote_state", "owner")


def oldest_topk(spark, sf_dir):
    return lifecycle.oldest(chunks(spark, sf_dir).where("state = 'SEALED'"), ["created_ns", "chunk_id"], 10).select("chunk_id", "created_ns")


def latest_error(spark, sf_dir):
    return lifecycle.latest(chunks(spark, sf_dir).select("o_custkey", "chunk_id", "created_ns", "state"), ["o_custkey"], ["created_ns", "chunk_id"])


def state_counts(spark, sf_dir):
    return lifecycle.state_counts(chunks(spark, sf_dir))


def key_conflicts(spark, sf_dir):
    return lifecycle.key_conflicts(chunks(spark, sf_dir), ["o_custkey"], "state")


def authority_match(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", F.sha2(F.col("state"), 256).alias("sha256"))
    known = archive_rows(spark, sf_dir).select("chunk_id", F.sha2(F.when(F.pmod("chunk_id", F.lit(4)) == 0, "SEALED").otherwise("ACTIVE"), 256).alias("sha256"))
    return lifecycle.decision_counts(lifecycle.match_authority(c, known, ["chunk_id"]))


def capacity_state(spark, sf_dir):
    """Customers as volumes of 100 GiB whose balance is what is free."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(100 * GIB).alias("total"), F.greatest(F.lit(0), F.round(F.col("c_acctbal") * 1_000_000).cast("bigint")).alias("free"))
    c = c.withColumn("free", F.least("free", "total") * 8)
    state = ladders.capacity_state(F.col("free"), 5 * GIB, 10 * GIB, 20 * GIB, 40 * GIB)
    return c.select("c_custkey", state.alias("state"), ladders.space_severity(F.col("total"), F.col("free")).alias("severity"))


def eta_case(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") * 100).cast("bigint").alias("free"), F.when(F.pmod("s_suppkey", F.lit(4)) != 0, (F.pmod("s_suppkey", F.lit(3)) - 1).cast("double")).alias("rate"))
    now = F.lit(1_700_000_000_000_000_000)
    status, at = ladders.eta(now, F.col("free"), F.lit(100_000), F.col("rate"))
    severity = ladders.eta_state(F.col("status"), F.col("eta_ns"), now)
    return c.select("s_suppkey", status.alias("status"), at.cast("bigint").alias("eta_ns")).select("s_suppkey", "status", "eta_ns", severity.alias("severity"), ladders.worst(severity, F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "CRITICAL").otherwise("NORMAL")).alias("worst"))


def request_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 101 - 60).alias("limit"))
    return p.select("p_partkey", ladders.request_weight(F.col("limit")).alias("weight"))


def inventory_digest(spark, sf_dir):
    paths = chunks(spark, sf_dir).select(F.concat(F.lit("chunk/"), F.col("chunk_id").cast("string")).alias("path"), F.floor(F.col("chunk_id") / 1000).cast("bigint").alias("folder"))
    return paths.groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("path")), "\n"), 256).alias("digest"), F.count("*").alias("n"))


def backfill_plan(spark, sf_dir):
    p = backfill.plan(spark, date(2024, 1, 15), date(2024, 4, 10), [("aggTrades", 1000), ("fundingRate", 10)])
    return p.select("data_type", "granularity", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "estimated_bytes")


def forbidden_steps(spark, sf_dir):
    """An order's items as its log: states by ship mode of each item, in order of line number."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.col("l_partkey").alias("p"), F.element_at(F.array(*map(F.lit, ("ACTIVE", "SEALING", "SEALED", "QUARANTINED"))), F.pmod("l_partkey", F.lit(4)).cast("int") + 1).alias("state"))
    bad = lifecycle.forbidden_steps(l, "chunk_id", ["l_linenumber", "p"], lifecycle.CHUNK_STEPS)
    return bad.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def verify_summary(spark, sf_dir):
    files = chunks(spark, sf_dir).select(F.when(F.col("state") == "SEALED", "VERIFIED").when(F.col("state") == "ACTIVE", "PENDING").otherwise("FAILED").alias("state"))
    return lifecycle.verify_summary(files)


def archive_set_counts(spark, sf_dir):
    return lifecycle.archive_set_counts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_shipdate").alias("media_id"), F.col("l_orderkey").alias("artifact_id")))


def status_summary(spark, sf_dir):
    return lifecycle.status_summary(chunks(spark, sf_dir).withColumn("last_receive_ns", F.col("created_ns")), 2_000_000_000_000_000_000, True)


def seal_flags(spark, sf_dir):
    """Customers' orders as chunks of (segment, priority) streams; sealed ones forced, and urgent streams with open gaps."""
    c = chunks(spark, sf_dir).select("chunk_id", F.pmod("o_custkey", F.lit(9)).cast("string").alias("market"), F.col("o_orderpriority").alias("stream"))
    intents = chunks(spark, sf_dir).where("state = 'SEALED'").select("chunk_id", F.array(F.lit("recovered_tail")).alias("forced_flags"))
    gaps_open = c.where(F.col("stream").startswith("1") & (F.pmod("chunk_id", F.lit(50)) == 0)).select("market", "stream")
    return lifecycle.seal_flags(c, intents, gaps_open).select("chunk_id", F.array_join("flags", ",").alias("flags"), "conflict")


def eject_blocked(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("storage_id"))
    busy = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_suppkey").alias("storage_id"), F.when(F.col("l_returnflag") == "R", "VERIFIED").otherwise("COPYING").alias("state"))
    return lifecycle.eject_blocked(targets, busy)


def readiness_ladder(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    low, odd = F.col("s_acctbal") < 0, F.pmod("s_nationkey", F.lit(5)) == 0
    r = lifecycle.first_reason((low, "FAILED", "no_balance"), (odd, "NOT_READY", "region_closed"), (F.col("s_acctbal") < 1000, "NOT_READY", "low_balance"))
    return s.select("s_suppkey", r.alias("r")).select("s_suppkey", "r.state", "r.reason")


def backfill_totals(spark, sf_dir):
    return backfill.totals(backfill.plan(spark, date(2024, 1, 15), date(2024, 4, 10), [("aggTrades", 1000), ("fundingRate", 10)]))


def canonical_sides(spark, sf_dir):
    """Books as text: bids from the highest, asks from the lowest."""
    b = book.canonical_sides(book_latest_level(spark, sf_dir), ["symbol"], depth=5)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["price"].cast("string"), x["quantity"].cast("string"))), " ")
    return b.select("symbol", text("bids").alias("bids"), text("asks").alias("asks"))


def gap_counts(spark, sf_dir):
    e = frames(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")).select(F.when(F.col("event_type") == "click", "STARTED").otherwise("COMPLETED").alias("kind"), F.col("user_id").alias("gap_id"))
    return gaps.gap_counts(e, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gap_id")))


SQL = {
    "book_latest_level": LEVELS + "SELECT symbol, side, price, quantity FROM s",
    "best_level": LEVELS + "SELECT symbol, max(price) FILTER (side = 'bid') AS best_bid, arg_max(quantity, price) FILTER (side = 'bid') AS bid_quantity, min(price) FILTER (side = 'ask') AS best_ask, arg_min(quantity, price) FILTER (side = 'ask') AS ask_quantity, coalesce(max(price) FILTER (side = 'bid') >= min(price) FILTER (side = 'ask'), false) AS crossed, count(*) FILTER (side = 'bid') = 0 OR count(*) FILTER (side = 'ask') = 0 AS empty_side FROM s GROUP BY symbol",
    "ticker_compare": LEVELS + ", y AS (SELECT symbol, max(price) FILTER (side = 'bid') AS b, min(price) FILTER (side = 'ask') AS a FROM s GROUP BY symbol) SELECT symbol, CASE WHEN symbol % 5 = 0 THEN 'UNAVAILABLE' WHEN 9 + symbol % 4 < 10 THEN 'STALE' WHEN 9 + symbol % 4 > 10 THEN 'AHEAD' WHEN symbol % 3 <> 0 AND a IS NOT NULL AND b IS NOT NULL THEN 'MATCH' ELSE 'MISMATCH' END AS comparison FROM y",
    "sequence_continuity": "SELECT final, CASE WHEN previous_top IS NULL THEN 'START' WHEN final <= previous_top THEN 'STALE' WHEN final - 4000 > previous_top + 1 THEN 'GAP' ELSE 'OK' END AS continuity, previous_top FROM (SELECT o_orderkey AS final, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_top FROM orders)",
    "bridging": "WITH s AS (SELECT o_custkey % 7 AS symbol, o_orderkey AS last_update_id FROM orders WHERE o_orderstatus = 'P'), u AS (SELECT o_custkey % 7 AS symbol, o_orderkey - 3 AS first_update_id, o_orderkey AS final_update_id FROM orders WHERE o_orderstatus <> 'P') SELECT s.symbol, s.last_update_id, u.first_update_id, u.final_update_id, CASE WHEN u.symbol IS NULL THEN 'NEED_MORE_EVENTS' WHEN u.first_update_id <= s.last_update_id + 1 THEN 'SYNCHRONIZED' ELSE 'SNAPSHOT_TOO_OLD' END AS result FROM s ASOF LEFT JOIN u ON s.symbol = u.symbol AND s.last_update_id + 1 <= u.final_update_id",
    "lifecycle_aggregate": ORDERS + "SELECT count(*) AS files, count(*) FILTER (state = 'SEALED') AS sealed_files, CAST(coalesce(sum(bytes) FILTER (state = 'SEALED'), 0) AS BIGINT) AS sealed_bytes, min(created_ns) FILTER (state = 'SEALED') AS oldest_sealed, CAST(sum(bytes) AS BIGINT) AS bytes FROM o",
    "archive_aggregate": ORDERS + ", " + ARCHIVE + ", f AS (SELECT *, CASE WHEN state <> 'COPYING' THEN updated_at END AS verified_at, CASE chunk_id % 6 WHEN 0 THEN 'HASH_MISMATCH' WHEN 2 THEN 'MISSING' END AS err FROM a), w AS (SELECT count(*) AS unassigned_files FROM o WHERE state = 'SEALED' AND chunk_id NOT IN (SELECT chunk_id FROM a)) SELECT count(*) FILTER (state <> 'COPYING') AS verified_files, CAST(coalesce(sum(bytes) FILTER (state <> 'COPYING'), 0) AS BIGINT) AS verified_bytes, count(*) FILTER (state = 'LOCAL_DELETED') AS local_deleted_files, CAST(coalesce(sum(bytes) FILTER (state = 'LOCAL_DELETED'), 0) AS BIGINT) AS local_deleted_bytes, count(*) FILTER (state = 'COPYING') AS inflight_files, max(verified_at) AS last_verified_at, arg_max(err, (updated_at, chunk_id)) FILTER (err IS NOT NULL) AS latest_error_type, max(unassigned_files) AS unassigned_files, count(*) FILTER (state = 'COPYING') + max(unassigned_files) AS backlog_files FROM f, w",
    "unassigned_anti": ORDERS + ", " + ARCHIVE + "SELECT chunk_id, bytes FROM o WHERE state = 'SEALED' AND NOT EXISTS (SELECT 1 FROM a WHERE a.chunk_id = o.chunk_id) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.chunk_id AND l_linestatus = 'O')",
    "ownership_left_join": ORDERS + ", " + ARCHIVE + ", r AS (SELECT l_orderkey AS chunk_id, max(l_linestatus) AS state FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) SELECT o.chunk_id, a.state AS local_state, r.state AS remote_state, CASE WHEN a.state IS NOT NULL AND r.state IS NOT NULL THEN 'CONFLICT' WHEN r.state IS NOT NULL THEN 'REMOTE' WHEN a.state IS NOT NULL THEN 'LOCAL' ELSE 'NONE' END AS owner FROM o LEFT JOIN a USING (chunk_id) LEFT JOIN r USING (chunk_id)",
    "oldest_topk": ORDERS + "SELECT chunk_id, created_ns FROM o WHERE state = 'SEALED' ORDER BY created_ns, chunk_id LIMIT 10",
    "latest_error": ORDERS + "SELECT o_custkey, chunk_id, created_ns, state FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY created_ns DESC, chunk_id DESC) = 1",
    "state_counts": ORDERS + "SELECT state, count(*) AS n FROM o GROUP BY state",
    "key_conflicts": ORDERS + "SELECT o_custkey, count(DISTINCT state) AS n_values FROM o GROUP BY o_custkey HAVING count(DISTINCT state) > 1",
    "authority_match": ORDERS + ", " + ARCHIVE + "SELECT count(*) FILTER (o.state = CASE WHEN a.chunk_id % 4 = 0 THEN 'SEALED' ELSE 'ACTIVE' END AND a.chunk_id IS NOT NULL) AS matched, count(*) FILTER (a.chunk_id IS NOT NULL AND o.state <> CASE WHEN a.chunk_id % 4 = 0 THEN 'SEALED' ELSE 'ACTIVE' END) AS stale, count(*) FILTER (a.chunk_id IS NULL) AS missing FROM o LEFT JOIN a USING (chunk_id)",
    "capacity_state": f"WITH c AS (SELECT c_custkey, {100 * GIB} AS total, least(greatest(0, CAST(round(c_acctbal * 1000000) AS BIGINT)), {100 * GIB}) * 8 AS free FROM customer) SELECT c_custkey, CASE WHEN free <= {5 * GIB} THEN 'HARD_RESERVE' WHEN free <= {10 * GIB} THEN 'EMERGENCY' WHEN free <= {20 * GIB} THEN 'CRITICAL' WHEN free <= {40 * GIB} THEN 'WARNING' ELSE 'NORMAL' END AS state, CASE WHEN free > total THEN NULL WHEN free <= greatest({10 * GIB}, total * 5 // 100) THEN 'EMERGENCY' WHEN free * 100 <= total * 15 THEN 'CRITICAL' WHEN free * 100 <= total * 40 THEN 'WARNING' ELSE 'OK' END AS severity FROM c",
    "eta_case": "WITH c AS (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS free, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 - 1 END AS rate FROM supplier), d AS (SELECT s_suppkey, CASE WHEN free <= 100000 THEN 'REACHED' WHEN rate IS NULL THEN 'INSUFFICIENT_DATA' WHEN rate <= 0 THEN 'NOT_APPROACHING' ELSE 'FORECAST' END AS status, CASE WHEN free <= 100000 THEN 1700000000000000000 WHEN rate > 0 THEN 1700000000000000000 + (free - 100000) // rate * 1000000000 END AS eta_ns FROM c), f AS (SELECT *, CASE status WHEN 'REACHED' THEN 'HARD_RESERVE' WHEN 'INSUFFICIENT_DATA' THEN 'WARNING' WHEN 'NOT_APPROACHING' THEN 'NORMAL' ELSE CASE WHEN eta_ns - 1700000000000000000 <= 86400000000000 THEN 'EMERGENCY' WHEN eta_ns - 1700000000000000000 <= 259200000000000 THEN 'CRITICAL' WHEN eta_ns - 1700000000000000000 <= 604800000000000 THEN 'WARNING' ELSE 'NORMAL' END END AS severity FROM d) SELECT s_suppkey, status, CAST(eta_ns AS BIGINT) AS eta_ns, severity, CASE WHEN s_suppkey % 2 = 0 AND severity IN ('NORMAL', 'WARNING') THEN 'CRITICAL' ELSE severity END AS worst FROM f",
    "request_weights": "SELECT p_partkey, CAST(CASE WHEN n < 1 OR n > 5000 THEN NULL WHEN n <= 100 THEN 5 WHEN n <= 500 THEN 25 WHEN n <= 1000 THEN 50 ELSE 250 END AS INTEGER) AS weight FROM (SELECT p_partkey, p_size * 101 - 60 AS n FROM part)",
    "inventory_digest": ORDERS + "SELECT chunk_id // 1000 AS folder, sha256(string_agg('chunk/' || chunk_id, chr(10) ORDER BY 'chunk/' || chunk_id)) AS digest, count(*) AS n FROM o GROUP BY 1",
    "backfill_plan": "WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-15', DATE '2024-04-10', INTERVAL 1 DAY)) AS DATE) AS day), m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n FROM d GROUP BY 1) SELECT 'aggTrades' AS data_type, 'monthly' AS granularity, CAST(month AS VARCHAR) AS first_day, CAST(last_day(month) AS VARCHAR) AS last_day, CAST(1000 * day(last_day(month)) AS BIGINT) AS estimated_bytes FROM m WHERE n = day(last_day(month)) UNION ALL SELECT 'fundingRate', 'monthly', CAST(month AS VARCHAR), CAST(last_day(month) AS VARCHAR), 10 * day(last_day(month)) FROM m UNION ALL SELECT 'aggTrades', 'daily', CAST(day AS VARCHAR), CAST(day AS VARCHAR), 1000 FROM d WHERE date_trunc('month', day) IN (SELECT month FROM m WHERE n <> day(last_day(month)))",
    "forbidden_steps": "WITH l AS (SELECT l_orderkey, CASE l_partkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SEALING' WHEN 2 THEN 'SEALED' ELSE 'QUARANTINED' END AS to_state, lag(CASE l_partkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SEALING' WHEN 2 THEN 'SEALED' ELSE 'QUARANTINED' END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS from_state FROM lineitem) SELECT from_state, to_state, count(*) AS n FROM l WHERE from_state IS NOT NULL AND (from_state || '>' || to_state) NOT IN ('ACTIVE>SEALING', 'ACTIVE>QUARANTINED', 'SEALING>SEALED', 'SEALING>QUARANTINED') GROUP BY ALL",
    "verify_summary": ORDERS + "SELECT count(*) FILTER (state = 'SEALED') AS verified, count(*) FILTER (state = 'QUARANTINED') AS failed, count(*) FILTER (state = 'ACTIVE') AS pending FROM o",
    "archive_set_counts": "SELECT count(DISTINCT l_suppkey) AS sets, count(DISTINCT l_shipdate) AS media, count(DISTINCT l_orderkey) AS artifacts FROM lineitem",
    "status_summary": ORDERS + "SELECT count(*) FILTER (state = 'ACTIVE') AS open_chunks, count(*) FILTER (state = 'SEALED') AS sealed_chunks, 0::BIGINT AS archived_chunks, count(*) FILTER (state = 'QUARANTINED') AS quarantined_chunks, 2000000000000000000 - max(created_ns) AS last_event_age_ns FROM o",
    "seal_flags": ORDERS + ", c AS (SELECT *, o_custkey % 9 AS m FROM o), g AS (SELECT m, o_orderpriority, count(*) AS n FROM c WHERE o_orderpriority LIKE '1%' AND chunk_id % 50 = 0 GROUP BY ALL) SELECT chunk_id, CASE WHEN state = 'SEALED' AND n > 0 THEN 'reconnect_gap,recovered_tail' WHEN n > 0 THEN 'reconnect_gap' WHEN state = 'SEALED' THEN 'recovered_tail' ELSE '' END AS flags, coalesce(n > 1, false) AS conflict FROM c LEFT JOIN g USING (m, o_orderpriority)",
    "eject_blocked": "SELECT s_suppkey AS storage_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_returnflag <> 'R')",
    "readiness_ladder": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'FAILED' WHEN s_nationkey % 5 = 0 OR s_acctbal < 1000 THEN 'NOT_READY' ELSE 'READY' END AS state, CASE WHEN s_acctbal < 0 THEN 'no_balance' WHEN s_nationkey % 5 = 0 THEN 'region_closed' WHEN s_acctbal < 1000 THEN 'low_balance' END AS reason FROM supplier",
    "canonical_sides": LEVELS + ", r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS n FROM s) SELECT symbol, coalesce(string_agg(price || ':' || quantity, ' ' ORDER BY n) FILTER (side = 'bid' AND n <= 5), '') AS bids, coalesce(string_agg(price || ':' || quantity, ' ' ORDER BY n) FILTER (side = 'ask' AND n <= 5), '') AS asks FROM r GROUP BY symbol",
    "gap_counts": "SELECT count(DISTINCT user_id) FILTER (event_type = 'click') AS started, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS completed, (SELECT count(DISTINCT c_nationkey) FROM customer) AS matched FROM events",
}
SQL["backfill_totals"] = f"SELECT count(*) AS files, CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes FROM ({SQL['backfill_plan']})"
QUERIES = {name: globals()[name] for name in SQL}
