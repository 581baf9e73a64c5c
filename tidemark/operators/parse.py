"""Raw envelopes to typed rows, one parser for each stream, under strict JSON types.

A payload is a VARIANT. Each stream is a list of checks in order, and columns; the first check that fails
makes the row invalid with its message, and an invalid row stays, with defaults, under the identity of its
bytes. Items of an array become rows by position; an empty array is an observation of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_struct, canonical_variant, sha256
from ..schemas import DATASET_VERSION, DEDUP_VERSION, UnsupportedStream, schema_version, stream_schema, supported

RATIOS = ("global_long_short_ratio_5m", "top_long_short_account_ratio_5m", "top_long_short_position_ratio_5m")
FIVE_MINUTES = ("open_interest_statistics_5m", "taker_buy_sell_volume_5m", *RATIOS, "basis_5m")


class Object:
    """Strict access to a variant that should be an object; `bad` collects what is wrong, in order."""

    def __init__(self, value: Column):
        self.value, self.bad = value, []

    def at(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$['{name}']", "variant")

    def kind(self, name: str) -> Column:
        return F.schema_of_variant(self.at(name))

    def check(self, ok: Column, message: str) -> None:
        self.bad.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)))

    def text(self, name: str, empty: bool = False) -> Column:
        value = F.try_variant_get(self.value, f"$['{name}']", "string")
        ok = self.kind(name) == "STRING"
        self.check(ok if empty else ok & (F.length(value) > 0), f"{name} must be text" if empty else f"{name} must be non-empty text")
        return value

    def integer(self, name: str, optional: bool = False, kind: str = "bigint") -> Column:
        value = F.try_variant_get(self.value, f"$['{name}']", kind)
        ok = (self.kind(name) == "BIGINT") & (value >= 0)
        self.check(ok | self.at(name).isNull() if optional else ok, f"{name} must be a non-negative integer")
        return value

    def boolean(self, name: str, optional: bool = False) -> Column:
        ok = self.kind(name) == "BOOLEAN"
        self.check(ok | self.at(name).isNull() if optional else ok, f"{name} must be boolean")
        return F.try_variant_get(self.value, f"$['{name}']", "boolean")

    def is_object(self, label: str) -> None:
        self.check(F.schema_of_variant(self.value).startswith("OBJECT"), f"{label} must be an object")

    def inner(self, name: str, label: str | None = None) -> Object:
        out = Object(self.at(name))
        out.bad = self.bad
        out.is_object(label or name)
        return out

    def items(self, name: str, label: str | None = None) -> Column:
        self.check(self.kind(name).startswith("ARRAY"), f"{label or name} must be an array")
        return F.try_variant_get(self.value, f"$['{name}']", "array<variant>")

    def array(self, name: str, optional: bool = False) -> Column:
        ok = self.kind(name).startswith("ARRAY")
        self.check(ok | self.at(name).isNull() if optional else ok, f"{name} must be an array")
        return canonical_variant(self.at(name))

    def levels(self, name: str) -> Column:
        self.check(self.kind(name).startswith("ARRAY"), f"{name} must be an array")
        pairs = F.try_variant_get(self.value, f"$['{name}']", "array<array<string>>")
        strict = (F.size(pairs) == 0) | ((self.kind(name) == "ARRAY<ARRAY<STRING>>") & F.forall(pairs, lambda p: F.size(p) == 2))
        self.check(strict, f"{name} contains invalid price levels")
        return F.to_json(pairs)

    def error(self) -> Column:
        return F.coalesce(*self.bad) if self.bad else F.lit(None).cast("string")


def event(fields: dict[str, Column], identity: dict[str, Column], kind: str, error: Column, content: dict[str, Column] | None = None, ordinal: Column | None = None) -> Column:
    """One parsed event as a struct."""
    named = lambda d: [c.alias(n) for n, c in sorted(d.items())]
    return F.struct(
        (F.lit(0) if ordinal is None else ordinal).cast("int").alias("ordinal"), F.lit(kind).alias("event_kind"), error.alias("error"),
        canonical_struct(*named(identity), nulls=False).alias("identity"), canonical_struct(*named(fields if content is None else content)).alias("content"),
        F.struct(*(c.alias(n) for n, c in fields.items())).alias("fields"),
    )


def words(text: str) -> list[str]:
    return text.split()


def filled(market: str, stream: str, **values: Column) -> dict[str, Column]:
    """Every field of a stream, null unless given."""
    return {f.name: (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType) for f in stream_schema(market, stream).fields}


def core(market: str, stream: str, doc: Object) -> Column:
    """Websocket streams with sequence numbers; a shutdown notice may come on any of them."""
    same = {"kind": F.lit(stream), "market": F.col("market"), "symbol": F.col("symbol")}
    notice = Object(doc.value)
    when = notice.integer("E")
    shut = event(filled(market, stream), {"kind": F.lit("server_shutdown"), "event_time": when}, "server_shutdown", F.coalesce(doc.error(), notice.error()), {"event_kind": F.lit("server_shutdown"), "event_time": when})
    is_notice = F.coalesce(F.try_variant_get(doc.value, "$.e", "string") == "serverShutdown", F.lit(False))
    doc.check(doc.text("s") == F.col("symbol"), "payload symbol differs from envelope")
    if stream == "diff_depth":
        first, final = doc.integer("U"), doc.integer("u")
        doc.check(first <= final, "depth U exceeds u")
        previous = doc.integer("pu") if market == "um_perpetual" else F.lit(None).cast("bigint")
        fields = {"first_update_id": first, "final_update_id": final, "previous_final_update_id": previous, "bids_json": doc.levels("b"), "asks_json": doc.levels("a")}
        identity = same | {"U": first, "u": final, "pu": previous}
    elif stream == "agg_trade":
        trade, first, last = doc.integer("a"), doc.integer("f"), doc.integer("l")
        doc.check(first <= last, "aggregate trade f exceeds l")
        fields = {"aggregate_trade_id": trade, "first_trade_id": first, "last_trade_id": last, "price": doc.text("p"), "quantity": doc.text("q"), "buyer_is_maker": doc.boolean("m")}
        fields["best_match"] = doc.boolean("M") if market == "spot" else F.lit(None).cast("boolean")
        identity = same | {"aggregate_trade_id": trade}
    else:
        update = doc.integer("u")
        fields = {"update_id": update, "bid_price": doc.text("b"), "bid_quantity": doc.text("B"), "ask_price": doc.text("a"), "ask_quantity": doc.text("A")}
        identity = same | {"update_id": update}
    return F.array(F.when(is_notice, shut).otherwise(event(fields, identity, "market_event", doc.error())))


def depth_snapshot(market: str, stream: str, doc: Object) -> Column:
    response, request = doc.inner("response"), doc.inner("request")
    model = response.inner("model", "response.model")
    last = model.integer("lastUpdateId")
    digest = sha256(canonical_variant(model.value))
    fields = {
        "last_update_id": last, "bids_json": model.levels("bids"), "asks_json": model.levels("asks"), "response_status": response.integer("status", kind="int"),
        "request_time_utc_ns": request.integer("request_time_utc_ns"), "response_model_sha256": digest,
    }
    return F.array(event(fields, {"kind": F.lit(stream), "market": F.col("market"), "last_update_id": last, "model_sha256": digest}, "rest_snapshot", doc.error()))


def mark_price(market: str, stream: str, doc: Object) -> Column:
    at, funding = doc.integer("E"), doc.integer("T")
    fields = {"mark_price": doc.text("p"), "index_price": doc.text("i"), "estimated_settle_price": doc.text("P"), "funding_rate": doc.text("r"), "next_funding_time_ms": funding}
    return F.array(event(fields, {"kind": F.lit(stream), "symbol": F.col("symbol"), "event_time": at, "next_funding_time": funding}, "market_event", doc.error()))


def liquidation(market: str, stream: str, doc: Object) -> Column:
    at = doc.integer("E")
    order = doc.inner("o")
    order.check(order.text("s") == F.col("symbol"), "liquidation symbol differs from envelope")
    traded = order.integer("T")
    names = dict(zip(words("side order_type time_in_force original_quantity price average_price order_status last_filled_quantity accumulated_filled_quantity"), words("S o f q p ap X l z"), strict=True))
    fields = {to: order.text(name) for to, name in names.items()} | {"order_trade_time_ms": traded}
    return F.array(event(fields, {"kind": F.lit(stream), "symbol": F.col("symbol"), "event_time": at, "trade_time": traded, "side": fields["side"]}, "market_event", doc.error()))


def poll_identity(digest: Column) -> dict[str, Column]:
    """During an overlap of two deployments the same answer is one observation; else each poll is its own."""
    deployment = F.get(F.filter("capture_flags", lambda f: f.startswith("deployment_id=")), F.lit(0))
    shared = deployment.isNotNull() & F.array_contains("capture_flags", "blue_green_overlap")
    own = lambda c: F.when(~F.coalesce(shared, F.lit(False)), F.col(c))
    both = lambda c: F.when(shared, c)
    return {
        "kind": F.when(shared, "blue_green_poll").otherwise("poll_observation"), "deployment_id": both(F.substring(deployment, F.lit(15), F.length(deployment))), "model_sha256": both(digest),
        "receive_time_utc_ns": own("receive_time_utc_ns"), "collector_instance_id": own("collector_instance_id"), "connection_id": own("connection_id"),
    }


def matching(items: Column) -> Column:
    return F.filter(items, lambda x: F.coalesce(F.try_variant_get(x, "$.symbol", "string") == F.col("symbol"), F.lit(False)))


def exchange_info(market: str, stream: str, doc: Object) -> Column:
    model = doc.inner("response").inner("model", "response.model")
    symbols = model.items("symbols")
    if market != "spot":
        limits = model.array("rateLimits")
    found = matching(symbols)
    many = F.size(found)
    one = Object(F.get(found, F.lit(0)))
    one.bad = model.bad
    digest = sha256(canonical_variant(model.value))
    if market == "spot":
        one.check(many <= 1, "exchange info identifies the symbol more than once")
        given, own = many == 1, Object(one.value)
        trading, filters, types = own.text("status"), own.array("filters"), own.array("orderTypes")
        permissions, sets = own.array("permissions", True), own.array("permissionSets", True)
        server = model.integer("serverTime", optional=True)
        limits = model.array("rateLimits", optional=True)
        model.bad.append(F.when(given, own.error()))
        fields = filled(market, stream, symbol_present=given, server_time_ms=server, trading_status=trading, filters_json=filters, order_types_json=types, rate_limits_json=limits, permissions_json=permissions, permission_sets_json=sets, response_model_sha256=digest)
        identity = {"kind": F.lit(stream), "market": F.col("market"), "symbol": F.col("symbol"), "model_sha256": digest}
    else:
        one.check(many == 1, "exchange info does not identify the symbol once")
        server = model.integer("serverTime", optional=True)
        fields = filled(market, stream, symbol_present=F.lit(True), server_time_ms=server, contract_type=one.text("contractType"), trading_status=one.text("status"), filters_json=one.array("filters"), rate_limits_json=limits)
        identity = poll_identity(digest)
    return F.array(event(fields, identity, "rest_snapshot", doc.error()))


def five_minutes(market: str, stream: str, doc: Object) -> Column:
    items = doc.inner("response").items("model", "response.model")
    parameters = Object(F.try_variant_get(doc.value, "$.request.parameters", "variant"))
    asked = lambda name: F.coalesce(*(F.try_variant_get(parameters.value, f"$.{n}", "bigint") for n in (f"requested{name[0].upper()}{name[1:]}", name)))
    names = {
        "open_interest_statistics_5m": "sum_open_interest:sumOpenInterest sum_open_interest_value:sumOpenInterestValue",
        "taker_buy_sell_volume_5m": "buy_sell_ratio:buySellRatio buy_volume:buyVol sell_volume:sellVol",
        "basis_5m": "contract_type:contractType index_price:indexPrice futures_price:futuresPrice basis:basis basis_rate:basisRate annualized_basis_rate:annualizedBasisRate",
    }.get(stream, "long_short_ratio:longShortRatio long_account:longAccount short_account:shortAccount")
    same = {"kind": F.lit(stream), "market": F.col("market"), "symbol": F.col("symbol")}

    def row(x: Column, i: Column) -> Column:
        item = Object(x)
        item.is_object(f"{stream} item")
        at = item.integer("timestamp")
        values = {"observation_empty": F.lit(False), "timestamp_ms": at}
        if stream == "basis_5m":
            values["pair"] = item.text("pair")
            item.check(values["pair"] == F.col("symbol"), "basis pair differs from envelope")
        elif stream != "taker_buy_sell_volume_5m":
            item.check(item.text("symbol") == F.col("symbol"), "symbol differs from envelope")
        for to, name in (n.split(":") for n in names.split()):
            values[to] = item.text(name, empty=to == "annualized_basis_rate")
        return event(filled(market, stream, **values), same | {"timestamp_ms": at}, "rest_period", F.coalesce(doc.error(), item.error()), ordinal=i)

    start, end = asked("startTime"), asked("endTime")
    empty = Object(doc.value)
    empty.check((start >= 0) & (end >= 0), "requested period must be non-negative integers")
    nothing = event(filled(market, stream, observation_empty=F.lit(True)), same | {"requested_start_ms": start, "requested_end_ms": end, "model_sha256": sha256(F.lit("[]"))}, "empty_observation", F.coalesce(doc.error(), empty.error()))
    return F.when(F.size(items) > 0, F.transform(items, row)).otherwise(F.array(nothing))


def funding_history(market: str, stream: str, doc: Object) -> Column:
    items = doc.inner("response").items("model", "response.model")

    def row(x: Column, i: Column) -> Column:
        item = Object(x)
        item.is_object("funding history item")
        item.check(item.text("symbol") == F.col("symbol"), "funding-history symbol differs")
        at, rate = item.integer("fundingTime"), item.text("fundingRate")
        price = F.try_variant_get(x, "$.markPrice", "string")
        item.check(item.at("markPrice").isNull() | ((item.kind("markPrice") == "STRING") & (F.length(price) > 0)), "markPrice must be non-empty text")
        return event(filled(market, stream, observation_empty=F.lit(False), funding_time_ms=at, funding_rate=rate, mark_price=price), {"kind": F.lit(stream), "symbol": F.col("symbol"), "funding_time": at}, "market_event", F.coalesce(doc.error(), item.error()), ordinal=i)

    nothing = event(filled(market, stream, observation_empty=F.lit(True)), poll_identity(sha256(F.lit("[]"))), "empty_observation", doc.error())
    return F.when(F.size(items) > 0, F.transform(items, row)).otherwise(F.array(nothing))


def funding_info(market: str, stream: str, doc: Object) -> Column:
    response = doc.inner("response")
    items = response.items("model", "response.model")
    found = matching(items)
    given = F.size(found) == 1
    doc.check(F.size(found) <= 1, "multiple funding-info records of the symbol")
    item = Object(F.get(found, F.lit(0)))
    values = {
        "adjusted_funding_rate_cap": item.text("adjustedFundingRateCap"), "adjusted_funding_rate_floor": item.text("adjustedFundingRateFloor"),
        "funding_interval_hours": item.integer("fundingIntervalHours", kind="int"), "disclaimer": item.boolean("disclaimer", optional=True),
    }
    doc.bad.append(F.when(given, item.error()))
    fields = filled(market, stream, symbol_present=given, observation_record_count=F.size(items), **values)
    return F.array(event(fields, poll_identity(sha256(canonical_variant(response.at("model")))), "rest_snapshot", doc.error()))


def observation(market: str, stream: str, doc: Object) -> Column:
    """One REST object at an observation time."""
    model = doc.inner("response").inner("model", "response.model")
    if stream == "open_interest":
        fields = {"open_interest": model.text("openInterest")}
    else:
        names = zip(words("mark_price index_price estimated_settle_price last_funding_rate interest_rate"), words("markPrice indexPrice estimatedSettlePrice lastFundingRate interestRate"), strict=True)
        fields = {to: model.text(name) for to, name in names} | {"next_funding_time_ms": model.integer("nextFundingTime")}
    fields["observation_time_ms"] = model.integer("time")
    return F.array(event(fields, {"kind": F.lit(stream), "symbol": F.col("symbol"), "observation_time": fields["observation_time_ms"]}, "rest_snapshot", doc.error()))


def parser_of(stream: str):
    own = {"depth_snapshot": depth_snapshot, "mark_price": mark_price, "liquidation": liquidation, "exchange_info": exchange_info, "funding_history": funding_history, "funding_info": funding_info, "open_interest": observation, "premium_index_snapshot": observation}
    return own.get(stream, five_minutes if stream in FIVE_MINUTES else core)


def parse_stream(envelopes: DataFrame, market: str, stream: str) -> DataFrame:
    """Envelopes of one stream with their source columns, to candidate rows of its schema (before dedup).

    A payload that isn't UTF-8 JSON of the right shape gives one invalid row. An integer beyond 64 bits is invalid too.
    """
    schema = stream_schema(market, stream)
    rows = envelopes.where((F.col("market") == market) & (F.col("stream") == stream))
    rows = rows.withColumn("__doc", F.try_parse_json(F.try_validate_utf8(F.col("raw_payload").cast("string"))))
    doc = Object(F.col("__doc"))
    doc.check(F.col("__doc").isNotNull(), "payload is not valid UTF-8 JSON")
    doc.is_object("payload")
    defaults = {"observation_empty": F.lit(False), "symbol_present": F.lit(False), "observation_record_count": F.lit(0)}
    nothing = {f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType) for f in schema.fields}

    def invalid(code: Column) -> Column:
        identity = {"kind": F.lit("malformed"), "raw_payload_sha256": F.sha2("raw_payload", 256)}
        return event(nothing, identity, "malformed", code, identity | {"error_code": code})

    def settled(events: Column) -> Column:
        """One bad item makes the whole payload one invalid row."""
        error = F.get(F.filter(events, lambda e: e["error"].isNotNull()), F.lit(0))["error"]
        whole = lambda code: F.array(invalid(code))
        return F.when(F.array_contains("capture_flags", "malformed"), whole(F.lit("UPSTREAM_MALFORMED"))).when(error.isNotNull(), whole(F.concat(F.lit("SCHEMA_ERROR:"), error))).otherwise(events)

    # bound by a lambda, the events are worked out once for a payload
    parsed = rows.select(*envelopes.columns, F.explode(F.get(F.transform(F.array(parser_of(stream)(market, stream, doc)), settled), F.lit(0))).alias("__e"))
    out = parsed.select(
        *envelopes.columns, F.col("__e.ordinal").alias("source_subrecord_ordinal"), F.col("__e.event_kind").alias("event_kind"), F.col("__e.error").isNull().alias("valid"),
        F.col("__e.error").alias("error_code"), F.col("__e.identity").alias("__identity"), F.col("__e.content").alias("__content"), *(F.col(f"__e.fields.{f.name}").alias(f.name) for f in schema.fields),
    )
    return with_common(out, market, stream, schema)


def with_common(rows: DataFrame, market: str, stream: str, schema) -> DataFrame:
    """The common columns, with the hashes that dedup goes by."""
    from ..functions.clocks import utc_date, utc_hour

    times = {f"exchange_{n}_time_ms": F.col(f"exchange_{n}_time") for n in ("event", "transaction", "trade")}
    logical = {"event_kind": F.col("event_kind"), "valid": F.col("valid"), "error_code": F.col("error_code"), **times}
    pieces = [c.alias(n) for n, c in sorted(logical.items())]
    rest = canonical_struct(*pieces)
    whole = F.concat(F.lit('{"content":'), F.col("__content"), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    flags = lambda c: F.to_json(F.array_sort(F.array_distinct(F.col(c))))
    versions = F.concat(F.lit("normalized-"), F.col("venue"), F.lit(schema_version(market, stream, "")[len("normalized-") :]))
    return rows.select(
        F.lit(DATASET_VERSION).alias("dataset_version"), versions.alias("schema_version"), F.lit(DEDUP_VERSION).alias("dedup_version"),
        "venue", "market", "symbol", "stream", "event_kind", "receive_time_utc_ns", utc_date(F.col("receive_time_utc_ns")).alias("receive_date"),
        utc_hour(F.col("receive_time_utc_ns")).alias("receive_hour"), "receive_monotonic_ns", *(c.alias(n) for n, c in times.items()),
        "module", "connection_id", "collector_instance_id", "collector_version",
        sequence_json(F.col("source_sequence")).alias("source_sequence_json"), flags("capture_flags").alias("capture_flags_json"),
        "source_chunk_id", "source_chunk_sha256", "source_record_ordinal", "source_subrecord_ordinal", F.sha2("raw_payload", 256).alias("raw_payload_sha256"),
        sha256(F.col("__identity")).alias("semantic_key_sha256"), sha256(whole).alias("logical_record_sha256"),
        F.lit(1).alias("duplicate_count"), F.lit(False).alias("identity_conflict"), "valid", "error_code",
        "source_complete", "source_gap", "source_resync", "source_recovered", flags("source_capture_flags").alias("source_capture_flags_json"),
        *(f.name for f in schema.fields),
    )


def sequence_json(sequence: Column) -> Column:
    """Canonical JSON of a sequence map. Its values are JSON texts, so that numbers and strings stay apart."""
    entries = F.array_sort(F.map_entries(sequence))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))


def parse(envelopes: DataFrame, streams: list[tuple[str, str]] | None = None) -> DataFrame:
    """Candidates of several streams (all supported ones by default) under one wide schema.

    Each stream filters the envelopes, so keep them partitioned by market and stream: then a file is read for its own
    stream alone. Raw chunks have one stream each; for them use sources.tables.read_candidates.
    With `streams` unset, an envelope of an unsupported stream is an error, which one row's lookup finds first.
    """
    wanted = streams or supported()
    if streams is None:
        known = reduce(lambda a, b: a | b, ((F.col("market") == m) & (F.col("stream") == s) for m, s in wanted))
        odd = envelopes.where(~F.coalesce(known, F.lit(False))).select("market", "stream").limit(1).collect()
        if odd:
            raise UnsupportedStream(f"{odd[0][0]}/{odd[0][1]}")
    parts = [parse_stream(envelopes, m, s) for m, s in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
