"""Versioned, market-aware schemas. Nothing is inferred; prices and quantities stay text, clocks stay integers."""

from __future__ import annotations

from pyspark.sql import types as T

# Supported streams by market, and the fields of normalized rows. "!" marks a field that is never null.
STREAMS = {
    "spot": "diff_depth agg_trade book_ticker depth_snapshot exchange_info",
    "um_perpetual": "diff_depth agg_trade book_ticker depth_snapshot mark_price liquidation premium_index_snapshot funding_history funding_info open_interest exchange_info open_interest_statistics_5m taker_buy_sell_volume_5m global_long_short_ratio_5m top_long_short_account_ratio_5m top_long_short_position_ratio_5m basis_5m",
}
COMMON = """
dataset_version:string! schema_version:string! dedup_version:string! venue:string! market:string! symbol:string! stream:string! event_kind:string!
receive_time_utc_ns:bigint! receive_date:string! receive_hour:tinyint! receive_monotonic_ns:bigint!
exchange_event_time_ms:bigint exchange_transaction_time_ms:bigint exchange_trade_time_ms:bigint
module:string! connection_id:string! collector_instance_id:string! collector_version:string! source_sequence_json:string! capture_flags_json:string!
source_chunk_id:string! source_chunk_sha256:string! source_record_ordinal:bigint! source_subrecord_ordinal:int! raw_payload_sha256:string!
semantic_key_sha256:string! logical_record_sha256:string! duplicate_count:int! duplicate_sources_json:string! identity_conflict:boolean!
valid:boolean! error_code:string source_complete:boolean! source_gap:boolean! source_resync:boolean! source_recovered:boolean! source_capture_flags_json:string!
"""
RATIO = "observation_empty:boolean! timestamp_ms:bigint long_short_ratio:string long_account:string short_account:string"
FIELDS = {
    "diff_depth": "first_update_id:bigint final_update_id:bigint previous_final_update_id:bigint bids_json:string asks_json:string",
    "agg_trade": "aggregate_trade_id:bigint first_trade_id:bigint last_trade_id:bigint price:string quantity:string buyer_is_maker:boolean best_match:boolean",
    "book_ticker": "update_id:bigint bid_price:string bid_quantity:string ask_price:string ask_quantity:string",
    "depth_snapshot": "last_update_id:bigint bids_json:string asks_json:string response_status:int request_time_utc_ns:bigint response_model_sha256:string",
    "mark_price": "mark_price:string index_price:string estimated_settle_price:string funding_rate:string next_funding_time_ms:bigint",
    "liquidation": "side:string order_type:string time_in_force:string original_quantity:string price:string average_price:string order_status:string last_filled_quantity:string accumulated_filled_quantity:string order_trade_time_ms:bigint",
    "premium_index_snapshot": "mark_price:string index_price:string estimated_settle_price:string last_funding_rate:string interest_rate:string next_funding_time_ms:bigint observation_time_ms:bigint",
    "funding_history": "observation_empty:boolean! funding_time_ms:bigint funding_rate:string mark_price:string",
    "funding_info": "symbol_present:boolean! observation_record_count:int! adjusted_funding_rate_cap:string adjusted_funding_rate_floor:string funding_interval_hours:int disclaimer:boolean",
    "open_interest": "open_interest:string observation_time_ms:bigint",
    "exchange_info": "symbol_present:boolean! server_time_ms:bigint contract_type:string trading_status:string filters_json:string rate_limits_json:string",
    "spot/exchange_info": "symbol_present:boolean! server_time_ms:bigint trading_status:string filters_json:string order_types_json:string rate_limits_json:string permissions_json:string permission_sets_json:string response_model_sha256:string",
    "open_interest_statistics_5m": "observation_empty:boolean! timestamp_ms:bigint sum_open_interest:string sum_open_interest_value:string",
    "taker_buy_sell_volume_5m": "observation_empty:boolean! timestamp_ms:bigint buy_sell_ratio:string buy_volume:string sell_volume:string",
    "global_long_short_ratio_5m": RATIO,
    "top_long_short_account_ratio_5m": RATIO,
    "top_long_short_position_ratio_5m": RATIO,
    "basis_5m": "observation_empty:boolean! timestamp_ms:bigint pair:string contract_type:string index_price:string futures_price:string basis:string basis_rate:string annualized_basis_rate:string",
}
DATASET_VERSION, DEDUP_VERSION = "normalized-dataset.v1", "normalized-dedup.v1"
# End of fixed values.

KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "tinyint": T.ByteType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def of_text(spec: str) -> T.StructType:
    fields = [x.rstrip("!").split(":") + [x.endswith("!")] for x in spec.split()]
    return T.StructType([T.StructField(name, KINDS[kind], not required) for name, kind, required in fields])


ENVELOPE = of_text(
    "schema_version:string! venue:string! market:string! symbol:string! stream:string! module:string! connection_id:string! collector_instance_id:string! "
    "collector_version:string! receive_time_utc_ns:bigint! receive_monotonic_ns:bigint! exchange_event_time:bigint exchange_transaction_time:bigint "
    "exchange_trade_time:bigint source_sequence:map<string,string>! payload_encoding:string! raw_payload:binary! capture_flags:array<string>!"
)
#: What a parser adds to an envelope about where it was stored.
SOURCE = of_text(
    "source_chunk_id:string source_chunk_sha256:string source_record_ordinal:bigint source_complete:boolean source_gap:boolean "
    "source_resync:boolean source_recovered:boolean source_capture_flags:array<string>"
)


class UnsupportedStream(ValueError):
    """A (market, stream) pair that no schema covers; never an invalid row."""


def supported() -> list[tuple[str, str]]:
    return [(market, stream) for market, streams in STREAMS.items() for stream in streams.split()]


def stream_schema(market: str, stream: str) -> T.StructType:
    """Fields of one stream alone."""
    if (market, stream) not in supported():
        raise UnsupportedStream(f"{market}/{stream}")
    return of_text(FIELDS.get(f"{market}/{stream}", FIELDS.get(stream)))


def schema_for(market: str, stream: str) -> T.StructType:
    """All columns of a normalized stream: the common ones, then its own."""
    return T.StructType([*of_text(COMMON).fields, *stream_schema(market, stream).fields])


def schema_version(market: str, stream: str, venue: str) -> str:
    return f"normalized-{venue}-{'usdm' if market == 'um_perpetual' else market}-{stream.replace('_', '-')}.v1"


def partition_columns() -> list[str]:
    return ["market", "stream", "receive_date", "receive_hour"]
