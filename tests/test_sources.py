"""Raw chunks written and read back, faults found, manifests, archives, identities and sinks."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from test_parse import PAYLOADS, T0, envelopes

from tidemark import schemas
from tidemark.functions.identity import canonical_json_exact, crc32c_of, rotation_phase
from tidemark.operators.dedup import deduplicate_events
from tidemark.operators.parse import parse_stream
from tidemark.sinks import tables as sinks
from tidemark.sinks.rawchunk import to_chunks, with_rotation
from tidemark.sources import builds, cbor, tables
from tidemark.sources.rawchunk import Fault, read_chunk, read_chunks, scan_chunks


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    """Files of three chunks of raw depth frames, and the envelopes they hold."""
    rows = [("spot", "diff_depth", PAYLOADS["spot", "diff_depth"] | {"u": 7104 + n}, {"source_sequence": {"U": "7101", "u": str(7104 + n), "x": '"a"'}}) for n in range(30)]
    e = envelopes(spark, rows).select(*(f.name for f in schemas.ENVELOPE.fields))
    made = to_chunks(with_rotation(e), "k1", "1", T0, max_bytes=5000).collect()
    folder = tmp_path_factory.mktemp("chunks")
    paths = []
    for r in made:
        path = folder / f"{r.chunk_id}.zst"
        path.write_bytes(r.payload)
        paths.append(str(path))
    return e, made, paths


def test_checksum_and_cbor():
    assert crc32c_of(b"123456789") == 0xE3069283
    for value in (0, 23, 24, 1 << 32, -1, b"x", "é", [1, None, True], {"b": 1, "aa": [2]}, 1.5):
        assert cbor.loads(cbor.dumps(value)) == value
    for bad in (b"\x18\x01", b"\x01\x01", b"\xa2\x61b\x01\x61a\x01", b"\x7f", b""):
        with pytest.raises(cbor.CborError):
            cbor.loads(bad)


def test_chunks_round_trip(spark, chunks):
    e, made, paths = chunks
    assert len(made) > 1 and sum(r.record_count for r in made) == 30
    back = read_chunks(spark, paths).select(*e.columns)
    key = lambda r: r.receive_time_utc_ns
    assert sorted(back.collect(), key=key) == sorted(e.collect(), key=key)


def test_faults_are_placed(spark, chunks, tmp_path):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(chunks[1][0].payload)
    good = list(read_chunk(io.BytesIO(raw)))
    rng = random.Random(5)
    for _ in range(20):
        at = rng.randrange(1, len(raw))
        cut = list(read_chunk(io.BytesIO(raw[:at])))
        assert len(cut) <= len(good) and cut[-1][3] <= at
        flipped = bytearray(raw)
        flipped[at] ^= 1 << rng.randrange(8)
        found = list(read_chunk(io.BytesIO(bytes(flipped))))
        assert found[-1][4] is not None and found[-1][3] <= at  # no flip goes unseen
    bad = tmp_path / "bad.chunk"
    bad.write_bytes(raw[:-3])
    end = scan_chunks(spark, [str(bad)]).where("raw_payload is null").first()
    assert (end.issue, end.valid_end) == ("truncated_tail", good[-3][3])
    with pytest.raises(Exception):
        read_chunks(spark, [str(bad)]).count()
    assert isinstance(found[-1][4], Fault)


def test_raw_to_build(spark, chunks, tmp_path):
    own = read_chunks(spark, chunks[2]).withColumns({"source_chunk_sha256": F.col("source_chunk_id"), "source_complete": F.lit(True), "source_gap": F.lit(False), "source_resync": F.lit(False), "source_recovered": F.lit(False), "source_capture_flags": F.array().cast("array<string>")}).drop("path")
    rows = deduplicate_events(parse_stream(own.unionByName(own), "spot", "diff_depth"))
    identity = sinks.build_id(own.select(F.col("source_chunk_id").alias("chunk_id"), F.col("source_chunk_sha256").alias("uncompressed_sha256")))
    rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schemas.schema_for("spot", "diff_depth").fields))
    body = sinks.write_build(rows, str(tmp_path), identity)
    assert (body["row_count"], body["input_candidate_count"]) == (30, 60)
    folder = f"{tmp_path}/{identity}/rows/market=spot/stream=diff_depth/receive_date=2026-01-01/receive_hour=0"
    build = tables.read_build(spark, [folder], "spot", "diff_depth")
    tables.verify_rows(build, 30)
    with pytest.raises(tables.IncompleteSource):
        tables.verify_rows(build, 31)
    assert build.select(F.sum("duplicate_count")).first()[0] == 60
    assert builds.list_builds(spark, str(tmp_path)) == [identity]
    opened = builds.Build(spark, str(tmp_path), identity)
    opened.verify()
    assert opened.rows("spot", "diff_depth", last_day="2025-01-01").count() == 0 and opened.rows("spot", "diff_depth", first_day="2026-01-01").count() == 30
    for bad in ("latest", "0" * 64):
        with pytest.raises(tables.IncompleteSource):
            builds.Build(spark, str(tmp_path), bad)
    path = tmp_path / identity / "manifest.json"
    (tmp_path / identity / ".manifest.json.crc").unlink(missing_ok=True)
    path.write_text(path.read_text().replace('"row_count": 30', '"row_count": 31'))
    with pytest.raises(tables.IncompleteSource):
        builds.Build(spark, str(tmp_path), identity)
    assert builds.config_hash({"a": 1, "b": 2}, ("b",)) == builds.config_hash({"a": 1})


def test_chunks_are_read_by_their_own_parser(spark, chunks):
    _, made, paths = chunks
    rows = [(r.chunk_id, r.market, r.stream, p, f"h{n}", True, False, None, None, ["f"]) for n, (r, p) in enumerate(zip(made, paths, strict=True))]
    listed = spark.createDataFrame(rows, "chunk_id string, market string, stream string, path string, uncompressed_sha256 string, complete boolean, gap boolean, resync boolean, recovered boolean, capture_flags array<string>")
    got = tables.read_candidates(spark, listed)
    assert got.count() == 30 and got.where("valid and source_capture_flags_json = '[\"f\"]' and not source_resync").count() == 30
    assert got.select("source_chunk_sha256").distinct().count() == len(made)
    with pytest.raises(tables.IncompleteSource):
        tables.read_candidates(spark, listed.where("false"))


def test_sinks_refuse_contradictions(spark, tmp_path):
    path = f"{tmp_path}/m.json"
    assert sinks.write_once(spark, path, "a") and not sinks.write_once(spark, path, "a")
    with pytest.raises(sinks.Conflict):
        sinks.write_once(spark, path, "b")
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, body string")
    assert sinks.insert_events(spark.createDataFrame([(1, "x"), (3, "z")], "id int, body string"), table, "id").count() == 1
    with pytest.raises(sinks.Conflict):
        sinks.insert_events(spark.createDataFrame([(1, "other")], "id int, body string"), table, "id")
    cursors = spark.createDataFrame([("a", 5)], "kind string, at bigint")
    assert {r.kind: r["at"] for r in sinks.advance_cursors(spark.createDataFrame([("a", 7), ("b", 1)], cursors.schema), cursors, "kind", "at").collect()} == {"a": 7, "b": 1}
    with pytest.raises(sinks.Conflict):
        sinks.advance_cursors(spark.createDataFrame([("a", 4)], cursors.schema), cursors, "kind", "at")
    from tidemark.operators.lifecycle import ARCHIVE_STEPS, steps

    now = spark.createDataFrame([("c1", "COPYING")], "chunk_id string, state string")
    ask = lambda a, b: spark.createDataFrame([("c1", a, b, "k", 1)], "chunk_id string, from_state string, to_state string, idempotency_key string, requested_at_ns bigint")
    assert sinks.apply_transitions(ask("COPYING", "VERIFYING"), now, steps(spark, ARCHIVE_STEPS), "chunk_id")[0].first().state == "VERIFYING"
    with pytest.raises(sinks.Conflict):
        sinks.apply_transitions(ask("COPYING", "VERIFIED"), now, steps(spark, ARCHIVE_STEPS), "chunk_id")
    nested = spark.createDataFrame([((1, ("x",)), [1, 2])], "a struct<b:int,c:struct<d:string>>, e array<int>")
    sinks.write_report(nested, f"{tmp_path}/report")
    assert sorted(spark.read.option("header", True).csv(f"{tmp_path}/report/csv").columns) == ["a.b", "a.c.d", "e"]


def test_archive_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "agg_trade_id,price,q,f,l,transact_time,m\n1,2.5,1,1,1,1700000000000,true\nx,1\n2,2.6,1,1,1,1700000000001,false\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "t.zip"))
    rows = tables.history(files, F.lit("r1"), "spot", "BTCUSDT", "aggTrades").orderBy("row_ordinal").collect()
    assert [(r.row_ordinal, r.event_time_ns) for r in rows] == [(1, 1_700_000_000_000_000_000), (3, 1_700_000_000_001_000_000)]


def test_manifests_and_sources(spark, tmp_path):
    for n, made in enumerate((5, 9)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"chunk_id": f"c{n}", "market": "spot", "stream": "agg_trade", "created_at_utc_ns": made, "uncompressed_sha256": f"h{n}"}))
    m = tables.manifests(spark, [str(tmp_path)], market="spot", created_until_ns=5)
    assert [r.chunk_id for r in m.collect()] == ["c0"]
    local = spark.createDataFrame([("c0", "/a")], "chunk_id string, path string")
    archive = spark.createDataFrame([("c1", "COPYING", "/b")], "chunk_id string, state string, path string")
    assert tables.resolve_sources(m, local, archive).first().path == "/a"
    with pytest.raises(tables.IncompleteSource):
        tables.resolve_sources(tables.manifests(spark, [str(tmp_path)]), local, archive)


def test_live_metadata_keeps_broken_bytes(spark):
    rows = spark.createDataFrame([(bytearray(b'{"E": 5, "U": 1, "u": 2, "T": true}'), "diff_depth"), (bytearray(b"{"), "diff_depth")], "raw_payload binary, stream string")
    good, bad = tables.live_metadata(rows).collect()
    assert (good.exchange_event_time, good.exchange_trade_time, good.source_sequence, good.capture_flags) == (5, None, {"U": "1", "u": "2"}, [])
    assert bad.capture_flags == ["malformed"] and bytes(bad.raw_payload) == b"{"


def test_exact_canonical_json_and_phase(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "\\u001f\\u00e9"}', "spot", "agg_trade"), ("{", "spot", "x")], "t string, market string, stream string")
    rows = df.select(canonical_json_exact("t").alias("c"), rotation_phase(F.col("market"), F.col("stream"), 60).alias("p")).collect()
    assert [r.c for r in rows] == ['{"a":"\\u001fé","b":1}', None] and all(0 <= r.p < 60 for r in rows)
