"""Streaming results equal batch ones, and a batch that comes twice is written once."""

import json

from pyspark.sql import functions as F
from test_book import A, B

from tidemark.streaming import live


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, data, tmp_path, files=3):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(files).write.parquet(f"{tmp_path}/in")
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_daily_counts(spark, data, tmp_path):
    e, stream = source(spark, data, tmp_path)
    got = run(live.daily_counts(stream, ["event_type"]), "daily", "complete")
    want = e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_preview_dedup_and_sessions(spark, data, tmp_path):
    e, stream = source(spark, data, tmp_path)
    doubled = stream.unionByName(stream)
    assert run(live.preview_dedup(doubled, ["event_id"], within="400 days"), "preview").count() == e.count()
    assert run(live.connection_sessions(stream, "user_id"), "sessions", "complete").count() == e.select("user_id").distinct().count()


def test_batches_are_written_once(spark, data, tmp_path):
    e, stream = source(spark, data, tmp_path)
    for _ in range(2):  # a restart finds nothing new
        live.write_batches_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == e.count()


def test_book_state_lives_through_restarts(spark, tmp_path):
    schema = "market string, symbol string, kind string, receive_time_utc_ns bigint, ordinal bigint, first bigint, final bigint, previous bigint, bids_json string, asks_json string"
    row = lambda n, kind, first, final, bids="[]": ("spot", "X", kind, n, n, first, final, None, bids, "[]" if kind == "depth" else json.dumps(A))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    seen = []
    for batch in ([row(0, "depth", 11, 12), row(1, "snapshot", None, 11, json.dumps(B))], [row(2, "depth", 13, 13, '[["99","1"]]'), row(3, "depth", 15, 15)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = live.live_book(stream).writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.result for r in seen] == ["BUFFERED", "SYNCHRONIZED", "APPLIED", "SEQUENCE_GAP"]
    assert [r.complete for r in seen] == [False, True, True, False]
