import pandas as pd

from tidelog.functions.codec import encode_command
from tidelog.schema import DELETE, PUT
from tidelog.sources.catalog import Engine
from tidelog.streaming import applier, materialize


def batches(spark, path, schema, frames):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        yield i


def test_ordered_apply_buffers_gaps(spark, tmp_path):
    put = lambda i: ("g", i, bytearray(encode_command(PUT, b"k%d" % i, b"v", b"")))
    schema, src = "grp string, idx long, payload binary", tmp_path / "in"
    frames = [[put(1), put(3), put(4)], [put(1), ("g", 2, bytearray(b"junk")), put(6)], [put(5)]]
    src.mkdir()
    q = applier.apply_in_order(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("applied").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    seen = []
    try:
        for _ in batches(spark, src, schema, frames):
            q.processAllAvailable()
            seen.append(sorted(r["idx"] for r in spark.table("applied").collect()))
    finally:
        q.stop()
    assert seen == [[1], [1, 2, 3, 4], [1, 2, 3, 4, 5, 6]]
    assert {r["idx"]: r["outcome"] for r in spark.table("applied").collect()}[2] == "SKIPPED_CORRUPT"


def test_peer_monitor(spark, tmp_path):
    schema, src = "peer long, event_id long, ok boolean", tmp_path / "in"
    src.mkdir()
    q = applier.watch_peers(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("peers").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for _ in batches(spark, src, schema, [[(1, 1, False), (1, 2, True)], [(1, 3, False)], [(1, 4, False), (1, 5, True)]]):
            q.processAllAvailable()
        got = sorted((r["event_id"], r["state"]) for r in spark.table("peers").collect())
    finally:
        q.stop()
    assert got == [(2, "UP"), (4, "DOWN"), (5, "UP")]


def test_materializer_restarts(spark, tmp_path):
    schema, src = "key string, seq long, type int, value string", tmp_path / "in"
    src.mkdir()
    e = Engine(spark, f"file://{tmp_path}/store", trigger=3)
    flushed = []
    for _ in batches(spark, src, schema, [[("a", 1, PUT, "1")], [("b", 2, PUT, "2")], [("a", 3, DELETE, "")], [("c", 4, PUT, "4")]]):
        materialize.into(spark.readStream.schema(schema).parquet(str(src)), e, str(tmp_path / "cp"), flushed.append).awaitTermination()
    assert flushed == [1, 2, 3, 4]
    assert {r["key"]: r["value"] for r in e.as_of().collect()} == {"b": "2", "c": "4"}
    assert len(e.manifest().tables) < 3 and pd.notna(e.manifest().high_water)
