"""Literal cases and randomized models of the change-log engine."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom, codec, naming, sizes
from tidelog.operators import consensus, index, layout, metrics, mvcc, recovery, requests, retention
from tidelog.plans.leveled import Leveled
from tidelog.schema import DELETE, PUT, LogError
from tidelog.sources import catalog, config, sstable, wal

LOG = "key string, seq long, type int, value string"


def log_of(spark, rows):
    return spark.createDataFrame([(k, s, t, v) for k, s, t, v in rows], LOG)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


FRUIT = [("apple", 9, PUT, "red"), ("apple", 3, PUT, "green"), ("banana", 7, DELETE, ""), ("banana", 2, PUT, "yellow"), ("cherry", 4, PUT, "dark")]


def test_snapshots(spark):
    log = log_of(spark, FRUIT)
    ask = spark.createDataFrame([("apple",), ("banana",), ("kiwi",)], "key string")
    at = lambda s: {r["key"]: (r["state"], r["value"]) for r in mvcc.get(log, ask, s).collect()}
    assert at(None) == {"apple": ("FOUND", "red"), "banana": ("DELETED", None), "kiwi": ("NOT_FOUND", None)}
    assert at(8)["apple"] == ("FOUND", "green") and at(2)["apple"] == ("NOT_FOUND", None) and at(6)["banana"] == ("FOUND", "yellow")


def test_binary_order(spark):
    rows = [(b"\0", 5), (b"a", 1), (b"\0k", 2), (b"a", 4), (b"a", 3)]
    log = spark.createDataFrame([(bytearray(k), s, PUT, bytearray(b"")) for k, s in rows], "key binary, seq long, type int, value binary")
    assert [(bytes(r["key"]), r["seq"]) for r in mvcc.ordered(log).collect()] == [(b"\0", 5), (b"\0k", 2), (b"a", 4), (b"a", 3), (b"a", 1)]
    keys = sorted(rows, key=lambda x: codec.composite_key(*x))
    assert keys == [(b"\0", 5), (b"\0k", 2), (b"a", 4), (b"a", 3), (b"a", 1)]
    assert all(codec.split_composite(codec.composite_key(*x)) == x for x in rows)


@pytest.mark.parametrize(("target", "first"), [("20", "20"), ("25", "30"), ("05", "10"), ("50", None)])
def test_seek(spark, target, first):
    log = log_of(spark, [(k, i + 1, PUT, "v") for i, k in enumerate(["10", "20", "30", "40"])])
    got = mvcc.seek(log, target, 1).collect()
    assert (got[0]["key"] if got else None) == first


@pytest.mark.parametrize(("floor", "kept"), [(100, [9]), (5, [3, 7, 9]), (8, [7, 9])])
def test_retention(spark, floor, kept):
    log = log_of(spark, [("k", s, PUT, str(s)) for s in (3, 7, 9)])
    assert [r[0] for r in rows_of(retention.compact(log, floor), "seq")] == kept


def test_overlapping_files(spark):
    rows = [(f"key{k:03d}", f * 50 + k + 1, PUT, f"f{f}") for f in range(4) for k in range(50)]
    s = retention.stats(log_of(spark, rows), 1000).first()
    assert (s["entries_in"], s["entries_out"], s["entries_dropped"]) == (200, 50, 150)


def test_tombstones_over_deeper_files(spark):
    log = log_of(spark, [("gone", 2, PUT, "x"), ("shadowed", 3, PUT, "x"), ("gone", 5, DELETE, ""), ("shadowed", 6, DELETE, "")])
    deeper = spark.createDataFrame([("shadowed", "shadowed")], "min_key string, max_key string")
    assert rows_of(retention.compact(log, 100, deeper), "key", "seq", "type") == [("shadowed", 6, DELETE)]
    assert retention.compact(log, 100).count() == 0


def test_keys_in_many_ranges(spark):
    rng = random.Random(8)
    bounds = [tuple(sorted((f"k{rng.randrange(9999):04d}", f"k{rng.randrange(9999):04d}"[:rng.randrange(3, 6)]))) for _ in range(60)]
    files = spark.createDataFrame([(a, min(b, a + "5")) for a, b in bounds if a <= min(b, a + "5")], "min_key string, max_key string")
    keys = [(f"k{i:04d}",) for i in range(0, 9999, 7)] + [("",), ("z",)]
    want = sorted(k for k in keys if any(r["min_key"] <= k[0] <= r["max_key"] for r in files.collect()))
    assert rows_of(retention.covered(spark.createDataFrame(keys, "key string"), files), "key") == want


def test_tiered_compaction(spark):
    log = log_of(spark, [("a", 1, PUT, "old"), ("a", 2, PUT, "middle"), ("b", 2, PUT, "before-delete"), ("a", 4, PUT, "new"), ("b", 4, DELETE, "")])
    kept = retention.compact(log, 2)
    at = lambda s: {r["key"]: (r["type"], r["value"]) for r in mvcc.resolve(kept, s).collect()}
    assert at(2) == {"a": (PUT, "middle"), "b": (PUT, "before-delete")} and at(4) == {"a": (PUT, "new"), "b": (DELETE, "")}


def files_of(spark, rows):
    return spark.createDataFrame(rows, "level int, file_no long, min_key string, max_key string, file_size long")


def test_picker(spark):
    files = files_of(spark, [(0, i, "a", "c", 10) for i in range(4)] + [(1, 10, "a", "b", 10), (1, 11, "x", "y", 10)])
    assert rows_of(layout.pick(files), "file_no", "role") == [(0, "input"), (1, "input"), (2, "input"), (3, "input"), (10, "next_input")]
    one = files_of(spark, [(1, 1, "a", "b", 8 << 20), (1, 2, "m", "n", 8 << 20)])
    assert rows_of(layout.pick(one), "file_no") == [(1,)] and rows_of(layout.pick(one, {1: "b"}), "file_no") == [(2,)] and rows_of(layout.pick(one, {1: "n"}), "file_no") == [(1,)]
    assert layout.pick(files_of(spark, [(0, 1, "a", "b", 1)])).count() == 0


def test_rolling_gives_disjoint_files(spark):
    rows = [(f"key{k:03d}", f * 40 + k + 1, PUT, "v" * 30) for f in range(4) for k in range(40)]
    out = layout.roll(log_of(spark, rows), 2000).orderBy("min_key").collect()
    assert len(out) > 3 and all(a["max_key"] < b["min_key"] for a, b in zip(out, out[1:], strict=False))
    assert sum(r["bytes"] for r in out) == sum(17 + len(k) + len(v) for k, _, _, v in rows)


def leveled_store(spark, rows):
    return spark.createDataFrame(rows, "level int, file_no long, key string, seq long, type int, value string")


def test_leveled_compaction(spark):
    rows = [(0, f, f"key{k:03d}", f * 50 + k + 1, PUT, f"f{f}") for f in range(4) for k in range(50)]
    after = Leveled().step(leveled_store(spark, rows), 1000)
    assert after.count() == 50 and rows_of(after, "level")[0] == (1,) and {r["value"] for r in after.collect()} == {"f3"}
    assert Leveled().step(after, 1000) is None
    every = Leveled(target=2000).step(leveled_store(spark, [r[:5] + ("v" * 30,) for r in rows]), 0)
    files = layout.file_metadata(every, ("level", "file_no")).orderBy("min_key").collect()
    assert every.count() == 200 and len(files) > 3 and all(a["max_key"] < b["min_key"] for a, b in zip(files, files[1:], strict=False))
    deep = [(3, 9, "shadowed", 1, PUT, "x")] + [(0, i, k, s, t, v) for i, (k, s, t, v) in enumerate([("gone", 2, PUT, "x"), ("shadowed", 3, PUT, "x"), ("gone", 5, DELETE, ""), ("shadowed", 6, DELETE, "")])]
    left = Leveled().settle(leveled_store(spark, deep), 100)
    assert rows_of(left, "level", "key", "seq") == [(1, "shadowed", 6), (3, "shadowed", 1)]


def test_sparse_index(spark):
    ix = spark.createDataFrame([(1, "b"), (1, "d"), (1, "f"), (1, "h")], "file_no long, key string")
    ask = spark.createDataFrame([(1, "a"), (1, "c"), (1, "g"), (1, "z"), (1, "b")], "file_no long, key string")
    assert rows_of(index.lookup(ask, ix), "probe", "block_key") == [("a", "b"), ("b", "b"), ("c", "b"), ("g", "f"), ("z", "h")]
    entries = log_of(spark, [("k", s, PUT, "") for s in range(1, 101)] + [("z", 200, PUT, "")]).withColumn("file_no", F.lit(1).cast("long"))
    assert rows_of(index.build(entries), "key", "offset") == [("k", 0), ("z", 1800)]


def test_bloom(spark):
    keys = [f"key-{i}" for i in range(1000)]
    entries = log_of(spark, [(k, i + 1, PUT, "") for i, k in enumerate(keys)]).withColumn("file_no", F.lit(1).cast("long"))
    ask = spark.createDataFrame([(1, k) for k in keys + [f"absent-key-{i}" for i in range(1000)]], "file_no long, key string")
    got = {r["probe"]: r["may_contain"] for r in bloom.probe(ask, bloom.build(entries)).collect()}
    assert all(got[k] for k in keys) and sum(got[k] for k in got if k.startswith("absent")) < 50

    def slow(key, seed):
        h, m = bloom.FNV_BASIS ^ seed, (1 << 64) - 1
        for b in key:
            h = (h ^ b) * bloom.FNV_PRIME & m
        for shift, factor in bloom.FINAL:
            h ^= h >> shift
            h = h * (factor or 1) & m
        return h

    raw = [b"", b"a", b"\xff\x00key", "é".encode() * 9]
    for seed in bloom.SEEDS:
        assert bloom.hash64(raw, seed).tolist() == [slow(k, seed) for k in raw]


def test_crc_and_records(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 0xCBF43926
    log = log_of(spark, FRUIT)
    raw = {bytes(r[0]) for r in log.select(sizes.record_bytes()).collect()}
    assert raw == {sstable.RECORD.pack(len(k), len(v), s, t - 1) + k.encode() + v.encode() for k, s, t, v in FRUIT}


def test_sstable_round_trip(spark, tmp_path):
    rows = sorted([(k.encode(), s, t, v.encode()) for k, s, t, v in FRUIT] + [(f"x{i:04d}".encode(), i + 20, PUT, b"v" * (i % 40)) for i in range(300)], key=lambda e: (e[0], -e[1]))
    blob = sstable.encode(rows)
    assert len(blob) % 4096 == 0 and list(sstable.decode(blob)[1]) == rows
    assert sstable.decode(blob)[0]["max_key"] == b"x0299"
    for at in (3, len(blob) - 4000, len(blob) - 1):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(LogError):
            sstable.decode(bytes(bad))
    (tmp_path / "t.sst").write_bytes(blob)
    assert sstable.read(spark, str(tmp_path)).count() == len(rows)
    log = spark.createDataFrame([(1, bytearray(k), s, t, bytearray(v)) for k, s, t, v in rows], "file_no long, key binary, seq long, type int, value binary")
    assert bytes(sstable.encoded(log).first()["content"]) == blob


@pytest.mark.parametrize("form", ["crc_first", "len_first"])
def test_wal_cut_at_every_byte(form):
    rng = random.Random(4)
    records = [wal.Record(i + 1, DELETE if i % 5 == 4 else PUT, rng.choice([b"a", b"b", b"c\0"]), b"" if i % 5 == 4 else b"v%d" % i) for i in range(12)]
    parts = [wal.encode(r, form) for r in records]
    blob = b"".join(parts)
    for cut in range(len(blob) + 1):
        got = list(wal.frames(blob[:cut], form))
        whole = 0
        while sum(map(len, parts[: whole + 1])) <= cut and whole < 12:
            whole += 1
        assert [r for s, _, _, r, _ in got if s == wal.RECORD] == records[:whole]
        assert got[-1][0] == (wal.END if sum(map(len, parts[:whole])) == cut else wal.TRUNCATED_TAIL)
    bad = bytearray(blob)
    bad[-1] ^= 1
    assert [x[0] for x in wal.frames(bytes(bad), form)][-1] == wal.CORRUPT
    assert [x[0] for x in wal.frames(bytes(bad), form, "torn")][-1] == wal.TRUNCATED_TAIL


def test_wal_files(spark, tmp_path):
    log = log_of(spark, [("k1", 1, PUT, "v1"), ("k2", 2, PUT, "v2"), ("k1", 3, DELETE, "")])
    wal.write(log, str(tmp_path / "w"))
    back = wal.records(spark, str(tmp_path / "w")).withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
    assert rows_of(back, "key", "seq", "type", "value") == rows_of(log, "key", "seq", "type", "value")
    assert rows_of(mvcc.live(back), "key") == [("k2",)]


def test_recovery_counts(spark):
    log = spark.createDataFrame([(1, True, 10), (2, True, 10), (3, True, 10)], "seq long, valid boolean, frame_len long")
    s = recovery.recovery_stats(log, 2).first()
    assert (s["skipped"], s["applied"], s["last_sequence"]) == (2, 1, 3)
    cut = recovery.valid_prefix(log.withColumn("valid", F.col("seq") != 3), damaged_tail="torn").first()
    assert (cut["status"], cut["records"], cut["valid_bytes"]) == ("TORN_TAIL", 2, 20)


def test_metrics(spark):
    ops = spark.createDataFrame([("PUT", 25, True), ("PUT", 120, True), ("GET", 5, False)], "op string, latency_us long, ok boolean")
    h = {(r["op"], r["le"]): r["bucket_count"] for r in metrics.histogram(ops).collect()}
    assert h["PUT", "+Inf"] == 2 and h["PUT", "50"] == 1 and h["GET", "10"] == 1
    assert rows_of(metrics.counters(ops), "op", "total", "errors") == [("GET", 1, 1), ("PUT", 2, 0)]
    for n in (1, 2, 99, 100, 101, 250):
        values = spark.range(n).select(F.lit("x").alias("op"), F.col("id").alias("latency_us"))
        assert metrics.nearest_rank(values).first()["p99"] == (n * 99 + 99) // 100 - 1


RAFT = "node int, idx long, term long, cmd int, key string, value string"


def test_raft_logs(spark):
    put = lambda n, i, t, k="a", v="1": (n, i, t, PUT, k, v)
    logs = spark.createDataFrame([put(0, 1, 1), put(0, 2, 1), put(0, 3, 3), put(1, 1, 1), put(1, 2, 1), put(1, 3, 2)], RAFT)
    m = consensus.log_match(logs).first()
    assert (m["match_index"], m["conflict_index"], m["conflict_term"]) == (2, 3, 2)
    assert consensus.conflict_hint(logs).first()["hint_index"] == 3
    assert rows_of(consensus.replace_suffix(logs, 1), "idx", "term") == [(1, 1), (2, 1), (3, 3)]
    bank = spark.createDataFrame([(0, 1, 1, PUT, "account:1", "100"), (0, 2, 1, PUT, "account:2", "200"), (0, 3, 1, PUT, "account:1", "150"), (0, 4, 1, DELETE, "account:2", "")], RAFT)
    assert rows_of(consensus.applied(bank, 2), "key", "value") == [("account:1", "100"), ("account:2", "200")]
    assert rows_of(consensus.applied(bank, 4), "key", "value") == [("account:1", "150")]


def test_commands(spark):
    raw = codec.encode_command(PUT, b"some-key", b"some-value", b"rid")
    assert codec.decode_command(raw)["error"] is None and codec.decode_command(raw[:-1])["error"]
    rng = random.Random(1)
    for _ in range(2000):
        b = bytearray(raw)
        b[rng.randrange(len(b))] = rng.randrange(256)
        c = codec.decode_command(bytes(b[: rng.randrange(len(b) + 1)]))
        assert c["error"] or codec.encode_command(c["type"], c["key"], c["value"], c["request_id"])
    df = spark.createDataFrame([(1, bytearray(b"k"), bytearray(b"v"), bytearray(b""))], "t int, k binary, v binary, r binary")
    back = df.select(codec.command_decode(codec.command_encode("t", "k", "v", "r")).alias("c")).select("c.*").first()
    assert back["error"] is None and bytes(back["key"]) == b"k"
    seqs = df.select(codec.version_key_decode(codec.version_key("k", F.lit(7).cast("long"))).alias("c")).select("c.seq").first()
    assert seqs["seq"] == 7
    assert df.select(codec.fixed32_decode(codec.fixed32_encode(F.lit(258).cast("long")))).first()[0] == 258


def test_random_log_against_a_dict(spark):
    rng = random.Random(12345)
    rows, states, now = [], {}, {}
    for s in range(1, 1501):
        k = f"k{rng.randrange(50)}"
        if rng.random() < 0.25:
            rows.append((k, s, DELETE, ""))
            now.pop(k, None)
        else:
            rows.append((k, s, PUT, f"v{s}"))
            now[k] = f"v{s}"
        if s % 300 == 0:
            states[s] = dict(now)
    log = log_of(spark, rows).cache()
    for s, want in states.items():
        assert {r["key"]: r["value"] for r in mvcc.live(log, s).collect()} == want
    kept = retention.compact(log, 900).cache()
    for s in (900, 1200, 1500):
        assert {r["key"]: r["value"] for r in mvcc.live(kept, s).collect()} == states[s]


def test_engine_on_disk(spark, tmp_path):
    e = catalog.Engine(spark, f"file://{tmp_path}/store")
    e.append(log_of(spark, [("a", 1, PUT, "1"), ("b", 2, PUT, "2")]))
    pinned = e.snapshot()
    e.append(log_of(spark, [("a", 3, PUT, "3"), ("b", 9, DELETE, "")]))
    old = e.manifest().version
    assert {r["key"]: r["value"] for r in e.as_of().collect()} == {"a": "3"}
    e.compact()
    assert {r["key"]: r["value"] for r in e.as_of(pinned).collect()} == {"a": "1", "b": "2"}
    assert {r["key"]: r["value"] for r in e.as_of(version=old).collect()} == {"a": "3"}
    assert sorted(r["status"] for r in e.orphans().collect()) == ["LIVE", "ORPHAN", "ORPHAN"]
    e.release(pinned)
    e.append(log_of(spark, [("a", 10, DELETE, "")]))
    e.compact()
    assert e.vacuum() == 4 and [r["status"] for r in e.orphans().collect()] == []
    assert e.manifest().high_water == 10 and e.as_of().count() == 0 and e.log().count() == 0
    with pytest.raises(LogError):
        e.as_of(2)
    rows = spark.createDataFrame([("z", PUT, "v", 1, 1)], "key string, type int, value string, day int, no int")
    e.put(rows, "day", ["no"])
    assert e.log().first()["seq"] == 11
    m = e.manifest()
    e.append(log_of(spark, [("y", 20, PUT, "v")]), batch=0)
    assert e.append(log_of(spark, [("y", 20, PUT, "v")]), batch=0).version == m.version + 1


def test_settings():
    s = config.parse("# note\nnode_id = n7\nsync=off\nunknown=1\nclient_port=7\n")
    assert (s.node_id, s.sync_wal, s.client_port) == ("n7", False, 7) and s.validated()
    with pytest.raises(LogError):
        config.parse("metrics_port=50051").validated()
    with pytest.raises(LogError):
        config.parse("sync_wal=maybe")


def test_requests(spark):
    rows = spark.createDataFrame([("PUT", "", "v", ""), ("GET", "k", "", "r" * 129), ("PUT", "k" * 1025, "v", ""), ("DELETE", "k", "", "")], "op string, key string, value string, request_id string")
    got = [r["message"] for r in requests.validated(rows, requests.request_message()).collect()]
    assert got == ["key must not be empty", "request_id exceeds 128 bytes", "key exceeds 1024 bytes (got 1025)", ""]
    good, bad = requests.split_valid(rows, requests.request_message())
    assert good.count() == 1 and bad.count() == 3


def test_names(spark):
    rows = naming.literal_rows(spark, ["RAFT role=leader term=3", "PEER id=2 address=h:1", "VALUE=x y"], "value")
    got = naming.parse_cluster_lines(rows).collect()
    assert got[0]["role"] == "leader" and got[0]["term"] == 3 and got[1]["address"] == "h:1" and got[2]["value"] == "x y"
    assert spark.range(1).select(naming.status_text(F.lit(1), F.lit("no key"))).first()[0] == "NotFound: no key"
