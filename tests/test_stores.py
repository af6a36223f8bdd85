"""Stores on disk: writers that meet, versions that readers keep, recovery from cut and damaged files, the shell."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog import shell
from tidelog.functions import bloom, sizes
from tidelog.plans.single import SingleNode
from tidelog.schema import DELETE, PUT, LogError
from tidelog.sources import raft_state, sstable, wal
from tidelog.sources.catalog import Engine
from tidelog.sources.files import Folder
from tidelog.sources.node import Node

from .test_engine import log_of, rows_of


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a, b = Engine(spark, root), Engine(spark, root)
    write = a._write

    def late(log):
        """b commits while a writes."""
        b.append(log_of(spark, [("b", b.manifest().high_water + 7, PUT, "b")]))
        a._write = write
        return write(log)

    a._write = late
    assert a.append(log_of(spark, [("a", 8, PUT, "a")])).version == 2
    assert rows_of(a.log(), "key", "seq") == [("a", 8), ("b", 7)] and [t["file_no"] for t in a.manifest().tables] == [1, 2]
    a._write = late
    with pytest.raises(LogError, match="taken"):  # both gave themselves the next sequences
        a.put(spark.createDataFrame([("c", PUT, "v", 1)], "key string, type int, value string, day int"), "day", ["key"])
    assert a.manifest().high_water == 15


def test_flushes_and_merges_that_meet(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    for s in (1, 2):
        e.append(log_of(spark, [("k", s, PUT, str(s))]))
    one, two = e.merge(), e.merge()
    e.append(log_of(spark, [("k", 3, PUT, "3")]))
    e.install(one)
    before = e.manifest().version
    assert rows_of(e.log(), "seq") == [(2,), (3,)] and e.manifest().totals["files_in"] == 2
    assert e.install(two).version == before  # its inputs are gone: nothing changes
    assert [r["position"] for r in e.tables().orderBy(F.desc("max_seq")).collect()] == [0, 1]
    reader = e.log(version=2)
    e.compact()
    assert reader.count() == 2
    assert e.vacuum(versions=1) == 4 and rows_of(e.as_of(), "key", "value") == [("k", "3")]


def test_snapshots_of_other_processes(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a, b = Engine(spark, root), Engine(spark, root)
    a.append(log_of(spark, [("k", 1, PUT, "1")]))
    pinned = a.snapshot()
    b.append(log_of(spark, [("k", 2, PUT, "2")]))
    b.compact()
    assert rows_of(a.as_of(pinned), "value") == [("1",)] and b.floor() == pinned
    a.release(pinned)
    with pytest.raises(LogError):
        a.release(pinned)
    assert b.floor() == 2


def test_engine_calls(spark, tmp_path):
    seen = []
    e = Engine(spark, f"file://{tmp_path}/s", before_write=lambda log: seen.append(("before", e.manifest().version)), on_flushed=lambda s: seen.append(("flushed", s, e.manifest().version)))
    e.append(log_of(spark, [("k", 5, PUT, "v")]))
    assert seen == [("before", 0), ("flushed", 5, 1)]
    e.delete(spark.createDataFrame([("k",), ("k",), ("gone",)], "key string"))
    assert rows_of(e.log(), "key", "seq", "type") == [("gone", 6, DELETE), ("k", 5, PUT), ("k", 7, DELETE)]
    assert rows_of(e.contains(spark.createDataFrame([("k",)], "key string")), "found") == [(False,)]
    with pytest.raises(LogError, match="rise"):
        e.restore(log_of(spark, [("x", 7, PUT, "v")]))
    with pytest.raises(LogError, match="rise"):
        e.restore(log_of(spark, [("x", 9, PUT, "v"), ("y", 9, PUT, "v")]))
    e.restore(log_of(spark, [("x", 12, PUT, "v")]))
    assert e.info().first()["sequence"] == 12
    e.clear()
    assert e.log().count() == 0 and e.manifest().high_water == 12


def test_binary_log_on_disk(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    log = log_of(spark, [(f"k{i % 7}", i, PUT, f"v{i}") for i in range(1, 300)])
    wal.write(log.where("seq <= 200"), root, files=3)
    wal.write(log.where("seq > 200"), root)
    assert len(wal.last_sequences(spark, root)) == 4
    with pytest.raises(LogError):
        wal.write(log.where("seq = 250"), root)
    back = lambda: [r[0] for r in rows_of(wal.records(spark, root), "seq")]
    assert back() == list(range(1, 300)) and not [n for n in Folder(spark, root).sizes() if not n.endswith(".wal")]
    for cut in (0, 1, 57, 200, 298, 299):
        wal.discard_through(spark, root, cut)
        assert back() == list(range(cut + 1, 300))


def test_node_cut_at_many_bytes(spark, tmp_path):
    """Twelve records over four keys, every fifth a delete; the log is cut at bytes round every frame's edges."""
    rows = [("abcd"[i % 4], i + 1, DELETE if i % 5 == 4 else PUT, "" if i % 5 == 4 else f"v{i}") for i in range(12)]
    frames = [wal.encode(wal.Record(s, t, k.encode(), v.encode())) for k, s, t, v in rows]
    ends = [sum(map(len, frames[: i + 1])) for i in range(12)]
    raw = b"".join(frames)
    for n, cut in enumerate([0, 3, ends[0] - 1, ends[0], ends[5] + 9, ends[10] + 1, ends[11] - 1, ends[11]]):
        root = f"file://{tmp_path}/n{n}"
        Folder(spark, f"{root}/wal").write("00000000000000000012.wal", raw[:cut])
        node = Node(spark, root)
        whole = sum(e <= cut for e in ends)
        state: dict = {}
        for k, s, t, v in rows[:whole]:
            state[k] = v if t == PUT else None
        assert rows_of(node.as_of(), "key", "value") == sorted((k, v) for k, v in state.items() if v is not None)
        assert node.recovered["records_read"] == whole and node.recovered["torn_tail"] == (cut not in (0, *ends)) and node.last == whole
        again = Node(spark, root)
        assert not again.recovered["torn_tail"] and again.last == whole
    damaged = f"file://{tmp_path}/bad"
    Folder(spark, f"{damaged}/wal").write("00000000000000000012.wal", raw[: ends[3] + 12] + b"\xff" + raw[ends[3] + 13 :])
    with pytest.raises(LogError, match="corrupt"):
        Node(spark, damaged)


def test_shell(spark, tmp_path):
    node = Node(spark, f"file://{tmp_path}/n")
    said = list(shell.run(node, ['PUT "a b" "1 2"', "put k v", 'GET "a b"', "DEL k", "GET k", "CONTAINS k", "PUT k", "", "what", 'GET "', "INFO", "FLUSH", "HELP", "EXIT", "GET k"]))
    assert said[:8] == ["OK sequence=1", "OK sequence=2", 'VALUE "1 2"', "OK sequence=3", "NOT_FOUND", "FALSE", "ERROR usage: PUT <key> <value>", "ERROR unknown command; type HELP"]
    assert said[8].startswith("ERROR") and "sequence=3" in said[9] and said[10] == "OK flushed_up_to=3" and said[-1] == "Closed." and len(said) == 13
    assert rows_of(Node(spark, f"file://{tmp_path}/n").as_of(), "key", "value") == [("a b", "1 2")]


def test_state_file(spark, tmp_path):
    state = raft_state.State(term=5, voted_for=2, committed=2, applied=1, applied_writes=1, leader=3)
    entries = [(1, b"a"), (1, b""), (4, b"ccc")]
    raw = raft_state.encode(state, entries)
    back, log = raft_state.decode(raw, {1, 2})
    assert log == entries and (back.term, back.voted_for, back.committed, back.applied, back.leader) == (5, 2, 2, 1, 0)
    rng = random.Random(1)
    for _ in range(200):
        i = rng.randrange(len(raw))
        bad = bytearray(raw)
        bad[i] ^= 1 << rng.randrange(8)
        with pytest.raises(LogError):
            raft_state.decode(bytes(bad))
        with pytest.raises(LogError):
            raft_state.decode(raw[:i])
    for wrong in (raft_state.State(term=3), raft_state.State(term=5, committed=4), raft_state.State(term=5, committed=1, applied=2)):
        with pytest.raises(LogError, match="fit"):
            raft_state.decode(raft_state.encode(wrong, entries))
    with pytest.raises(LogError, match="fit"):
        raft_state.decode(raw, {1})
    root = f"file://{tmp_path}"
    assert raft_state.load(spark, root)[0] == raft_state.State()
    with pytest.raises(LogError, match="missing"):
        raft_state.load(spark, root, durable_writes=1)
    with pytest.raises(LogError, match="missing"):
        raft_state.save(spark, root, state, spark.createDataFrame([(2, 1, bytearray(b"x"))], "idx long, term long, command binary"))


def test_state_file_of_stretches(spark, tmp_path, monkeypatch):
    """Bytes as encode() has them from entries in any order over tasks; no entry passes the driver; a loaded log stays."""
    root, schema = f"file://{tmp_path}/s", "idx long, term long, command binary"
    state = raft_state.State(term=9, committed=500, applied=3)
    entries = [(1 + i // 300, bytes([i % 256]) * (i * 7 % 40)) for i in range(2000)]
    df = spark.createDataFrame([(i + 1, t, bytearray(c)) for i, (t, c) in enumerate(entries)][::-1], schema).repartition(7)
    with monkeypatch.context() as m:
        for name in ("encode", "decode"):
            m.setattr(raft_state, name, None)
        m.setattr(raft_state, "PIECE", 1000)
        raft_state.save(spark, root, state, df)
        back, log = raft_state.load(spark, root)
    assert (tmp_path / "s" / "raft.state").read_bytes() == raft_state.encode(state, entries)
    assert [p.name for p in (tmp_path / "s").iterdir() if not p.name.endswith(".crc")] == ["raft.state"]
    raft_state.save(spark, root, state, log.where("idx < 1000"))
    assert back == state and [(r["term"], bytes(r["command"])) for r in log.orderBy("idx").collect()] == entries
    assert raft_state.load(spark, root)[1].count() == 999
    raft_state.save(spark, root, raft_state.State(), df.limit(0))
    assert raft_state.load(spark, root)[1].count() == 0
    for gone in (1, 700):
        with pytest.raises(LogError, match=f"entry {gone} is missing"):
            raft_state.save(spark, root, state, df.where(f"idx <> {gone}"))
    with pytest.raises(LogError, match="entry 6 is missing"):
        raft_state.save(spark, root, state, df.unionByName(df.where("idx = 5")))
    raw = raft_state.encode(state, entries)
    for bad, why in ((raw[:-9] + b"x" + raw[-8:], "checksum"), (raw[:50], "not a state|checksum"), (b"", "not a state"), (raft_state.encode(raft_state.State(term=2, committed=1), entries), "fit"), (raft_state.encode(state, entries[::-1]), "bad entry")):
        (tmp_path / "s" / "raft.state").write_bytes(bad)
        (tmp_path / "s" / ".raft.state.crc").unlink(missing_ok=True)
        with pytest.raises(LogError, match=why):
            raft_state.load(spark, root)


def test_table_sections(spark, tmp_path):
    rows = [(f"x{i // 2:04d}".encode(), 1000 - i, PUT, b"v" * (i % 50)) for i in range(600)]
    raw = sstable.encode(rows)
    meta = sstable.decode(raw)[0]
    at, n = meta["filter"]
    assert sstable.may_contain(raw[at : at + n], [k for k, *_ in rows]).all() and sstable.may_contain(raw[at : at + n], [f"no{i}".encode() for i in range(999)]).mean() < 0.05
    low, high, blocks = sstable.index_of(raw[slice(meta["index"][0], sum(meta["index"]))])
    assert (low, high) == (b"x0000", b"x0299") and blocks[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(blocks, blocks[1:], strict=False))
    for section in ("index", "filter"):
        at, n = meta[section]
        for i in (0, 9, 13, 20):
            bad = bytearray(raw)
            bad[at + i] ^= 0x55
            with pytest.raises(LogError):
                sstable.decode(bytes(bad))
    one = struct.pack("<I", 1) + b"a" + struct.pack("<I", 1) + b"z" + struct.pack("<I", 2)
    twice = one + 2 * (struct.pack("<I", 1) + b"b" + struct.pack("<QI", 0, 10))
    with pytest.raises(LogError, match="rise"):
        sstable.index_of(twice)
    for cut in (3, 9, 14, len(twice) - 1):
        with pytest.raises(LogError):
            sstable.index_of(twice[:cut])
    with pytest.raises(LogError):
        sstable.filter_of(b"")
    with pytest.raises(FileExistsError):
        entries = log_of(spark, [("a", 1, PUT, "v")]).withColumns({"file_no": F.lit(1).cast("long"), "level": F.lit(0)})
        sstable.write(entries, f"file://{tmp_path}")
        sstable.write(entries, f"file://{tmp_path}")


def test_digests_tell_changes_apart(spark):
    rows = [("a", 1, PUT, "x"), ("a", 2, PUT, "x"), ("b", 3, PUT, "y")]
    entries = lambda r: log_of(spark, r).withColumn("file_no", F.lit(1).cast("long"))
    manifest = sizes.file_digests(entries(rows))
    ok = lambda r: sizes.verified(entries(r), manifest).first()["intact"]
    assert ok(rows[::-1]) and not ok([("a", 1, PUT, "z"), ("a", 2, PUT, "z"), rows[2]]) and not ok(rows[:2]) and not ok([])


def test_single_node(spark):
    node = SingleNode()
    commands = spark.createDataFrame([(1, "a", "1", 0), (9, "b", "", 1), (1, "a", "2", 2), (3, "", "", 3), (2, "a", "", 4)], "cmd int, key string, value string, no int")
    out = node.propose(commands.withColumn("g", F.lit(0)), "g", ["no"])
    assert rows_of(out, "no", "status", "idx") == [(0, "ACCEPTED", 1), (1, "INVALID", None), (2, "ACCEPTED", 2), (3, "ACCEPTED", 3), (4, "ACCEPTED", 4)]
    assert node.commit_up_to(2) == 2 and rows_of(node.state(), "key", "value") == [("a", "2")]
    assert node.commit_up_to(1) == 2 and node.commit_all() == 4 and node.state().count() == 0
    node.set_leader(False, 3)
    assert rows_of(node.propose(commands.withColumn("g", F.lit(0)), "g", ["no"]), "status") == [("NOT_LEADER",)] * 5


def test_filters_of_files(spark):
    entries = log_of(spark, [(f"k{i}", i + 1, PUT, "") for i in range(50)]).withColumn("file_no", F.floor(F.col("seq") / 30).cast("long"))
    asked = spark.createDataFrame([(0, "k3"), (1, "k3"), (9, "k3"), (0, "k3")], "file_no long, key string")
    got = {r["file_no"]: r["may_contain"] for r in bloom.probe(asked, bloom.build(entries)).collect()}
    assert got[0] is True and got[9] is False and len(got) == 3
