"""Distributed orders against plain loops, and plans that must not pair everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom
from tidelog.operators import index, layout, mvcc, retention, running
from tidelog.schema import DELETE, PUT

from .test_engine import log_of, rows_of


@pytest.mark.parametrize("stretches", [1, 3])
def test_predecessors(spark, stretches):
    rng = random.Random(stretches)
    marks = [(f"{rng.randrange(4000):04d}", i) for i in range(300)] + [("", -1), ("5000", 9), ("5000", 12)]
    points = [(f"{rng.randrange(6000):04d}", i) for i in range(400)] + [("", 0), (None, 1), ("zz", 2)]
    found = running.predecessors(spark.createDataFrame(points, "key string, no long"), spark.createDataFrame(marks, "key string, at long"), "key", ["key", "at"], stretches)
    assert found.columns == ["key", "no", "_mark"]
    for r in found.collect():
        want = max(((k, a) for k, a in marks if r["key"] is not None and k <= r["key"]), default=None)
        assert (tuple(r["_mark"]) if r["_mark"] else None) == want
    only = running.predecessors(spark.createDataFrame(points, "key string, no long"), spark.createDataFrame([], "key string, at long"), "key", ["at"])
    assert only.where("_mark is not null").count() == 0


@pytest.mark.parametrize(("limit", "segments"), [(50, 1), (50, 4), (7, 16), (300, 5), (100_000, 3)])
def test_greedy_stretches(spark, limit, segments):
    """Against one loop over all rows, with records far over the limit."""
    rng = random.Random(limit)
    sizes = [rng.choice([1, 2, 9, 9, 9, 30, 400 if rng.random() < 0.1 else 3]) for _ in range(900)]
    rows, at, no, began = [], 0, 0, None
    for i, s in enumerate(sizes):
        if began is None or at - began >= limit:
            no, began = no + 1, at
        rows.append((at, f"k{i}", s, no))
        at += s
    df = spark.createDataFrame(rows, "p long, key string, s long, want long").repartition(5)
    assert running.chained(df, "p", limit, segments).where("want <> _no").count() == 0
    assert running.chained(df.limit(0), "p", limit).count() == 0


def test_rotation_and_rolling_against_a_loop(spark):
    rng = random.Random(1)
    log = [(f"key{rng.randrange(90):02d}", i + 1, PUT, "v" * rng.randrange(0, 60)) for i in range(500)]
    tables, held = [], 0
    for k, s, _, v in log:
        if not tables or held >= 700:
            tables.append([0, 0, 0])
            held = 0
        held += len(k) + len(v) + 9
        tables[-1] = [tables[-1][0] + 1, held, s]
    assert rows_of(layout.rotate(log_of(spark, log), 700), "batch_id", "entries", "bytes", "last_seq") == [(i + 1, *t) for i, t in enumerate(tables)]
    files, held = [], 0
    for key in sorted({k for k, *_ in log}):
        if not files or held >= 900:
            files.append([key, key, 0])
            held = 0
        held += sum(17 + len(k) + len(v) for k, _, _, v in log if k == key)
        files[-1] = [files[-1][0], key, held]
    assert rows_of(layout.roll(log_of(spark, log), 900), "file_no", "min_key", "max_key", "bytes") == [(i + 1, *f) for i, f in enumerate(files)]


def test_numbers_of_null_groups(spark):
    rows = spark.createDataFrame([(None, "b"), (1, "a"), (None, "a"), (2, "c")], "day int, key string")
    assert rows_of(mvcc.assign_sequences(rows, "day", ["key"], start=5).select("key", "seq"), "seq", "key") == [(6, "a"), (7, "b"), (8, "a"), (9, "c")]


def test_retention_of_a_hot_key(spark):
    rng = random.Random(5)
    log = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(9)}", s, rng.choice([PUT, PUT, DELETE]), "") for s in range(1, 400)]
    twice = log_of(spark, log + log[::3])
    deeper = spark.createDataFrame([("a", "k3")], "min_key string, max_key string")
    want = [(k, s) for k, s, t, _ in log if s > 300 or (s == max(x for kk, x, *_ in log if kk == k and x <= 300) and (t == PUT or "a" <= k <= "k3"))]
    assert rows_of(retention.compact(twice, 300, deeper), "key", "seq") == sorted(want)


def test_falling_sequences_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mvcc, "ARRIVALS", 10)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(100), i) for i in range(80)]
    want, top = [], {}
    for k, s, i in rows:
        if s <= top.get(k, -1):
            want.append((k, s, i))
        top[k] = max(top.get(k, -1), s)
    assert rows_of(mvcc.falling(spark.createDataFrame(rows, "key string, seq long, no long"), "no"), "key", "seq", "arrival") == sorted(want)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_pair_nothing_with_everything(spark):
    log = log_of(spark, [(f"k{i:03d}", i + 1, PUT, "v") for i in range(200)])
    entries = log.withColumn("file_no", F.floor(F.col("seq") / 50))
    files = layout.file_metadata(entries).withColumn("level", F.lit(1))
    keys = log.select("key")
    marks = files.select(F.col("min_key").alias("key"), "file_no")
    for df in (running.predecessors(keys, marks, "key", ["file_no"]), index.lookup(entries.select("file_no", "key"), index.build(entries)), bloom.probe(entries.select("file_no", "key"), bloom.build(entries)), retention.compact(log, 100), layout.rotate(log, 500)):
        plan = _plan(df)
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Window" not in _plan(retention.compact(log, 100))
    assert layout.candidates(keys, files, disjoint=True).count() == 200


@pytest.mark.parametrize("stretch", [1, 3, 512])
def test_overlapping_ranges_meet_stretches_of_keys(spark, stretch):
    """Against a loop, with repeated and null keys, empty and open ranges; keys and ranges are not paired one by one."""
    rng = random.Random(stretch)
    keys = [(f"{rng.randrange(60):02d}",) for _ in range(80)] + [(None,)]
    ranges = [(i, *sorted((f"{rng.randrange(60):02d}", f"{rng.randrange(60):02d}")), f"{rng.randrange(60):02d}" if i % 3 else None) for i in range(40)] + [(40, "5", "1", None)]
    df = spark.createDataFrame(ranges, "file_no int, min_key string, max_key string, until string")
    asked = spark.createDataFrame(keys, "key string")
    want = sorted((k, n) for (k,) in keys for n, a, b, u in ranges if k is not None and a <= k <= b and (u is None or k < u))
    assert rows_of(layout.held(asked, df, ["file_no"], stretch), "key", "file_no") == want
    met = layout.candidates(asked, df.drop("until"))
    assert rows_of(met, "key", "file_no") == sorted((k, n) for (k,) in keys for n, a, b, _ in ranges if k is not None and a <= k <= b)
    assert "explode" in _plan(met)


def _levels(spark):
    """Keys, files of two levels, and entries: files of level 0 overlap, one has a number of level 1, one is not known."""
    rng = random.Random(8)
    rows = [(0, i // 90, f"k{rng.randrange(300):03d}", i + 1, PUT, "v") for i in range(900)] + [(1, 5 + k // 100, f"k{k:03d}", k + 2000, PUT, "v") for k in range(0, 300, 2)]
    entries = spark.createDataFrame(rows, "level int, file_no long, key string, seq long, type int, value string")
    files = layout.file_metadata(entries, ("level", "file_no")).select("level", "file_no", "min_key", "max_key")
    files = files.unionByName(spark.createDataFrame([(0, 77, None, None), (0, 78, "k1", "k2")], files.schema))
    keys = spark.createDataFrame([(f"k{rng.randrange(330):03d}",) for _ in range(200)] + [("",), ("zz",), (None,)], "key string")
    return keys, files, entries


def test_blocks_of_all_files_of_a_key(spark):
    """As pairs that are looked up; level 0 needs no exchange of pairs."""
    keys, files, entries = _levels(spark)
    blocks = index.build(entries, every=16)
    found = index.searched(keys, files, blocks)
    cols = ("file_no", "probe", "block_key")
    as_rows = lambda df: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = as_rows(index.lookup(layout.probed(keys, files), blocks))
    assert len(want) > 1000 and as_rows(found) == want
    assert "explode" in _plan(index.searched(keys, files, blocks))


def test_filters_of_all_files_of_a_key(spark):
    """As pairs that are asked one by one, and no key that is there is denied."""
    keys, files, entries = _levels(spark)
    filters = bloom.build(entries)
    as_rows = lambda df: sorted((tuple(r) for r in df.select("file_no", "probe", "may_contain").collect()), key=repr)
    got = as_rows(index.filtered(keys, files, filters))
    assert got == as_rows(bloom.probe(layout.probed(keys, files), filters))
    there = {(r["file_no"], r["key"]) for r in entries.collect()}
    assert all(yes for n, k, yes in got if (n, k) in there) and not all(yes for *_, yes in got)


def test_hashes_cut_to_any_size(spark):
    """The halves give the positions of 64-bit arithmetic, at the largest size too."""
    names = [f"user:{i}" for i in range(50)] + ["", "é" * 40]
    for bits in (64, 1000, bloom.MOST_BITS):
        row = spark.createDataFrame([(k,) for k in names], "key string").withColumn("h", bloom.halves("key"))
        at = row.select("key", *[((F.col("h")[2 * i] * F.lit((1 << 32) % bits) + F.col("h")[2 * i + 1]) % bits).alias(f"p{i}") for i in range(bloom.PROBES)])
        want = {k: tuple(p) for k, p in zip(names, bloom.positions([k.encode() for k in names], np.full(len(names), bits)).tolist(), strict=True)}
        assert {r[0]: tuple(r)[1:] for r in at.collect()} == want


def test_ranges_go_to_groups_of_keys_they_reach(spark):
    """Many groups, ranges over several of them; no key or pair meets all ranges, whatever may be broadcast."""
    rng = random.Random(12)
    keys = [(f"{rng.randrange(900):03d}",) for _ in range(700)] + [(None,), ("",)]
    ranges = [(i, *sorted((f"{rng.randrange(900):03d}", f"{rng.randrange(900):03d}")), f"{rng.randrange(900):03d}" if i % 3 else None) for i in range(60)] + [(60, None, "9", None), (61, "", None, None)]
    df = spark.createDataFrame(ranges, "file_no int, min_key string, max_key string, until string")
    asked = spark.createDataFrame(keys, "key string").withColumn("also", F.length("key"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = layout.held(asked, df, ["file_no"], 4)
        plan = _plan(met)
        got = rows_of(met, "key", "also", "file_no")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert got == sorted((k, len(k), n) for (k,) in keys for n, a, b, u in ranges if None not in (k, a, b) and a <= k <= b and (u is None or k < u))


def test_filters_are_built_by_batches_of_rows(spark):
    """Files cut by batches and batches of many files, against positions of each file alone; no group for each file."""
    sizes = {1: 1, 2: 30, 3: 2, 4: 11, 9: 5, 12: 64}
    rows = [(n, f"k{n}-{i % 25}") for n, size in sizes.items() for i in range(size)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        built = bloom.build(spark.createDataFrame(rows, "file_no int, key string"))
        got = {r["file_no"]: (r["bits"], bytes(r["field"])) for r in built.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroups" not in _plan(built)
    for n, size in sizes.items():
        bits = max(64, 10 * size)
        field = np.zeros(-(-bits // 8) * 8, np.uint8)
        field[bloom.positions([f"k{n}-{i}".encode() for i in range(min(size, 25))], np.full(min(size, 25), bits)).ravel()] = 1
        assert got.pop(n) == (bits, np.packbits(field, bitorder="little").tobytes())
    assert not got
