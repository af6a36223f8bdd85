"""Size-tiered compaction of immutable shards under a versioned manifest. DataFrame functions only.

An arrival is written as a run of small shards that never change. Runs whose sizes fall in one tier (powers of FANOUT
over BASE bytes) are merged as soon as there are FANOUT of them: the runs' files are packed into tasks of the target
size and each task writes one file, so merging shuffles nothing. A manifest lists the runs of the store; its next
version is written aside and renamed into place, which succeeds for one writer only where a rename does not replace
files (HDFS and like stores; a plain object store needs a store with conditional puts under it). Compaction deletes
nothing: readers keep the version they opened until vacuum() is told how many versions to retain.

Defined results: rows are stored as they are, nulls, repeats and further columns too; an arrival may bring columns that
the store has not (older rows read as null) or lack some, but a column of another type raises; an empty arrival adds
no run; an empty store reads as no rows; a failed commit leaves the former version and raises.
"""

from __future__ import annotations

import contextlib
import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut, remove, shared_dir

FANOUT = 4
MOST = 32
BASE = 1 << 20
TARGET = 128 << 20


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    number: int
    path: str
    bytes: int
    files: int
    merged: int = 0

    @property
    def tier(self) -> int:
        return tier_of(self.bytes)


def tier_of(size: int) -> int:
    """0 up to BASE bytes, then one more for every factor FANOUT."""
    return 0 if size <= BASE else 1 + math.floor(math.log(size / BASE, FANOUT))


def due(runs: list[Run], fanout: int = FANOUT, most: int = MOST) -> list[Run]:
    """The runs to merge next: of the lowest tier with `fanout` runs, the oldest, `most` at once. Empty: nothing is due."""
    tiers: dict[int, list[Run]] = {}
    for r in runs:
        tiers.setdefault(r.tier, []).append(r)
    for t in sorted(tiers):
        if len(tiers[t]) >= fanout:
            return sorted(tiers[t], key=lambda r: r.number)[:most]
    return []


def merged(old: StructType, new: StructType) -> StructType:
    """The columns of both, those of the store first; all may be null."""
    out = {f.name: StructField(f.name, f.dataType, True) for f in old}
    for f in new:
        if out.setdefault(f.name, StructField(f.name, f.dataType, True)).dataType != f.dataType:
            raise ValueError(f"column {f.name} is {out[f.name].dataType.simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
    return StructType(list(out.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root, target, fanout
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        top = self._path(f"{self.root}/manifests")
        if not self._fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "next": 1, "runs": [], "schema": None}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self.manifest(version)["runs"]]

    def commit(self, base: int, runs: list[Run], schema: str | None, number: int) -> int:
        """Make `runs` the version after `base`, for one writer only."""
        top, new = f"{self.root}/manifests", base + 1
        aside = self._path(f"{top}/.{uuid.uuid4().hex}")
        final = self._path(f"{top}/v{new:08d}.json")
        self._fs.mkdirs(self._path(top))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": new, "next": number, "runs": [asdict(r) for r in runs], "schema": schema}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise CommitConflict(f"version {new} exists")
        return new

    # runs

    def _sized(self, number: int, path: str, merged: int = 0) -> Run | None:
        files = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        return Run(number, path, sum(s.getLen() for s in files), len(files), merged) if files else None

    def append(self, df: DataFrame, arrival: str | None = None) -> list[Run]:
        """Store an arrival, or, with a column that numbers them, several in one pass; that column is not stored."""
        now = self.manifest()
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        number, added = now["next"], []
        schema = df.schema if arrival is None else df.drop(arrival).schema
        both = merged(StructType.fromJson(json.loads(now["schema"])), schema) if now["schema"] else schema
        if arrival is None:
            df.write.parquet(path, compression="zstd")
            found = [path]
        else:
            df.write.partitionBy(arrival).parquet(path, compression="zstd")
            found = sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())
        if found and self.spark.read.schema(schema).parquet(*found).isEmpty():
            found = []
        for p in found:
            if run := self._sized(number, p):
                added.append(run)
                number += 1
        whole = json.dumps(both.jsonValue())
        for k, run in enumerate(added):  # every arrival is a version of its own
            self.commit(now["version"] + k, [Run(**r) for r in now["runs"]] + added[: k + 1], whole, run.number + 1)
        if not added:
            remove(self.spark, path)
        return added

    @contextlib.contextmanager
    def _packed(self):
        """Scans cut and pack files to the target size."""
        conf = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        old = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def compact(self) -> int:
        """Merge until no tier has enough runs; the number of merges. Every merge is a version of its own; what it
        replaces stays for readers of older versions."""
        merges = 0
        while chosen := due(self.runs(), self.fanout):
            now = self.manifest()
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            schema = StructType.fromJson(json.loads(now["schema"]))
            with self._packed():
                self.spark.read.schema(schema).parquet(*[r.path for r in chosen]).write.parquet(path, compression="zstd")
            gone = {r.number for r in chosen}
            merged = self._sized(now["next"], path, sum(max(1, r.merged) for r in chosen))
            # a merge of many tiny runs may stay in its tier; alone it is not due again
            self.commit(now["version"], [Run(**r) for r in now["runs"] if r["number"] not in gone] + [merged], now["schema"], now["next"] + 1)
            merges += 1
        return merges

    def vacuum(self, versions: int = 1) -> int:
        """Delete manifests older than the newest `versions`, and runs that only they list; the number of runs deleted.
        Data that no manifest lists is left alone: it may be a write that has not committed yet."""
        top = self.version()
        kept = range(max(1, top - versions + 1), top + 1)
        live = {r.path for v in kept for r in self.runs(v)}
        gone: set[str] = set()
        for v in range(kept.start - 1, 0, -1):
            old = self._path(f"{self.root}/manifests/v{v:08d}.json")
            if not self._fs.exists(old):
                break
            gone |= {r.path for r in self.runs(v)} - live
            self._fs.delete(old, False)
        for path in gone:
            remove(self.spark, path)
        return len(gone)

    def read(self, version: int | None = None, numbered: bool = False) -> DataFrame:
        """The rows of a version; numbered: with the run's number and tier in _run and _tier."""
        now = self.manifest(version)
        runs = [Run(**r) for r in now["runs"]]
        if not now["schema"]:
            raise FileNotFoundError(f"no version in {self.root}")
        schema = StructType.fromJson(json.loads(now["schema"]))
        parts = []
        for r in runs:
            df = self.spark.read.schema(schema).parquet(r.path)
            parts.append(df.withColumns({"_run": F.lit(r.number).cast("long"), "_tier": F.lit(r.tier)}) if numbered else df)
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


ARRIVALS = 16


def stored(docs: DataFrame, arrivals: int = ARRIVALS, target: int = TARGET) -> DataFrame:
    """Store docs, all columns, as arrivals by their source, compact, and read every row back through the last manifest:
    doc_id, n_bytes, text_crc32, run, tier, merged (arrivals behind the run)."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    store = ShardStore(spark, root, target)
    try:
        # 16 arrivals of unlike size; each task of the scan writes its own small shards
        store.append(docs.withColumn("_arrival", F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(arrivals))), "_arrival")
        store.compact()
        runs = store.runs()
        rows = store.read(numbered=True) if runs else docs.select("doc_id", "text", F.lit(0).cast("long").alias("_run"), F.lit(0).alias("_tier")).limit(0)
        merged = F.lit(0)
        for r in runs:
            merged = F.when(F.col("_run") == r.number, max(1, r.merged)).otherwise(merged)
        text = F.coalesce("text", F.lit(""))
        return cut(rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("_run").alias("run"), F.col("_tier").alias("tier"), merged.cast("long").alias("merged")))
    finally:
        remove(spark, root)
