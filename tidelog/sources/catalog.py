"""Tables of versions on disk under a versioned manifest.

A table is a folder of Parquet files, range-partitioned by key and sorted canonically, so min/max statistics prune keys
and sequences. Folders have names of their own; a table's number is given when the manifest takes it. The manifest lists
live tables from the oldest to the newest with their metadata, the greatest sequence ever used, the oldest sequence that
is still complete, and totals. Its next version is written aside and renamed into place; a writer that comes second
makes its change again on what the first one left. Nothing is deleted before vacuum(), so readers keep their version.
Snapshots are files, so that compactions of other processes see them. Sequences are never used twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, mvcc, retention
from ..schema import DELETE, LogError
from .files import Folder

TOTALS = ("flushes", "compactions", "files_in", "files_out", "entries_in", "entries_out", "bytes_in", "bytes_out")


@dataclass
class Manifest:
    version: int = 0
    next_file: int = 1
    high_water: int = 0
    retained_from: int = 0
    batches: int = -1
    tables: list[dict] = field(default_factory=list)
    totals: dict[str, int] = field(default_factory=lambda: dict.fromkeys(TOTALS, 0))

    def with_tables(self, tables: list[dict], **changes) -> Manifest:
        return replace(self, tables=tables, **changes)


@dataclass
class Merge:
    """A compaction that has been written and not yet published."""

    inputs: list[dict]
    output: dict | None
    floor: int


class Engine:
    """A store of versions. before_write(log) runs before a flush touches the store, on_flushed(sequence) after the
    manifest with it is there."""

    def __init__(self, spark: SparkSession, root: str, trigger: int = layout.TIERED_TRIGGER, before_write: Callable[[DataFrame], None] | None = None, on_flushed: Callable[[int], None] | None = None):
        self.spark, self.root, self.trigger = spark, root, trigger
        self.before_write, self.on_flushed = before_write, on_flushed
        self._files = Folder(spark, root)

    # manifest

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max((int(n[:-5]) for n in self._files.sizes("manifest") if n.endswith(".json")), default=0)
        return Manifest(**json.loads(self._files.read(f"manifest/{version:012d}.json"))) if version else Manifest()

    def _publish(self, m: Manifest) -> Manifest:
        self._files.write(f"manifest/{m.version:012d}.json", json.dumps(m.__dict__).encode())
        return m

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """The version after the newest by change(newest); if another writer came first, by change of what it left."""
        while True:
            m = self.manifest()
            new = change(m)
            if new is None:
                return m
            try:
                return self._publish(replace(new, version=m.version + 1))
            except FileExistsError:
                continue

    def publish(self, m: Manifest, removed: list[int] = (), added: list[dict] = ()) -> Manifest:
        """The version after m: its tables without `removed`, with `added` as the newest."""
        known = {t["file_no"] for t in m.tables}
        if missing := set(removed) - known:
            raise LogError(f"not in the manifest: {sorted(missing)}")
        new = m.with_tables([t for t in m.tables if t["file_no"] not in removed] + list(added), version=m.version + 1)
        try:
            return self._publish(new)
        except FileExistsError:
            raise LogError(f"version {new.version} exists") from None

    def _write(self, log: DataFrame) -> dict | None:
        """A table of log in a folder of its own; None if it is empty."""
        path = f"tables/{uuid.uuid4().hex}"
        log.select("key", "seq", "type", "value").repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.parquet(f"{self.root}/{path}")
        # from the Parquet files' own statistics and two short columns
        meta = layout.file_metadata(self.spark.read.parquet(f"{self.root}/{path}").withColumn("file_no", F.lit(0))).first()
        if meta is None:
            self._files.delete(path)
            return None
        return {**meta.asDict(), "path": path}

    # writing

    def append(self, log: DataFrame, batch: int | None = None, after: int | None = None) -> Manifest:
        """Flush versions (key, seq, type, value) as the newest table. A batch number that has been stored is skipped, so a
        stream may repeat its last batch. after: the high-water mark that the sequences were given from; if another
        writer has moved it, they are taken and the flush fails."""
        m = self.manifest()
        if batch is not None and batch <= m.batches:
            return m
        if self.before_write:
            self.before_write(log)
        meta = self._write(log)
        if meta and meta["min_seq"] < 1:
            self._files.delete(meta["path"])
            raise LogError("sequences start at 1")

        def change(now: Manifest) -> Manifest | None:
            if batch is not None and batch <= now.batches:
                return None
            if after is not None and now.high_water != after:
                raise LogError(f"sequences over {after} are taken")
            new = replace(now, batches=now.batches if batch is None else batch, totals={**now.totals, "flushes": now.totals["flushes"] + 1})
            if not meta:
                return new
            return new.with_tables([*now.tables, {**meta, "file_no": now.next_file}], next_file=now.next_file + 1, high_water=max(now.high_water, meta["max_seq"]))

        new = self._commit(change)
        if self.on_flushed:
            self.on_flushed(new.high_water)
        return new

    def put(self, rows: DataFrame, day: str, order: list[str]) -> Manifest:
        """Versions without sequences get the next ones in arrival order."""
        start = self.manifest().high_water
        return self.append(mvcc.assign_sequences(rows, day, order, start=start), after=start)

    def delete(self, keys: DataFrame) -> Manifest:
        """A tombstone for every distinct key, whether the store has it or not, in the order of the keys."""
        rows = keys.select("key").distinct().select("key", F.lit(DELETE).alias("type"), F.lit("").alias("value"), F.substring("key", 1, 7).alias("_head"))
        return self.put(rows, "_head", ["key"])

    def restore(self, log: DataFrame) -> Manifest:
        """Versions at their own sequences, which must exceed all that were used; gaps are allowed."""
        start = self.manifest().high_water
        least, n, kinds = log.agg(F.min("seq"), F.count("*"), F.count_distinct("seq")).first()
        if least is not None and (least <= start or n != kinds):
            raise LogError(f"sequences must rise over {start}")
        return self.append(log, after=start)

    def clear(self) -> Manifest:
        """An empty store whose sequences go on."""
        return self._commit(lambda m: m.with_tables([], retained_from=m.high_water))

    # reading

    def tables(self, version: int | None = None) -> DataFrame:
        """Metadata of the live tables, the newest first (position 0)."""
        rows = [(i, t["file_no"], t["entry_count"], t["min_key"], t["max_key"], t["min_seq"], t["max_seq"], t["data_bytes"]) for i, t in enumerate(reversed(self.manifest(version).tables))]
        return self.spark.createDataFrame(rows, "position int, file_no long, entry_count long, min_key string, max_key string, min_seq long, max_seq long, data_bytes long")

    def log(self, version: int | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions in live tables; with bounds, tables out of their range are not opened."""
        m = self.manifest(version)
        paths = [f"{self.root}/{t['path']}" for t in m.tables if (low is None or t["max_key"] >= low) and (high is None or t["min_key"] <= high)]
        if not paths:
            return self.spark.createDataFrame([], "key string, seq long, type int, value string")
        df = self.spark.read.parquet(*paths)
        if low is not None:
            df = df.where(F.col("key") >= low)
        return df if high is None else df.where(F.col("key") <= high)

    def _clamped(self, seq: int | None, m: Manifest) -> int:
        """The future reads as the present."""
        if seq is not None and seq < m.retained_from:
            raise LogError(f"versions before {m.retained_from} are gone")
        return m.high_water if seq is None else min(seq, m.high_water)

    def as_of(self, seq: int | None = None, version: int | None = None) -> DataFrame:
        return mvcc.live(self.log(version), self._clamped(seq, self.manifest(version)))

    def get(self, keys: DataFrame, seq: int | None = None) -> DataFrame:
        """key, state, seq, value of every probe."""
        return mvcc.get(self.log(), keys, self._clamped(seq, self.manifest()))

    def contains(self, keys: DataFrame) -> DataFrame:
        return mvcc.contains(self.log(), keys)

    def info(self) -> DataFrame:
        """One row: sequence, flushed_up_to, tables, entries, bytes and the totals."""
        m = self.manifest()
        row = {"sequence": m.high_water, "flushed_up_to": m.high_water, "tables": len(m.tables), "entries": sum(t["entry_count"] for t in m.tables), "bytes": sum(t["data_bytes"] for t in m.tables), **m.totals}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))

    def snapshot(self) -> int:
        """Pin the present: compaction keeps what a reader at this sequence sees until release()."""
        seq = self.manifest().high_water
        self._files.write(f"snapshots/{seq:020d}-{uuid.uuid4().hex}", b"")
        return seq

    def release(self, seq: int) -> None:
        held = [n for n in self._files.sizes("snapshots") if int(n.split("-")[0]) == seq]
        if not held:
            raise LogError(f"no snapshot at {seq}")
        self._files.delete(f"snapshots/{held[0]}")

    def floor(self) -> int:
        """The oldest pinned snapshot, or the newest sequence."""
        return min([self.manifest().high_water, *(int(n.split("-")[0]) for n in self._files.sizes("snapshots"))])

    # maintenance

    def needs_compaction(self) -> bool:
        return len(self.manifest().tables) >= self.trigger

    def merge(self) -> Merge | None:
        """All present tables merged into one that no manifest lists yet; None for less than two."""
        m, floor = self.manifest(), self.floor()
        if len(m.tables) < 2:
            return None
        log = self.spark.read.parquet(*[f"{self.root}/{t['path']}" for t in m.tables])
        return Merge(m.tables, self._write(retention.compact(log, floor)), floor)

    def install(self, job: Merge) -> Manifest:
        """Publish a merge: its table takes the place of its inputs, under what has been flushed since. If any input is gone
        already (another compaction was first), nothing changes."""
        inputs = {t["file_no"] for t in job.inputs}

        def change(now: Manifest) -> Manifest | None:
            if not inputs <= {t["file_no"] for t in now.tables}:
                return None
            out = [{**job.output, "file_no": now.next_file}] if job.output else []
            sums = {"compactions": 1, "files_in": len(inputs), "files_out": len(out)}
            for name, key in (("entries", "entry_count"), ("bytes", "data_bytes")):
                sums |= {f"{name}_in": sum(t[key] for t in job.inputs), f"{name}_out": sum(t[key] for t in out)}
            rest = [t for t in now.tables if t["file_no"] not in inputs]
            return now.with_tables(out + rest, next_file=now.next_file + 1, retained_from=max(now.retained_from, job.floor), totals={k: v + sums.get(k, 0) for k, v in now.totals.items()})

        return self._commit(change)

    def compact(self) -> Manifest:
        """Merge all tables, two at least; the floor is the oldest pinned snapshot or the newest sequence."""
        job = self.merge()
        return self.install(job) if job else self.manifest()

    def vacuum(self, versions: int = 1) -> int:
        """Delete manifests before the newest `versions`, and tables that only they list; the number of tables deleted. Folders
        that no manifest ever listed stay: they may be a write in progress."""
        top = self.manifest().version
        kept = range(max(1, top - versions + 1), top + 1)
        live = {t["path"] for v in kept for t in self.manifest(v).tables}
        gone: set[str] = set()
        for name in self._files.sizes("manifest"):
            if name.endswith(".json") and int(name[:-5]) < kept.start:
                gone |= {t["path"] for t in self.manifest(int(name[:-5])).tables} - live
                self._files.delete(f"manifest/{name}")
        for path in gone:
            self._files.delete(path)
        return len(gone)

    def orphans(self) -> DataFrame:
        """file_no (the folder's name), status of the manifest's tables against those on disk."""
        frame = lambda xs: self.spark.createDataFrame([(x,) for x in xs], "file_no string")
        return layout.reconcile(frame([t["path"].split("/")[1] for t in self.manifest().tables]), frame(list(self._files.sizes("tables"))))
