"""A node's store: tables, and a write-ahead log of what they do not hold yet.

Opening reads the log over the flushed sequence, cuts a torn tail and refuses damage elsewhere. Writes go to the log
first; a flush makes a table of them and then drops them from the log. Reads see both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, mvcc
from ..schema import DELETE, LogError
from . import wal
from .catalog import Engine, Manifest


class Node:
    def __init__(self, spark: SparkSession, root: str, trigger: int = layout.TIERED_TRIGGER, form: str = "crc_first"):
        self.spark, self.form = spark, form
        self.logs = f"{root}/wal"
        self.engine = Engine(spark, f"{root}/tables", trigger, on_flushed=self._flushed)
        self.recovered = self._recover()

    # opening

    def _recover(self) -> dict[str, int | bool]:
        """records_read, skipped, applied, last_sequence, torn_tail, valid_bytes of the log as it was found."""
        flushed = self.engine.manifest().high_water
        stats: dict[str, int | bool] = {"records_read": 0, "skipped": 0, "applied": 0, "last_sequence": flushed, "torn_tail": False, "valid_bytes": 0}
        names = wal.last_sequences(self.spark, self.logs)
        if not names:
            self.last = flushed
            return stats
        found = wal.read(self.spark, self.logs, self.form)
        record = F.col("status") == wal.RECORD
        # a row a file
        files = found.groupBy("path").agg(
            F.max(F.when(~record, F.col("status"))).alias("status"), F.max("reason").alias("reason"), F.count_if(record).alias("n"), F.count_if(record & (F.col("seq") <= flushed)).alias("old"),
            F.coalesce(F.sum("frame_len"), F.lit(0)).alias("bytes"), F.min("seq").alias("first"), F.max("seq").alias("last"),
        ).collect()
        last = None
        for r in sorted(files, key=lambda r: r["path"]):
            name = r["path"].rsplit("/", 1)[1]
            newest = name == wal._name(names[-1])
            if r["status"] == wal.CORRUPT or r["status"] == wal.TRUNCATED_TAIL and not newest or last is not None and r["first"] is not None and r["first"] <= last:
                raise LogError(f"corrupt log {name}: {r['reason'] or 'sequence does not rise'}")
            last = r["last"] or last
            stats["records_read"] += r["n"]
            stats["skipped"] += r["old"]
            stats["applied"] += r["n"] - r["old"]
            stats["valid_bytes"] += r["bytes"]
            if r["status"] == wal.TRUNCATED_TAIL:
                wal.truncate(self.spark, self.logs, name, r["bytes"], r["last"])
                stats["torn_tail"] = True
        stats["last_sequence"] = self.last = max(flushed, last or 0)
        return stats

    # writing

    def _logged(self, rows: DataFrame, day: str, order: list[str]) -> int:
        log = mvcc.assign_sequences(rows, day, order, start=self.last).select("key", "seq", "type", "value")
        wal.write(log, self.logs, self.form)
        self.last = max([self.last, *wal.last_sequences(self.spark, self.logs)])
        return self.last

    def put(self, rows: DataFrame, day: str, order: list[str]) -> int:
        """Write rows (key, type, value and what orders them); the last sequence. They are in the log when this returns."""
        return self._logged(rows, day, order)

    def delete(self, keys: DataFrame) -> int:
        rows = keys.select("key").distinct().select("key", F.lit(DELETE).alias("type"), F.lit("").alias("value"), F.substring("key", 1, 7).alias("_head"))
        return self._logged(rows, "_head", ["key"])

    def pending(self) -> DataFrame:
        """Versions that no table holds yet."""
        if not wal.last_sequences(self.spark, self.logs):
            return self.spark.createDataFrame([], "key string, seq long, type int, value string")
        rows = wal.records(self.spark, self.logs, self.form).where(F.col("seq") > self.engine.manifest().high_water)
        return rows.select(F.col("key").cast("string").alias("key"), "seq", "type", F.col("value").cast("string").alias("value"))

    def flush(self) -> Manifest:
        """Make a table of what is pending, then drop it from the log; merge tables when that is due."""
        m = self.engine.append(self.pending())
        if self.engine.needs_compaction():
            m = self.engine.compact()
        return m

    def _flushed(self, seq: int) -> None:
        wal.discard_through(self.spark, self.logs, seq, self.form)

    # reading

    def log(self) -> DataFrame:
        return self.engine.log().unionByName(self.pending())

    def as_of(self, seq: int | None = None) -> DataFrame:
        m = self.engine.manifest()
        if seq is not None and seq < m.retained_from:
            raise LogError(f"versions before {m.retained_from} are gone")
        return mvcc.live(self.log(), self.last if seq is None else min(seq, self.last))

    def get(self, keys: DataFrame) -> DataFrame:
        return mvcc.get(self.log(), keys)

    def contains(self, keys: DataFrame) -> DataFrame:
        return mvcc.contains(self.log(), keys)

    def info(self) -> DataFrame:
        """The engine's row, with the last sequence and the log's bytes."""
        size = sum(self.engine._files.__class__(self.spark, self.logs).sizes().values())
        return self.engine.info().withColumns({"sequence": F.lit(self.last).cast("long"), "wal_bytes": F.lit(size).cast("long")})
