"""Leveled compaction of a whole store: pick, merge, retain, roll, publish; repeated while a level is over its budget.

`entries` is a frame of (level, file_no, key, seq, type, value). The plan (which files) is made on file metadata; the
merge is one pass over the chosen files' entries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, retention
from ..operators.running import predecessors
from ..sources.files import shared_dir


@dataclass
class Leveled:
    """A store's options and the round-robin pointers of its levels."""

    l1_bytes: int = layout.L1_BYTES
    multiplier: int = layout.MULTIPLIER
    trigger: int = layout.L0_TRIGGER
    target: int = layout.TARGET_BYTES
    pointers: dict[int, str] = field(default_factory=dict)

    def step(self, entries: DataFrame, floor: int) -> DataFrame | None:
        """The store after one compaction, or None if every level is within its budget."""
        files = layout.file_metadata(entries, ("level", "file_no"))
        picked = layout.pick(files, self.pointers, "data_bytes", trigger=self.trigger, l1_bytes=self.l1_bytes, multiplier=self.multiplier)
        # file metadata of one compaction: a few rows
        chosen = picked.join(files, ["level", "file_no"]).select("level", "file_no", "role", "max_key").collect()
        if not chosen:
            return None
        source = min(r["level"] for r in chosen if r["role"] == "input")
        if source:
            self.pointers[source] = max(r["max_key"] for r in chosen if r["role"] == "input")
        ids = entries.sparkSession.createDataFrame([(r["level"], r["file_no"]) for r in chosen], "level int, file_no long")
        inputs = entries.join(F.broadcast(ids), ["level", "file_no"], "left_semi").select("key", "seq", "type", "value")
        rest = entries.join(F.broadcast(ids), ["level", "file_no"], "left_anti")
        deeper = files.where(F.col("level") > source + 1)
        kept = retention.compact(inputs, floor, deeper)
        top = entries.agg(F.max("file_no").alias("top"))
        return rest.select("level", "file_no", "key", "seq", "type", "value").unionByName(self._rolled(kept, source + 1, top))

    def _rolled(self, kept: DataFrame, level: int, top: DataFrame) -> DataFrame:
        """kept as files of the level; a key's file is the last boundary at or under it, so no key is cut."""
        bounds = layout.roll(kept, self.target).select(F.col("min_key").alias("key"), "file_no")
        hit = predecessors(kept, bounds, "key", ["file_no"])
        return hit.crossJoin(F.broadcast(top)).select(F.lit(level).alias("level"), (F.col("_mark.file_no") + F.coalesce("top", F.lit(0))).alias("file_no"), "key", "seq", "type", "value")

    def settle(self, entries: DataFrame, floor: int) -> DataFrame:
        """Steps until no level is over its budget, each cut by a reliable checkpoint. Every step moves a file of one level
        into the next, and nothing moves up, so they come to an end."""
        shared_dir(entries.sparkSession)
        while (after := self.step(entries, floor)) is not None:
            entries = after.checkpoint()
        return entries
