"""Visibility: the newest version of each key at a sequence, and what reads, scans and writes follow from it.

`log` is a frame of (key, seq, type, value). The newest version is one aggregate with partial maxima, so a key with
any number of versions sends one row from each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, PUT
from .running import numbered

#: Arrivals of a block.
ARRIVALS = 1 << 16


def resolve(log: DataFrame, at: int | Column | None = None) -> DataFrame:
    """The newest version with seq <= at of each key, tombstones included: key, seq, type, value."""
    seen = log if at is None else log.where(F.col("seq") <= at)
    return seen.groupBy("key").agg(F.max(F.struct("seq", "type", "value")).alias("v")).select("key", "v.seq", "v.type", "v.value")


def live(log: DataFrame, at: int | Column | None = None) -> DataFrame:
    """Values that a reader at `at` sees: key, seq, value."""
    return resolve(log, at).where(F.col("type") == PUT).select("key", "seq", "value")


def state(kind: Column) -> Column:
    return F.when(kind == PUT, "FOUND").when(kind == DELETE, "DELETED").otherwise("NOT_FOUND")


def get(log: DataFrame, keys: DataFrame, at: int | Column | None = None) -> DataFrame:
    """key, state, seq, value of every probe; only versions of probed keys are aggregated."""
    probes = keys.select("key").distinct()
    found = resolve(log.join(probes, "key", "left_semi"), at)
    return probes.join(found, "key", "left").select("key", state(F.col("type")).alias("state"), "seq", F.when(F.col("type") == PUT, F.col("value")).alias("value"))


def contains(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found; an empty key is never found."""
    got = get(log, keys)
    return got.select("key", ((F.col("state") == "FOUND") & (F.col("key") != "")).alias("found"))


def history(log: DataFrame) -> DataFrame:
    """All versions with the sequence that followed each (null: newest)."""
    return log.select("key", "seq", "type", "value", F.lead("seq").over(Window.partitionBy("key").orderBy("seq")).alias("next_seq"))


def seek(log: DataFrame, target: str, n: int, at: int | None = None) -> DataFrame:
    """The first n live keys at or after target, in byte order; the bound reaches the scan before versions are resolved."""
    return live(log.where(F.col("key") >= target), at).orderBy("key").limit(n)


def ordered(log: DataFrame) -> DataFrame:
    """Canonical order: key ascending bytewise, newest version first."""
    return log.orderBy("key", F.desc("seq"))


def layered(layers: list[DataFrame]) -> DataFrame:
    """Layers from the newest: the first that holds a key decides, by its newest version; live keys with their layer."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)])
    best = tagged.groupBy("key").agg(F.max(F.struct(-F.col("layer"), "seq", "type", "value", "layer")).alias("v"))
    return best.where(F.col("v.type") == PUT).select("key", "v.seq", "v.value", "v.layer")


def byte_size(*columns: str) -> Column:
    return reduce(lambda a, b: a + b, [F.octet_length(c) for c in columns]).cast("long")


def sizes(log: DataFrame) -> DataFrame:
    """live_keys, bytes (of live keys and values), mem_bytes (of all versions, 9 bytes over each)."""
    shown = live(log).agg(F.count("*").alias("live_keys"), F.coalesce(F.sum(byte_size("key", "value")), F.lit(0)).alias("bytes"))
    return shown.crossJoin(log.agg(F.coalesce(F.sum(byte_size("key", "value") + 9), F.lit(0)).alias("mem_bytes")))


def snapshot_floor(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The least sequence that a reader may still ask for: the oldest snapshot, or the newest version."""
    return log.agg(F.max("seq").alias("last")).crossJoin(snapshots.agg(F.min("seq").alias("oldest"))).select(F.coalesce(F.least("oldest", "last"), F.lit(0)).alias("floor_seq"))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """key, change, old_value, new_value between two snapshots. One pass: both newest versions come from one aggregate."""
    v = F.struct("seq", "type", "value")
    both = log.where(F.col("seq") <= new).groupBy("key").agg(F.max(F.when(F.col("seq") <= old, v)).alias("o"), F.max(v).alias("n"))
    before, after = F.when(F.col("o.type") == PUT, F.col("o.value")), F.when(F.col("n.type") == PUT, F.col("n.value"))
    rows = both.select("key", before.alias("old_value"), after.alias("new_value"))
    change = F.when(F.col("old_value").isNull(), "ADDED").when(F.col("new_value").isNull(), "REMOVED").otherwise("CHANGED")
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("key", change.alias("change"), "old_value", "new_value")


def assign_sequences(rows: DataFrame, day: str, order: list, start: int = 0, name: str = "seq") -> DataFrame:
    """Consecutive sequences from start + 1 in arrival order; `day` is a coarse prefix of that order."""
    return numbered(rows, [day], order, "_no").withColumn(name, F.col("_no") + start).drop("_no")


def duplicate_versions(log: DataFrame) -> DataFrame:
    """(key, seq, n) of versions written more than once."""
    return log.groupBy("key", "seq").agg(F.count("*").alias("n")).where("n > 1")


def falling(log: DataFrame, arrival: str) -> DataFrame:
    """(key, seq, arrival) of versions that do not rise over all that came before them for their key: a memtable refuses
    them. Blocks of the arrival order are folded first, so a key with any number of versions is not swept in one task."""
    dealt = log.select("key", "seq", F.col(arrival).alias("arrival"), F.floor(F.col(arrival) / ARRIVALS).alias("_block"))
    tops = dealt.groupBy("key", "_block").agg(F.max("seq").alias("_t"))
    before = tops.select("key", "_block", F.max("_t").over(Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = Window.partitionBy("key", "_block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest(F.max("seq").over(inner), F.col("_before"))
    return dealt.join(before, ["key", "_block"]).withColumn("_top", top).where("seq <= _top").select("key", "seq", "arrival")


def canonical_places(log: DataFrame) -> DataFrame:
    """key, seq, place (from 1) in canonical order."""
    return numbered(log.select("key", "seq", F.substring("key", 1, 7).alias("_head")), ["_head"], ["key", F.desc("seq")], "place").select("key", "seq", "place")


def replayed(log: DataFrame, arrival: str) -> DataFrame:
    """Versions at caller-given sequences: the last arrival of a (key, seq) stays."""
    last = log.groupBy("key", "seq").agg(F.max(F.struct(arrival, "type", "value")).alias("v"))
    return last.select("key", "seq", "v.type", "v.value")


# The map without history


def upsert(base: DataFrame, puts: DataFrame) -> DataFrame:
    return base.join(puts.select("key"), "key", "left_anti").unionByName(puts)


def delete(base: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and the keys that were not there."""
    gone = keys.select("key").distinct()
    return base.join(gone, "key", "left_anti"), gone.join(base.select("key"), "key", "left_anti")


def clear(base: DataFrame) -> DataFrame:
    return base.limit(0)
