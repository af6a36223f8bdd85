"""What compaction keeps: versions above the floor, the newest at or under it, and floor tombstones only while something
deeper may hold the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE
from .mvcc import byte_size, resolve
from .running import predecessors


def covered(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct keys (strings) inside at least one file's range. Overlapping ranges are merged first; a key then needs the
    last range that begins at or before it."""
    order = Window.orderBy("min_key", "max_key").rowsBetween(Window.unboundedPreceding, -1)
    # file metadata: a row a file
    islands = files.select("min_key", "max_key").withColumn("_top", F.max("max_key").over(order)).withColumn("_new", (F.col("_top").isNull() | (F.col("min_key") > F.col("_top"))).cast("int"))
    islands = islands.withColumn("_no", F.sum("_new").over(Window.orderBy("min_key", "max_key"))).groupBy("_no").agg(F.min("min_key").alias("key"), F.max("max_key").alias("max_key"))
    return predecessors(keys, islands, "key", ["max_key"]).where("_mark.max_key >= key").drop("_mark")


def compact(log: DataFrame, floor: int | Column, deeper: DataFrame | None = None) -> DataFrame:
    """What is kept of log, one row a (key, seq). Versions above the floor pass as they are; of those at or under it only
    the newest of each key is aggregated, with partial maxima, so no key's versions meet in one task. deeper: (min_key,
    max_key) of files below the output; None: nothing is below, so floor tombstones go."""
    above = log.where(F.col("seq") > floor).dropDuplicates(["key", "seq"]).select("key", "seq", "type", "value")
    newest = resolve(log, floor)
    out = above.unionByName(newest.where(F.col("type") != DELETE))
    if deeper is None:
        return out
    graves = newest.where(F.col("type") == DELETE)
    return out.unionByName(graves.join(covered(graves.select("key"), deeper), "key", "left_semi").select(out.columns))


def stats(log: DataFrame, floor: int | Column, deeper: DataFrame | None = None) -> DataFrame:
    """entries_in, entries_out, entries_dropped, bytes_in, bytes_out; repeated versions count as dropped."""
    size = byte_size("key", "value") + 17
    took = log.agg(F.count("*").alias("entries_in"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_in"))
    left = compact(log, floor, deeper).agg(F.count("*").alias("entries_out"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_out"))
    return took.crossJoin(left).select("entries_in", "entries_out", (F.col("entries_in") - F.col("entries_out")).alias("entries_dropped"), "bytes_in", "bytes_out")
