"""Logs at restart: the longest valid prefix, monotony, replay and checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def frame_offsets(log: DataFrame) -> DataFrame:
    """seq, offset, frame_len: frames laid end to end."""
    return running(log.select("seq", "frame_len"), "seq", inclusive=False, offset=("sum", F.col("frame_len"))).select("seq", "offset", "frame_len")


def first_bad(log: DataFrame, order: str = "seq") -> DataFrame:
    """One row, bad: the first place whose frame is damaged or whose sequence does not exceed all before; null if none."""
    broken = F.lit(False)
    if order != "seq":
        log = running(log, order, inclusive=False, _top=("max", F.col("seq")))
        broken = F.coalesce(F.col("seq") <= F.col("_top"), F.lit(False))
    return log.where(~F.col("valid") | broken).agg(F.min(order).alias("bad"))


def valid_prefix(log: DataFrame, order: str = "seq", damaged_tail: str = "corrupt") -> DataFrame:
    """status, records, valid_bytes, last_seq of the longest valid prefix. A damaged frame ends it: CORRUPT, or TORN_TAIL
    where damage at the very end counts as a torn write (damaged_tail='torn')."""
    ends = first_bad(log, order).crossJoin(log.agg(F.max(order).alias("end")))
    rows = log.crossJoin(F.broadcast(ends))
    inside = F.col("bad").isNull() | (F.col(order) < F.col("bad"))
    torn = (F.max("bad") == F.max("end")) & F.lit(damaged_tail == "torn")
    status = F.when(F.max("bad").isNull(), "OK").when(torn, "TORN_TAIL").otherwise("CORRUPT")
    return rows.agg(status.alias("status"), F.count_if(inside).alias("records"), F.coalesce(F.sum(F.when(inside, F.col("frame_len"))), F.lit(0)).cast("long").alias("valid_bytes"), F.max(F.when(inside, F.col("seq"))).alias("last_seq"))


def prefix(log: DataFrame, order: str = "seq") -> DataFrame:
    """The records of the longest valid prefix."""
    bad = F.broadcast(first_bad(log, order))
    return log.crossJoin(bad).where(F.col("bad").isNull() | (F.col(order) < F.col("bad"))).drop("bad")


def replay(log: DataFrame, flushed: int = 0) -> DataFrame:
    """Records to apply after the tables have been opened: those over the flushed sequence, at their own sequences."""
    return log.where(F.col("seq") > flushed)


def recovery_stats(log: DataFrame, flushed: int = 0) -> DataFrame:
    """records_read, skipped, applied, last_sequence over the valid prefix."""
    old = F.col("seq") <= flushed
    return prefix(log).agg(F.count("*").alias("records_read"), F.count_if(old).alias("skipped"), F.count_if(~old).alias("applied"), F.greatest(F.coalesce(F.max("seq"), F.lit(0)), F.lit(flushed)).cast("long").alias("last_sequence"))


def checkpoint(log: DataFrame, seq: int) -> DataFrame:
    """The log without what the tables hold already."""
    return log.where(F.col("seq") > seq)


def sequence_high_water(tables: DataFrame, log: DataFrame, recorded: int = 0) -> DataFrame:
    """One row, high: sequences are never used again, even where compaction took the newest entry."""
    top = tables.agg(F.max("max_seq").alias("t")).crossJoin(log.agg(F.max("seq").alias("l")))
    return top.select(F.greatest(F.coalesce("t", F.lit(0)), F.coalesce("l", F.lit(0)), F.lit(recorded)).cast("long").alias("high"))
