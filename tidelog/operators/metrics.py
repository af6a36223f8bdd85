"""Operational metrics: counters, cumulative histograms, nearest-rank percentiles, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the latency histogram in microseconds.
BOUNDS = [10, 50, 100, 500, 1000, 5000, 10000]


def counters(ops: DataFrame) -> DataFrame:
    """op, total, errors; a read that found nothing counts as an error where its row says so."""
    return ops.groupBy("op").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"))


def histogram(ops: DataFrame, bounds: list[int] = BOUNDS) -> DataFrame:
    """op, le, bucket_count: cumulative counts by bound, then +Inf. One aggregate, one row out for each bound."""
    sums = ops.groupBy("op").agg(*[F.count_if(F.col("latency_us") <= b).alias(f"b{b}") for b in bounds], F.count("latency_us").alias("all"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("bucket_count")) for b in bounds], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("bucket_count")))
    return sums.select("op", F.inline(rows))


def summary(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.sum("latency_us").alias("sum_us"))


def nearest_rank(ops: DataFrame, percent: int = 99) -> DataFrame:
    """op, n, p99: the value at rank ceil(percent * n / 100). Values are counted first, so sorting sees distinct values
    only, however many operations there are."""
    values = ops.groupBy("op", "latency_us").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("op").orderBy("latency_us").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy("op"))})
    rank = F.floor((F.col("n") * percent + 99) / 100)
    return rows.where(F.col("upto") >= rank).groupBy("op").agg(F.max("n").alias("n"), F.min("latency_us").alias(f"p{percent}"))


def throughput(ops: DataFrame) -> DataFrame:
    """op, n, ops_per_s over the time spent in the operations."""
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.sum("latency_us").alias("us")).select("op", "n", F.round(F.col("n") * F.lit(1000000.0) / F.col("us"), 6).alias("ops_per_s"))


def median(runs: DataFrame, value: str, by: str) -> DataFrame:
    """The middle of an odd number of runs, by nearest rank."""
    return runs.groupBy(by).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"))


def feed(events: DataFrame, n: int = 150) -> DataFrame:
    """The newest n events; each task keeps n rows, and those meet."""
    return events.orderBy(F.desc("event_id")).limit(n)
