"""Metrics in Prometheus text form, a row a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def lines(ops: DataFrame) -> DataFrame:
    """line: counters, errors, histogram buckets, sums and counts by operation."""
    label = lambda c: F.concat(F.lit('{op="'), F.col(c), F.lit('"}'))
    line = lambda name, labels, value: F.concat(F.lit(name), labels, F.lit(" "), F.col(value).cast("string")).alias("line")
    n = metrics.counters(ops)
    h = metrics.histogram(ops)
    s = metrics.summary(ops)
    bucket = F.concat(F.lit('{op="'), F.col("op"), F.lit('",le="'), F.col("le"), F.lit('"}'))
    return (
        n.select(line("kv_operations_total", label("op"), "total"))
        .unionByName(n.select(line("kv_operation_errors_total", label("op"), "errors")))
        .unionByName(h.select(line("kv_operation_latency_us_bucket", bucket, "bucket_count")))
        .unionByName(s.select(line("kv_operation_latency_us_sum", label("op"), "sum_us")))
        .unionByName(s.select(line("kv_operation_latency_us_count", label("op"), "n")))
    )
