"""Connected components of links, by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut


def _least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with m, the least of u and its neighbours. Partial minima go into the shuffle, so a hub costs
    its edges once; the join back is split by adaptive execution where a hub is hot."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of links (a, b); component is the least id that can be reached. Rounds go on until
    nothing changes, about as many as the logarithm of the longest path squared; each replaces the table of the last."""
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "0")
        before, k = None, 0
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small = _least(large)
            k += 1
            edges = scratch.keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), str(k))
            scratch.drop(str(k - 1))
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        roots = edges.select(F.col("v").alias("id")).distinct()
        return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))))
