"""Change logs derived from the driver's tables; the same definitions stand in plans/oracles.py as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import DELETE, NOOP, PUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version for each event, by user; every seventh is a tombstone."""
    seq = F.col("event_id") + 1
    gone = seq % 7 == 0
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"), seq.alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("type"), F.when(gone, "").otherwise(F.col("event_type")).alias("value")
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version for each order, by customer; status P deletes."""
    gone = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust:"), F.col("o_custkey")).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("type"), F.when(gone, "").otherwise(F.col("o_orderstatus")).alias("value")
    )


def high_water(log: DataFrame) -> DataFrame:
    """One row: mx, the greatest sequence."""
    return log.agg(F.max("seq").alias("mx"))


def event_files(spark: SparkSession, sf_dir: str, ranges: int = 8) -> DataFrame:
    """The event log as files: level 0 holds the newer half by hundreds of sequences, level 1 the older half in disjoint
    key ranges of equal numbers of keys."""
    from .operators.running import ntile_keys

    log = event_log(spark, sf_dir)
    mid = F.broadcast(high_water(log).select(F.floor(F.col("mx") / 2).cast("long").alias("mid")))
    both = log.crossJoin(mid)
    newer = both.where("seq > mid").select(F.lit(0).alias("level"), (F.floor((F.col("seq") - 1) / 100) + 1).cast("long").alias("file_no"), "key", "seq", "type", "value")
    tiles = ntile_keys(log.select("key").distinct(), "key", ranges, "b")
    older = both.where("seq <= mid").join(tiles, "key").select(F.lit(1).alias("level"), (F.lit(100000) + F.col("b")).cast("long").alias("file_no"), "key", "seq", "type", "value")
    return newer.unionByName(older)


def raft_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of four nodes: 0 leads, 1 has caught up, 2 lags at 80 %, 3 has a stale term from 60 % and ends at 90 %."""
    log = event_log(spark, sf_dir)
    first = (F.col("seq") - 1) % 100 == 0
    lead = log.select(
        F.col("seq").alias("idx"), (F.floor((F.col("seq") - 1) / 100) + 1).cast("long").alias("term"), F.when(first, NOOP).otherwise(F.col("type")).alias("cmd"), F.when(first, "").otherwise(F.col("key")).alias("key"), F.when(first, "").otherwise(F.col("value")).alias("value")
    ).crossJoin(F.broadcast(high_water(log)))
    stale = F.floor((F.floor(F.col("mx") * 6 / 10) - 1) / 100).cast("long") + 1
    node = lambda n, df: df.select(F.lit(n).alias("node"), "idx", "term", "cmd", "key", "value")
    third = lead.where("idx * 10 <= mx * 9").withColumn("term", F.when(F.col("idx") * 10 > F.col("mx") * 6, stale).otherwise(F.col("term")))
    return node(0, lead).unionByName(node(1, lead)).unionByName(node(2, lead.where("idx * 10 <= mx * 8"))).unionByName(node(3, third))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries delivered out of order: idx, and arrival as a permutation."""
    events = table(spark, sf_dir, "events").select("event_id")
    n = F.broadcast(events.agg(F.count("*").alias("n")))
    return events.crossJoin(n).select((F.col("event_id") + 1).alias("idx"), ((F.col("event_id") * 7919) % F.col("n")).alias("arrival"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed operations and pings."""
    kind = F.when(F.col("event_type").isin("view", "click"), "GET").when(F.col("event_type").isin("purchase", "signup"), "PUT").otherwise("DELETE")
    return table(spark, sf_dir, "events").select(
        "event_id", kind.alias("op"), (F.col("event_id") % 11 != 0).alias("ok"), F.floor(F.col("value") * 30).cast("long").alias("latency_us"), (F.col("user_id") % 5).alias("peer"), (F.col("event_type") != "error").alias("ping_ok")
    )


def framed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as frames, the first damaged at the first sequence that 977 divides."""
    log = event_log(spark, sf_dir)
    return log.select("seq", "type", "key", "value", (F.lit(33) + F.octet_length("key") + F.octet_length("value")).cast("long").alias("frame_len"), (F.col("seq") % 977 != 0).alias("valid"))
