"""The engine's queries over the driver's tables, by name. Each takes (spark, sf_dir) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import bloom, naming, sizes
from ..operators import consensus, index, layout, metrics, mvcc, recovery, requests, retention
from ..sources.files import cut
from .leveled import Leveled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries, the same in the SQL of oracles.py.
AS_OF = 5000
FLUSHED = 3000
DURABLE = 4000
TARGET_KEY = "cust:5"
SEEK_ROWS = 20
ROTATE_BYTES = 20000
ROLL_BYTES = 20000
L1_BYTES = 20000
NODES = 4
PEERS = "1=node-a:7001, 2=node-b:7002,3=node-c:7003, bad, 4=node-d:x"
PODS = ["store-0", "store-2", "raft-kv-1"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _probe_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey")).alias("key"))


def _probe_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey")).alias("key"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.file_metadata(fx.event_files(spark, sf_dir), ("level", "file_no"))


def _number(log: DataFrame, parts: int, of: int) -> int:
    """A share of the greatest sequence: one number, as a reader would bring it."""
    return (log.agg(F.max("seq")).first()[0] or 0) * parts // of


@query
def mvcc_latest(spark, sf_dir):
    return mvcc.live(fx.event_log(spark, sf_dir))


@query
def mvcc_as_of(spark, sf_dir):
    return mvcc.live(fx.event_log(spark, sf_dir), AS_OF)


@query
def mvcc_three_state(spark, sf_dir):
    return mvcc.get(fx.event_log(spark, sf_dir), _probe_users(spark, sf_dir), AS_OF)


@query
def mvcc_history(spark, sf_dir):
    return mvcc.history(fx.event_log(spark, sf_dir))


@query
def mvcc_layered_read(spark, sf_dir):
    log = fx.event_log(spark, sf_dir)
    top = fx.high_water(log)
    whole = log.crossJoin(F.broadcast(top))
    parts = [whole.where("seq * 10 > mx * 8"), whole.where("seq * 10 > mx * 6 and seq * 10 <= mx * 8"), whole.where("seq * 10 <= mx * 6")]
    return mvcc.layered([p.drop("mx") for p in parts])


@query
def mvcc_live_count_size(spark, sf_dir):
    return mvcc.sizes(fx.event_log(spark, sf_dir))


@query
def mvcc_point_get(spark, sf_dir):
    return mvcc.get(fx.order_log(spark, sf_dir), _probe_customers(spark, sf_dir)).where("state = 'FOUND'").select("key", "value")


@query
def mvcc_contains(spark, sf_dir):
    return mvcc.contains(fx.order_log(spark, sf_dir), _probe_customers(spark, sf_dir))


@query
def mvcc_seek_scan(spark, sf_dir):
    return mvcc.seek(fx.order_log(spark, sf_dir), TARGET_KEY, SEEK_ROWS)


@query
def baseline_put_delete(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c)).alias("key")
    base = customers.select(name("cust:", "c_custkey"), F.col("c_mktsegment").alias("value"))
    puts = customers.where("c_custkey % 10 = 0").select(name("cust:", "c_custkey"), F.lit("updated").alias("value")).unionByName(fx.table(spark, sf_dir, "supplier").select(name("supp:", "s_suppkey"), F.lit("new").alias("value")))
    gone = customers.where("c_custkey % 7 = 0").select(name("cust:", "c_custkey")).unionByName(fx.table(spark, sf_dir, "nation").select(name("none:", "n_nationkey")))
    left, missing = mvcc.delete(mvcc.upsert(base, puts), gone)
    return left.withColumn("status", F.lit("OK")).unionByName(missing.select("key", F.lit(None).cast("string").alias("value"), F.lit("NotFound").alias("status")))


@query
def seq_assign(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("cust:"), F.col("o_custkey")).alias("key"), "o_orderdate", "o_orderkey")
    return mvcc.assign_sequences(rows, "o_orderdate", ["o_orderkey"], start=100).select("key", "o_orderkey", "seq")


@query
def duplicate_versions(spark, sf_dir):
    """(key, seq) pairs are checked where they do repeat: line numbers within orders."""
    log = fx.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("key"), F.col("l_linenumber").cast("long").alias("seq"))
    return mvcc.duplicate_versions(log)


@query
def replay_overwrite(spark, sf_dir):
    """Line numbers repeat within orders; their return flag stands for the order of arrival."""
    log = fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey")).alias("key"), F.col("l_linenumber").cast("long").alias("seq"), F.lit(1).alias("type"), F.col("l_returnflag").alias("value"), F.col("l_returnflag").alias("arrival")
    )
    return mvcc.replayed(log, "arrival")


@query
def snapshot_floor(spark, sf_dir):
    log = fx.event_log(spark, sf_dir)
    return mvcc.snapshot_floor(log, log.where("seq % 1000 = 777").select("seq"))


@query
def diff_between_snapshots(spark, sf_dir):
    log = fx.event_log(spark, sf_dir)
    return mvcc.diff(log, _number(log, 1, 3), _number(log, 2, 3))


@query
def compact_full(spark, sf_dir):
    log = fx.event_log(spark, sf_dir)
    return retention.compact(log, _number(log, 9, 10))


@query
def compact_leveled(spark, sf_dir):
    """Level 0 is merged while level 1 still lies below: floor tombstones stay where a level-1 file may hold the key."""
    files = fx.event_files(spark, sf_dir)
    log = fx.event_log(spark, sf_dir)
    deeper = layout.file_metadata(files.where("level = 1 and file_no % 2 = 0"))
    return retention.compact(files.where("level = 0").select("key", "seq", "type", "value"), _number(log, 9, 10), deeper)


@query
def leveled_cycle(spark, sf_dir):
    """Files of the store after one leveled compaction: level, min_key, max_key, entries, bytes."""
    store = Leveled(l1_bytes=L1_BYTES, target=ROLL_BYTES)
    after = store.step(fx.event_files(spark, sf_dir), _number(fx.event_log(spark, sf_dir), 9, 10))
    return layout.file_metadata(after, ("level", "file_no")).select("level", "min_key", "max_key", F.col("entry_count").alias("entries"), F.col("data_bytes").alias("bytes"))


@query
def compaction_stats(spark, sf_dir):
    log = fx.event_log(spark, sf_dir)
    twice = log.unionByName(log.where("seq % 5 = 0"))
    return retention.stats(twice, _number(log, 9, 10))


@query
def file_metadata(spark, sf_dir):
    return _files(spark, sf_dir).drop("level")


@query
def level_scores(spark, sf_dir):
    return layout.level_scores(_files(spark, sf_dir), "data_bytes", l1_bytes=L1_BYTES)


@query
def picker(spark, sf_dir):
    return layout.pick(_files(spark, sf_dir), {1: "user:2"}, "data_bytes", l1_bytes=L1_BYTES)


@query
def picker_round_robin(spark, sf_dir):
    """With no file on level 0 the score of level 1 decides, and the pointer its file."""
    return layout.pick(_files(spark, sf_dir).where("level = 1"), {1: "user:2"}, "data_bytes", l1_bytes=2000)


@query
def file_overlap(spark, sf_dir):
    files = _files(spark, sf_dir)
    return layout.overlapping(files.where("level = 0"), files.where("level = 1"))


@query
def level_disjoint_check(spark, sf_dir):
    files = _files(spark, sf_dir)
    return layout.disjoint_violations(files.withColumn("level", F.when(F.col("level") == 0, 2).otherwise(1)))


@query
def manifest_reconcile(spark, sf_dir):
    files = _files(spark, sf_dir).select("file_no")
    listed = files.where("file_no % 5 <> 0")
    return layout.reconcile(listed.unionByName(listed.where("file_no % 11 = 0")), files.where("file_no % 7 <> 0"))


@query
def version_edit(spark, sf_dir):
    files = _files(spark, sf_dir).select("file_no", "level")
    return layout.edit(files.where("file_no % 2 = 0"), files.where("file_no % 4 = 0"), files.where("file_no % 2 = 1 and level = 1"))


@query
def key_prune_candidates(spark, sf_dir):
    return layout.probed(_probe_users(spark, sf_dir), cut(_files(spark, sf_dir)))


@query
def memtable_rotation(spark, sf_dir):
    return layout.rotate(fx.event_log(spark, sf_dir), ROTATE_BYTES)


@query
def output_rolling(spark, sf_dir):
    return layout.roll(fx.event_log(spark, sf_dir), ROLL_BYTES)


@query
def record_layout(spark, sf_dir):
    return layout.record_layout(fx.event_files(spark, sf_dir))


@query
def sparse_index_build(spark, sf_dir):
    return index.build(fx.event_files(spark, sf_dir))


@query
def sparse_index_lookup(spark, sf_dir):
    """Keys meet the blocks of the files whose range may hold them."""
    return index.searched(_probe_users(spark, sf_dir), cut(_files(spark, sf_dir)), cut(index.build(fx.event_files(spark, sf_dir))))


@query
def sparse_index_bytes(spark, sf_dir):
    files = fx.event_files(spark, sf_dir)
    return sizes.sparse_index_size(index.build(files), layout.file_metadata(files))


@query
def bloom_probe(spark, sf_dir):
    """Keys meet the filters of the files whose range may hold them."""
    return index.filtered(_probe_users(spark, sf_dir), cut(_files(spark, sf_dir)), cut(bloom.build(fx.event_files(spark, sf_dir))))


@query
def bloom_sizes(spark, sf_dir):
    rows = layout.file_metadata(fx.event_files(spark, sf_dir)).withColumn("bits", bloom.bit_count(F.col("entry_count")))
    return rows.select("file_no", "bits", bloom.serialized_size(F.col("bits")).alias("bytes"))


@query
def crc32_digest(spark, sf_dir):
    return sizes.file_digests(fx.event_files(spark, sf_dir))


@query
def table_file_sizes(spark, sf_dir):
    meta = layout.file_metadata(fx.event_files(spark, sf_dir), ("level", "file_no"))
    return meta.select("file_no", naming.level_name(F.col("level"), F.col("file_no")).alias("name"), sizes.aligned(F.col("data_bytes")).alias("padded"))


@query
def wal_frame_sizes(spark, sf_dir):
    return recovery.frame_offsets(fx.framed_log(spark, sf_dir))


@query
def wal_valid_prefix(spark, sf_dir):
    return recovery.valid_prefix(fx.framed_log(spark, sf_dir))


@query
def wal_monotony(spark, sf_dir):
    """Sequences must rise in arrival order: the prefix of a shuffled log ends early."""
    log = fx.deliveries(spark, sf_dir).select(F.col("idx").alias("seq"), "arrival", F.lit(True).alias("valid"), F.lit(1).cast("long").alias("frame_len"))
    return recovery.valid_prefix(log, "arrival").drop("last_seq")


@query
def recovery_replay(spark, sf_dir):
    return recovery.recovery_stats(fx.framed_log(spark, sf_dir).withColumn("valid", F.col("seq") % 9770 != 0), FLUSHED)


@query
def wal_checkpoint(spark, sf_dir):
    return recovery.checkpoint(fx.event_log(spark, sf_dir), FLUSHED)


@query
def sequence_high_water(spark, sf_dir):
    return recovery.sequence_high_water(_files(spark, sf_dir).where("level = 1"), fx.event_log(spark, sf_dir).where("seq % 2 = 0"), 17)


@query
def raft_log_match(spark, sf_dir):
    return consensus.log_match(fx.raft_logs(spark, sf_dir))


@query
def raft_conflict_hint(spark, sf_dir):
    return consensus.conflict_hint(fx.raft_logs(spark, sf_dir))


@query
def raft_suffix_replace(spark, sf_dir):
    return consensus.replace_suffix(fx.raft_logs(spark, sf_dir), 3).select("idx", "term", "key")


@query
def raft_commit_index(spark, sf_dir):
    logs = fx.raft_logs(spark, sf_dir)
    # the lagging node has caught up here, so that three of four hold the current term's entries
    return consensus.commit_index(logs.where("node <> 2").unionByName(logs.where("node = 1").withColumn("node", F.lit(2))), NODES)


@query
def raft_commit_stale(spark, sf_dir):
    """Without a quorum on an entry of the current term nothing commits."""
    return consensus.commit_index(fx.raft_logs(spark, sf_dir), NODES)


@query
def raft_apply(spark, sf_dir):
    log = fx.raft_logs(spark, sf_dir).where("node = 0")
    return consensus.applied(log, AS_OF)


@query
def raft_apply_outcomes(spark, sf_dir):
    log = fx.raft_logs(spark, sf_dir).where("node = 0")
    return consensus.apply_outcomes(log, AS_OF, done=1000)


@query
def raft_vote_tally(spark, sf_dir):
    votes = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("candidate"), F.floor(F.col("event_id") / 50).alias("term"), (F.col("event_id") % 7).alias("voter"), (F.col("value") > 100).alias("granted"))
    return consensus.vote_tally(votes, spark.range(5).toDF("voter"), 5)


@query
def ordered_apply_delay(spark, sf_dir):
    return consensus.apply_delay(fx.deliveries(spark, sf_dir))


@query
def ordered_apply_next(spark, sf_dir):
    """Only what had come by half of the deliveries."""
    d = fx.deliveries(spark, sf_dir)
    half = F.broadcast(d.agg(F.max("idx").alias("n")))
    return consensus.contiguous_prefix(d.crossJoin(half).where("arrival * 2 < n"))


@query
def durable_reconcile(spark, sf_dir):
    return consensus.durable_reconcile(fx.raft_logs(spark, sf_dir).where("node = 0"), DURABLE)


@query
def peer_state_timeline(spark, sf_dir):
    return consensus.peer_states(fx.operations(spark, sf_dir))


@query
def op_counters(spark, sf_dir):
    return metrics.counters(fx.operations(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    return metrics.histogram(fx.operations(spark, sf_dir))


@query
def latency_summary(spark, sf_dir):
    return metrics.summary(fx.operations(spark, sf_dir))


@query
def latency_p99(spark, sf_dir):
    return metrics.nearest_rank(fx.operations(spark, sf_dir))


@query
def latency_median(spark, sf_dir):
    return metrics.median(fx.operations(spark, sf_dir), "latency_us", "op")


@query
def throughput(spark, sf_dir):
    return metrics.throughput(fx.operations(spark, sf_dir))


@query
def prometheus_lines(spark, sf_dir):
    from ..sources import prometheus

    return prometheus.lines(fx.operations(spark, sf_dir))


@query
def activity_feed(spark, sf_dir):
    return metrics.feed(fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))


@query
def validate_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 3 == 0, "DELETE").when(k % 3 == 1, "PUT").otherwise("GET").alias("op"),
        F.when(k % 50 == 0, "").when(k % 50 == 1, F.repeat(F.lit("k"), 1025)).otherwise(F.concat(F.lit("cust:"), F.col("o_custkey"))).alias("key"),
        F.when(k % 1000 == 4, F.repeat(F.lit("v"), 1048577)).otherwise(F.col("o_orderpriority")).alias("value"),
        F.when(k % 50 == 3, F.repeat(F.lit("r"), 129)).otherwise("r").alias("request_id"),
    )
    return requests.validated(rows, requests.request_message()).select("id", "code", "message")


@query
def validate_commands(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(k.alias("id"), (k % 5).cast("int").alias("cmd"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("cust:"), F.col("o_custkey"))).alias("key"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("value"), F.lit("").alias("request_id"))
    return requests.validated(rows, requests.command_message()).select("id", "code", "message")


@query
def parse_peers(spark, sf_dir):
    return naming.parse_peers(naming.literal_rows(spark, [PEERS]), "text")


@query
def pod_identity(spark, sf_dir):
    return naming.pod_identity(naming.literal_rows(spark, PODS), "text", 3, "kv", "default", "svc.cluster.local", 7000)


@query
def parse_table_names(spark, sf_dir):
    names = _files(spark, sf_dir).select(naming.level_name(F.col("level"), F.col("file_no")).alias("name")).unionByName(naming.literal_rows(spark, ["000012.sst", "L1-7.tmp", "notes"], "name"))
    return names.select("name", naming.parse_level_name(F.col("name")).alias("p")).select("name", "p.level", "p.number")
