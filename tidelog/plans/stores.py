"""Queries over stores, logs and tables that are written for them and read back, and over codecs and small texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import bloom, codec, naming, sizes
from ..operators import consensus, index, layout, mvcc
from ..schema import DELETE, PUT
from ..sources import config, raft_state, sstable, wal
from ..sources.catalog import Engine
from ..sources.files import Folder, Workspace
from ..sources.node import Node
from .queries import FLUSHED, L1_BYTES, PEERS, Query, _files, _number
from .single import SingleNode

QUERIES: dict[str, Query] = {}

# Parameters, the same in the SQL.
PARTS = 4
COMMITTED = 4000
SETTINGS = ["# node", "id = n7", "sync=off", "unknown=1", "client_port=7", "; end"]
ANSWERS = ["RAFT role=leader term=3", "SELF id=1 address=a:7001", "PEER id=2 address=b:7002", "VALUE=x y", "REDIRECT id=2 address=b:7002", "noise"]
TRUTHS = ["true", " YES ", "on", "1", "False", "0", "off", "No", "maybe", ""]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _parts(spark: SparkSession, sf_dir: str, engine: Engine) -> None:
    """The event log flushed in PARTS ranges of sequences."""
    log = fx.event_log(spark, sf_dir)
    top = _number(log, 1, 1)
    for k in range(PARTS):
        engine.append(log.where((F.col("seq") > top * k // PARTS) & (F.col("seq") <= top * (k + 1) // PARTS)))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query
def engine_flush_scan(spark, sf_dir):
    """Live versions of a store after several flushes."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        return w.kept(engine.as_of())


@query
def engine_read_clamp(spark, sf_dir):
    """A read far in the future is a read of the present."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        return w.kept(engine.as_of(1 << 60))


@query
def engine_snapshot_read(spark, sf_dir):
    """What a pinned reader sees after a compaction."""
    log = fx.event_log(spark, sf_dir)
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        engine.append(log.where(F.col("seq") <= FLUSHED))
        pinned = engine.snapshot()
        engine.append(log.where(F.col("seq") > FLUSHED))
        engine.compact()
        return w.kept(engine.as_of(pinned))


@query
def engine_old_version(spark, sf_dir):
    """What a reader of the version before a compaction sees after it."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        before = engine.manifest().version
        engine.compact()
        engine.vacuum(versions=2)
        return w.kept(engine.log(before))


@query
def engine_write_delete(spark, sf_dir):
    """All versions after puts in order of region and number, and tombstones for every third nation and for a key that was
    never there."""
    nations = fx.table(spark, sf_dir, "nation")
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        engine.put(nations.select(F.col("n_name").alias("key"), F.lit(PUT).alias("type"), F.col("n_regionkey").cast("string").alias("value"), "n_regionkey", "n_nationkey"), "n_regionkey", ["n_nationkey"])
        engine.delete(nations.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key")).unionByName(naming.literal_rows(spark, ["nowhere"], "key")))
        return w.kept(engine.log())


@query
def engine_get(spark, sf_dir):
    """State of every customer's key in a compacted store with later flushes."""
    keys = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey")).alias("key"))
    log = fx.event_log(spark, sf_dir)
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        engine.append(log.where(F.col("seq") <= FLUSHED))
        engine.append(log.where((F.col("seq") > FLUSHED) & (F.col("seq") <= 2 * FLUSHED)))
        engine.compact()
        engine.append(log.where(F.col("seq") > 2 * FLUSHED))
        return w.kept(engine.get(keys))


@query
def lsm_info(spark, sf_dir):
    """Sequence, tables, entries, bytes and totals after flushes and a compaction."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        engine.compact()
        return w.kept(engine.info())


@query
def engine_clear(spark, sf_dir):
    """Entries after a clear, and the sequence of the next write."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        engine.clear()
        left = engine.log().agg(F.count("*").alias("entries"))
        engine.put(spark.createDataFrame([("k", PUT, "v", 0)], "key string, type int, value string, day int"), "day", ["key"])
        return w.kept(left.crossJoin(engine.log().agg(F.max("seq").alias("next_seq"))))


@query
def engine_flush_during_compaction(spark, sf_dir):
    """All versions when a flush came between a merge and its publication."""
    log = fx.event_log(spark, sf_dir)
    third, two = _number(log, 1, 3), _number(log, 2, 3)
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        engine.append(log.where(F.col("seq") <= third))
        engine.append(log.where((F.col("seq") > third) & (F.col("seq") <= two)))
        job = engine.merge()
        Engine(spark, w.root).append(log.where(F.col("seq") > two))
        engine.install(job)
        return w.kept(engine.log())


@query
def engine_tables(spark, sf_dir):
    """Tables, the newest first."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        return w.kept(engine.tables().select("position", "entry_count", "min_key", "max_key", "min_seq", "max_seq", "data_bytes"))


@query
def engine_restore(spark, sf_dir):
    """Versions restored at their own sequences, with gaps; the next write follows the greatest."""
    log = fx.event_log(spark, sf_dir)
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        engine.restore(log.where("seq % 3 = 0 and seq <= 3000"))
        engine.restore(log.where("seq % 3 = 0 and seq > 3000"))
        engine.put(spark.createDataFrame([("k", PUT, "v", 0)], "key string, type int, value string, day int"), "day", ["key"])
        return w.kept(engine.log())


@query
def manifest_files(spark, sf_dir):
    """How many of a store's folders the manifest lists and does not list, before vacuum."""
    with Workspace(spark) as w:
        engine = Engine(spark, w.root)
        _parts(spark, sf_dir, engine)
        engine.compact()
        return w.kept(engine.orphans().groupBy("status").agg(F.count("*").alias("n")))


@query
def wal_roundtrip(spark, sf_dir):
    """The event log as binary frames and back."""
    with Workspace(spark) as w:
        wal.write(fx.event_log(spark, sf_dir), w.root)
        return w.kept(_text(wal.records(spark, w.root)))


@query
def wal_roundtrip_plain(spark, sf_dir):
    """The same in the other order of frames, without versions."""
    with Workspace(spark) as w:
        wal.write(fx.event_log(spark, sf_dir), w.root, "len_first")
        return w.kept(_text(wal.records(spark, w.root, "len_first")))


@query
def wal_rewrite(spark, sf_dir):
    """The log on disk after all through a sequence has been dropped."""
    with Workspace(spark) as w:
        wal.write(fx.event_log(spark, sf_dir), w.root)
        wal.discard_through(spark, w.root, FLUSHED)
        return w.kept(_text(wal.records(spark, w.root)))


def _torn(spark: SparkSession, sf_dir: str, root: str) -> None:
    """A node's folder: tables through FLUSHED, a log of all, its newest file cut inside the last frame."""
    log = fx.event_log(spark, sf_dir)
    Engine(spark, f"{root}/tables").append(log.where(F.col("seq") <= FLUSHED))
    wal.write(log, f"{root}/wal")
    folder = Folder(spark, f"{root}/wal")
    name = max(folder.sizes())
    folder.write(name, folder.read(name)[:-5], replace=True)


@query
def node_open(spark, sf_dir):
    """Live versions of a node that opens tables and a log with a torn tail."""
    with Workspace(spark) as w:
        _torn(spark, sf_dir, w.root)
        return w.kept(Node(spark, w.root).as_of())


@query
def node_recovery_stats(spark, sf_dir):
    with Workspace(spark) as w:
        _torn(spark, sf_dir, w.root)
        s = Node(spark, w.root).recovered
        return w.kept(spark.createDataFrame([(s["records_read"], s["skipped"], s["applied"], s["last_sequence"], s["torn_tail"])], "records_read long, skipped long, applied long, last_sequence long, torn_tail boolean"))


@query
def node_flush(spark, sf_dir):
    """Tables' versions and the log's, after opening, a put, a delete and a flush: where each version lies."""
    with Workspace(spark) as w:
        _torn(spark, sf_dir, w.root)
        node = Node(spark, w.root)
        node.flush()
        node.put(spark.createDataFrame([("new", PUT, "v", 0)], "key string, type int, value string, day int"), "day", ["key"])
        node.delete(spark.createDataFrame([("new",), ("user:1",)], "key string"))
        tables = node.engine.log().withColumn("place", F.lit("tables"))
        return w.kept(tables.unionByName(node.pending().withColumn("place", F.lit("log"))))


@query
def sstable_roundtrip(spark, sf_dir):
    """The event files as binary tables and back, by level and number in their names."""
    with Workspace(spark) as w:
        sstable.write(fx.event_files(spark, sf_dir), w.root)
        rows = _text(sstable.read(spark, w.root)).withColumn("p", naming.parse_level_name(F.substring_index("path", "/", -1)))
        return w.kept(rows.select("p.level", F.col("p.number").alias("file_no"), "key", "seq", "type", "value"))


@query
def sstable_index(spark, sf_dir):
    """Blocks as the tables' own index sections hold them."""
    with Workspace(spark) as w:
        sstable.write(fx.event_files(spark, sf_dir), w.root)
        rows = sstable.sections(spark, w.root).withColumn("p", naming.parse_level_name(F.col("name")))
        return w.kept(rows.select(F.col("p.number").alias("file_no"), F.col("key").cast("string").alias("key"), "offset", "size"))


@query
def sstable_levels(spark, sf_dir):
    """Levels of a folder by file names, beside an unfinished file, which goes, and a stranger."""
    with Workspace(spark) as w:
        sstable.write(fx.event_files(spark, sf_dir), w.root)
        folder = Folder(spark, w.root)
        folder.write("L1-000001.sst.tmp", b"x")
        folder.write("notes", b"x")
        found = sstable.recovered(spark, w.root)
        left = F.lit(sum(n.endswith(".tmp") for n in folder.sizes())).cast("long")
        return w.kept(found.groupBy("level").agg(F.count("*").alias("files"), F.min("number").alias("least"), F.max("number").alias("greatest")).withColumn("unfinished", left))


@query
def sstable_file_sizes(spark, sf_dir):
    """Bytes of every table on disk."""
    with Workspace(spark) as w:
        names = sstable.write(fx.event_files(spark, sf_dir), w.root)
        held = Folder(spark, w.root).sizes()
        return w.kept(spark.createDataFrame([(n, held[n]) for n in names], "name string, bytes long"))


@query
def table_size_formula(spark, sf_dir):
    """The same bytes by the formula: data, index and filter padded, and a page."""
    files = fx.event_files(spark, sf_dir)
    meta = layout.file_metadata(files, ("level", "file_no"))
    held = meta.join(sizes.sparse_index_size(index.build(files), meta), "file_no").withColumnRenamed("bytes", "index")
    return held.select(naming.level_name(F.col("level"), F.col("file_no")).alias("name"), sizes.table_size(F.col("data_bytes"), F.col("index"), bloom.bit_count(F.col("entry_count"))).alias("bytes"))


@query
def digest_verify(spark, sf_dir):
    """Which files still have their manifest's digests after one value has changed and another record is gone."""
    files = fx.event_files(spark, sf_dir)
    now = files.where("seq <> 20").withColumn("value", F.when(F.col("seq") == 777, "other").otherwise(F.col("value")))
    return sizes.verified(now, sizes.file_digests(files))


@query
def raft_state_roundtrip(spark, sf_dir):
    """A replicated log and its vote as a state file and back."""
    log = fx.raft_logs(spark, sf_dir).where("node = 0").select("idx", "term", F.concat_ws("|", F.col("cmd").cast("string"), "key", "value").cast("binary").alias("command"))
    with Workspace(spark) as w:
        top = log.agg(F.max("idx"), F.max("term")).first()
        raft_state.save(spark, w.root, raft_state.State(term=top[1] + 1, voted_for=2, committed=top[0] // 2, applied=top[0] // 4, applied_writes=top[0] // 5, leader=3), log)
        state, back = raft_state.load(spark, w.root, known={1, 2, 3})
        head = {"own_term": state.term, "voted_for": state.voted_for, "committed": state.committed, "applied": state.applied, "leader": state.leader}
        return w.kept(back.select("idx", "term", F.col("command").cast("string").alias("command"), *[F.lit(v).cast("long").alias(k) for k, v in head.items()]))


@query
def raft_leader_endpoint(spark, sf_dir):
    """Where the nodes' leaders are: addresses of known peers only."""
    nodes = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey")).cast("int").alias("leader_id"))
    peers = naming.parse_peers(naming.literal_rows(spark, [PEERS]), "text").where("node_id is not null")
    return consensus.leader_endpoint(nodes, peers.select("node_id", F.concat_ws(":", "host", F.col("port").cast("string")).alias("address")))


@query
def raft_vote_eligibility(spark, sf_dir):
    return consensus.vote_eligibility(fx.raft_logs(spark, sf_dir))


@query
def single_node_commit(spark, sf_dir):
    """State of a one-node consensus that has accepted the leader's commands and committed a part of them."""
    commands = fx.raft_logs(spark, sf_dir).where("node = 0").select("cmd", "key", "value", "term", F.col("idx").alias("no"))
    node = SingleNode()
    node.propose(commands, "term", ["no"])
    node.commit_up_to(COMMITTED)
    return node.state()


@query
def single_node_propose(spark, sf_dir):
    """What becomes of proposals: malformed ones get no index."""
    k = F.col("o_orderkey")
    commands = fx.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 10 == 0, DELETE).otherwise(PUT).alias("cmd"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("cust:"), F.col("o_custkey"))).alias("key"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"), F.floor(k / 1000).alias("part")
    )
    return SingleNode().propose(commands, "part", ["id"]).select("id", "status", "idx")


@query
def canonical_order(spark, sf_dir):
    """Places of all versions in canonical order."""
    return mvcc.canonical_places(fx.event_log(spark, sf_dir))


@query
def falling_sequences(spark, sf_dir):
    """Versions that a memtable refuses: delivered out of order, they do not rise for their key."""
    log = fx.event_log(spark, sf_dir).join(fx.deliveries(spark, sf_dir).withColumnRenamed("idx", "seq"), "seq")
    return mvcc.falling(log, "arrival")


@query
def table_gauges(spark, sf_dir):
    return layout.gauges(_files(spark, sf_dir))


@query
def level_one_over_budget(spark, sf_dir):
    """Levels that are due, by the score of at least 1."""
    return layout.level_scores(_files(spark, sf_dir), "data_bytes", l1_bytes=L1_BYTES).where("score >= 1").select("level", "files", "bytes")


@query
def fixed_codec(spark, sf_dir):
    """Order numbers and scaled dates as little-endian bytes, and back."""
    n = F.col("o_orderkey")
    wide = n * 4294967296 + F.col("o_custkey")
    rows = fx.table(spark, sf_dir, "orders").select(n.alias("id"), codec.fixed32_encode(n).alias("a"), codec.fixed64_encode(wide).alias("b"))
    return rows.select("id", F.hex("a").alias("fixed32"), F.hex("b").alias("fixed64"), codec.fixed32_decode(F.col("a")).alias("n32"), codec.fixed64_decode(F.col("b")).alias("n64"))


@query
def composite_keys(spark, sf_dir):
    """Version keys whose bytes order as versions do; the least nation number stands for a zero byte in the key."""
    nations = fx.table(spark, sf_dir, "nation")
    key = F.concat(F.col("n_name").cast("binary"), F.unhex(F.lpad(F.hex((F.col("n_nationkey") % 2).cast("long")), 2, "0")), F.unhex(F.lit("00")))
    return nations.select("n_nationkey", F.hex(codec.version_key(key, F.col("n_nationkey").cast("long") + 1)).alias("version_key"))


@query
def command_codec(spark, sf_dir):
    """Commands as bytes, and what decodes from them when they are whole and when the last byte is cut."""
    b = lambda c: c.cast("binary")
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), codec.command_encode((F.col("c_custkey") % 3 + 1).cast("int"), b(F.col("c_name")), b(F.col("c_mktsegment")), b(F.lit("r"))).alias("raw"))
    back, cut = codec.command_decode("raw"), codec.command_decode(F.expr("substring(raw, 1, length(raw) - 1)"))
    return rows.select("id", F.hex("raw").alias("raw"), back.alias("c"), cut.alias("d")).select("id", "raw", "c.type", F.col("c.key").cast("string").alias("key"), F.col("c.value").cast("string").alias("value"), F.col("d.error").isNotNull().alias("cut_fails"))


@query
def status_texts(spark, sf_dir):
    """Status codes with and without a message."""
    return fx.table(spark, sf_dir, "nation").where("n_nationkey < 16").select("n_nationkey", naming.status_text((F.col("n_nationkey") % 8).cast("int"), F.when(F.col("n_nationkey") < 8, "").otherwise(F.col("n_name"))).alias("text"))


@query
def cluster_lines(spark, sf_dir):
    return naming.parse_cluster_lines(naming.literal_rows(spark, ANSWERS, "value").withColumnRenamed("value", "line"), "line")


@query
def truth_values(spark, sf_dir):
    return naming.literal_rows(spark, TRUTHS).select("text", naming.parse_bool(F.col("text")).alias("truth"))


@query
def settings_text(spark, sf_dir):
    """Settings of a text, defaults filled in."""
    s = config.parse("\n".join(SETTINGS)).validated()
    return spark.createDataFrame([(s.node_id, s.data_dir, s.max_memtable_size, s.sync_wal, s.client_port, s.peer_port, s.metrics_port)], "node_id string, data_dir string, max_memtable_size long, sync_wal boolean, client_port int, peer_port int, metrics_port int")
