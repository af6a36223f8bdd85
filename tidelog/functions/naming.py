"""Names, addresses and small settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_name(number: Column) -> Column:
    return F.format_string("%06d.sst", number)


def level_name(level: Column, number: Column) -> Column:
    return F.format_string("L%d-%06d.sst", level, number)


def parse_level_name(name: Column) -> Column:
    """struct(level, number), null for any other name."""
    ok = name.rlike(r"^L\d+-\d+\.sst$")
    return F.when(ok, F.struct(F.regexp_extract(name, r"^L(\d+)-", 1).cast("int").alias("level"), F.regexp_extract(name, r"-(\d+)\.sst$", 1).cast("long").alias("number")))


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "on"), True).when(t.isin("false", "0", "no", "off"), False)


def parse_peers(df: DataFrame, column: str) -> DataFrame:
    """node_id, host, port of each entry `id=host:port` in comma-separated text; malformed entries give nulls."""
    entry = F.trim("_entry")
    whole = r"^(\d+)=([^:=]+):(\d+)$"
    part = lambda i: F.when(entry.rlike(whole), F.regexp_extract(entry, whole, i))
    each = df.select(F.explode(F.split(column, ",")).alias("_entry")).where(F.trim("_entry") != "")
    return each.select(part(1).cast("int").alias("node_id"), part(2).alias("host"), part(3).cast("int").alias("port"))


def pod_identity(df: DataFrame, pod: str, replicas: int, service: str, namespace: str, domain: str, port: int) -> DataFrame:
    """pod, node_id, self, peer_id, address: the replicas of a stateful set; node ids are ordinals plus one."""
    base, ordinal = F.regexp_extract(pod, r"^(.*)-(\d+)$", 1), F.regexp_extract(pod, r"-(\d+)$", 1).cast("int")
    rows = df.select(F.col(pod).alias("pod"), base.alias("base"), ordinal.alias("ordinal"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("peer"))
    address = F.concat(F.concat_ws(".", F.concat("base", F.lit("-"), "peer"), F.lit(service), F.lit(namespace), F.lit(domain)), F.lit(f":{port}"))
    return rows.select("pod", (F.col("ordinal") + 1).alias("node_id"), (F.col("ordinal") == F.col("peer")).alias("is_self"), (F.col("peer") + 1).alias("peer_id"), address.alias("address"))


# Names of the status codes, by number.
STATUS = ["OK", "NotFound", "AlreadyExists", "InvalidArgument", "IOError", "Corruption", "NotSupported", "InternalError"]


def status_text(code: Column, message: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(s) for s in STATUS]), code + 1)
    return F.when((code == 0) | (message == ""), name).otherwise(F.concat(name, F.lit(": "), message))


def parse_cluster_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a node's text answer: RAFT role and term, SELF and PEER addresses, VALUE, redirects."""
    c = F.col(column)
    pick = lambda p: F.when(c.rlike(p), F.regexp_extract(c, p, 1))
    return lines.select(
        F.regexp_extract(c, r"^(RAFT|SELF|PEER|VALUE|REDIRECT)", 1).alias("kind"), pick(r"role=(\w+)").alias("role"), pick(r"term=(\d+)").cast("long").alias("term"), pick(r"id=(\d+)").cast("int").alias("node_id"), pick(r"address=(\S+)").alias("address"), pick(r"^VALUE=(.*)$").alias("value")
    )


def literal_rows(spark: SparkSession, values: list[str], name: str = "text") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
