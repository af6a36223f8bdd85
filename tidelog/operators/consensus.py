"""Replicated logs as tables: matching, conflicts, quorum, votes, ordered apply.

`logs` is a frame of (node, idx, term, cmd, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, MAX_KEY_BYTES, MAX_VALUE_BYTES, NOOP, PUT
from .mvcc import live
from .running import running


def log_match(logs: DataFrame, leader: int = 0) -> DataFrame:
    """follower, match_index, conflict_index, conflict_term of every other node: the first index whose term or payload
    differs, or the one past a shorter log (its term then null)."""
    mine = logs.where(F.col("node") == leader).select("idx", F.col("term").alias("t"), F.struct("cmd", "key", "value").alias("p"))
    theirs = logs.where(F.col("node") != leader)
    both = theirs.join(mine, "idx", "left")
    differs = F.col("t").isNull() | (F.col("t") != F.col("term")) | (F.col("p") != F.struct("cmd", "key", "value"))
    first = both.groupBy(F.col("node").alias("follower")).agg(F.min(F.when(differs, F.struct("idx", "term"))).alias("c"), F.max("idx").alias("last"))
    end = F.coalesce("c.idx", F.col("last") + 1)
    return first.select("follower", (end - 1).alias("match_index"), end.alias("conflict_index"), F.col("c.term").alias("conflict_term"))


def conflict_hint(logs: DataFrame, leader: int = 0) -> DataFrame:
    """follower, hint_index: the first index of the run of the conflicting term in the follower's log."""
    at = log_match(logs, leader).where("conflict_term is not null")
    other = logs.join(F.broadcast(at), (F.col("node") == F.col("follower")) & (F.col("idx") < F.col("conflict_index")) & (F.col("term") != F.col("conflict_term")))
    before = other.groupBy("follower").agg(F.max("idx").alias("b"))
    return at.join(before, "follower", "left").select("follower", (F.coalesce("b", F.lit(0)) + 1).alias("hint_index"))


def replace_suffix(logs: DataFrame, follower: int, leader: int = 0, committed: int = 0) -> DataFrame:
    """The follower's log after the leader's entries have come: its own up to the conflict, then the leader's. Committed
    entries are never replaced."""
    start = log_match(logs.where(F.col("node").isin(leader, follower)), leader).select(F.greatest("conflict_index", F.lit(committed + 1)).alias("c"))
    own = logs.where(F.col("node") == follower).crossJoin(F.broadcast(start)).where("idx < c").drop("c")
    rest = logs.where(F.col("node") == leader).crossJoin(F.broadcast(start)).where("idx >= c").drop("c")
    return own.unionByName(rest).select("idx", "term", "cmd", "key", "value")


def quorum(n: int) -> int:
    return n // 2 + 1


def commit_index(logs: DataFrame, nodes: int, leader: int = 0) -> DataFrame:
    """commit_index: the greatest index that a majority holds, if it is of the leader's current term; else 0."""
    held = log_match(logs, leader).select("match_index")
    own = logs.where(F.col("node") == leader).agg(F.max("idx").alias("match_index"), F.max("term").alias("term"))
    at = held.unionByName(own.select("match_index")).orderBy(F.desc("match_index")).limit(quorum(nodes)).agg(F.min("match_index").alias("idx"), F.count("*").alias("n")).where(F.col("n") == quorum(nodes))
    entry = logs.where(F.col("node") == leader).select("idx", F.col("term").alias("t"))
    ok = at.join(entry, "idx").crossJoin(own.select("term")).where("t = term").select("idx")
    return ok.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long").alias("commit_index"))


def data_command() -> Column:
    return F.col("cmd").isin(PUT, DELETE)


def outcome() -> Column:
    """What the state machine does with a committed command; a rejected one uses up its index all the same."""
    bad = (F.octet_length("key") < 1) | (F.octet_length("key") > MAX_KEY_BYTES) | (F.octet_length("value") > MAX_VALUE_BYTES) | ((F.col("cmd") == DELETE) & (F.octet_length("value") > 0))
    noop = (F.octet_length("key") == 0) & (F.octet_length("value") == 0)
    return F.when((F.col("cmd") == NOOP) & noop, "NOOP").when(data_command() & ~bad, "APPLIED").otherwise("REJECTED_INVALID")


def applied(log: DataFrame, commit: int | Column) -> DataFrame:
    """key, value after the committed prefix of one log."""
    done = log.where((F.col("idx") <= commit) & data_command()).where(outcome() == "APPLIED")
    return live(done.select("key", F.col("idx").alias("seq"), F.col("cmd").alias("type"), "value")).select("key", "value")


def apply_outcomes(log: DataFrame, commit: int | Column, done: int = 0) -> DataFrame:
    """outcome, n of delivered committed entries; those up to `done` were applied before."""
    kind = F.when(F.col("idx") <= done, "SKIPPED_DUPLICATE").otherwise(outcome())
    return log.where(F.col("idx") <= commit).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def vote_tally(votes: DataFrame, peers: DataFrame, nodes: int) -> DataFrame:
    """candidate, term, votes, elected: distinct known voters that granted, and the candidate's own vote once."""
    known = votes.join(F.broadcast(peers), "voter", "left_semi")
    yes = F.count_distinct(F.when(F.col("granted") & (F.col("voter") != F.col("candidate")), F.col("voter"))) + 1
    return known.groupBy("candidate", "term").agg(yes.alias("votes")).withColumn("elected", F.col("votes") >= quorum(nodes))


def up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """May a candidate with this last entry get the vote?"""
    return (term > own_term) | ((term == own_term) & (index >= own_index))


def apply_delay(delivered: DataFrame) -> DataFrame:
    """idx, arrival, applied_at: an entry is applied once all before it have come, so at the running maximum of arrivals."""
    return running(delivered.select("idx", "arrival"), "idx", applied_at=("max", F.col("arrival"))).select("idx", "arrival", "applied_at")


def contiguous_prefix(delivered: DataFrame) -> DataFrame:
    """One row, next_index: the first index that has not come."""
    got = delivered.select("idx").distinct()
    top = running(got, "idx", n=("sum", F.lit(1))).where(F.col("n") == F.col("idx"))
    return top.agg((F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("next_index"))


def durable_reconcile(log: DataFrame, durable: int) -> DataFrame:
    """recovered_applied: the last index up to which no more data commands stand than durable writes were counted."""
    rows = running(log.select("idx", data_command().alias("d")), "idx", n=("sum", F.col("d").cast("long")))
    return rows.where(F.col("n") <= durable).agg(F.coalesce(F.max("idx"), F.lit(0)).alias("recovered_applied"))


def peer_states(pings: DataFrame, fails: int = 2) -> DataFrame:
    """peer, event_id, state after each ping: UP on success, DOWN from the second failure in a row, UNKNOWN before either."""
    order = Window.partitionBy("peer").orderBy("event_id")
    recent = [F.lag("ping_ok", i).over(order) for i in range(1, fails)]
    lost = ~F.col("ping_ok")
    for past in recent:
        lost = lost & F.coalesce(~past, F.lit(False))
    ever = F.coalesce(F.max(F.col("ping_ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1
    return pings.select("peer", "event_id", F.when(F.col("ping_ok"), "UP").when(lost, "DOWN").when(ever, "UP").otherwise("UNKNOWN").alias("state"))


def leader_endpoint(nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """node, leader_id and the leader's address (null: unknown)."""
    return nodes.join(endpoints.select(F.col("node_id").alias("leader_id"), "address"), "leader_id", "left").select("node", "leader_id", "address")


def vote_eligibility(logs: DataFrame) -> DataFrame:
    """candidate, voter, eligible: is the candidate's last entry at least as new as the voter's?"""
    last = logs.groupBy("node").agg(F.max(F.struct("idx", "term")).alias("l"))
    a, b = last.select(F.col("node").alias("candidate"), F.col("l.term").alias("t"), F.col("l.idx").alias("i")), last.select(F.col("node").alias("voter"), F.col("l.term").alias("own_t"), F.col("l.idx").alias("own_i"))
    # a row a node
    return a.join(b, F.col("candidate") != F.col("voter")).select("candidate", "voter", up_to_date(F.col("t"), F.col("i"), F.col("own_t"), F.col("own_i")).alias("eligible"))
