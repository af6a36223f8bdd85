"""A consensus of one node, for queries and tests: proposals get indexes, and what is committed is applied in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import consensus
from ..operators.running import numbered


@dataclass
class SingleNode:
    """log: (idx, cmd, key, value) of accepted commands."""

    log: DataFrame | None = None
    leader: bool = True
    leader_hint: int = 0
    committed: int = 0

    def last(self) -> int:
        return (self.log.agg(F.max("idx")).first()[0] or 0) if self.log is not None else 0

    def propose(self, commands: DataFrame, group: str, order: list[str]) -> DataFrame:
        """commands (cmd, key, value and what orders them) with status and idx: INVALID ones and all of a node that does not
        lead get none; the others follow the log in their order."""
        kind = consensus.outcome()
        judged = commands.withColumn("status", F.when(F.lit(not self.leader), "NOT_LEADER").when(kind == "REJECTED_INVALID", "INVALID").otherwise("ACCEPTED"))
        taken = numbered(judged.where("status = 'ACCEPTED'"), [group], order, "idx").withColumn("idx", F.col("idx") + self.last())
        accepted = taken.select("idx", "cmd", "key", "value")
        self.log = accepted if self.log is None else self.log.unionByName(accepted)
        return taken.unionByName(judged.where("status <> 'ACCEPTED'").withColumn("idx", F.lit(None).cast("long")))

    def commit_up_to(self, index: int) -> int:
        """Commit up to index or the log's end, never back; the commit index."""
        self.committed = max(self.committed, min(index, self.last()))
        return self.committed

    def commit_all(self) -> int:
        return self.commit_up_to(self.last())

    def set_leader(self, leader: bool, hint: int = 0) -> None:
        self.leader, self.leader_hint = leader, hint

    def state(self) -> DataFrame:
        """key, value after the committed commands."""
        return consensus.applied(self.log, self.committed)
