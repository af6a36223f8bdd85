"""Streams over replicated logs: apply in order with gaps buffered, and watch peers. State is kept by key in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.codec import decode_command

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
APPLIED = "grp string, idx long, type int, key binary, value binary, outcome string"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class OrderedApplier(StatefulProcessor):
    """Entries (grp, idx, payload) come in any order; each is applied once, in order. Those under the next index are
    duplicates and dropped, those over it wait in the pending map; a payload that does not decode uses up its index."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "idx long")
        self.pending = handle.getMapState("pending", "idx long", "payload binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        want = self.next.get()[0] if self.next.exists() else 1
        for frame in rows:
            for idx, payload in zip(frame["idx"].tolist(), frame["payload"], strict=True):
                if idx >= want and not self.pending.containsKey((idx,)):
                    self.pending.updateValue((idx,), (bytes(payload),))
        out = []
        while self.pending.containsKey((want,)):
            c = decode_command(bytes(self.pending.getValue((want,))[0]))
            self.pending.removeKey((want,))
            outcome = "SKIPPED_CORRUPT" if c["error"] else {1: "APPLIED", 2: "APPLIED", 3: "NOOP"}[c["type"]]
            out.append((key[0], want, c["type"] or 0, c["key"] or b"", c["value"] or b"", outcome))
            want += 1
        self.next.update((want,))
        yield pd.DataFrame(out, columns=["grp", "idx", "type", "key", "value", "outcome"])

    def close(self) -> None:
        pass


def apply_in_order(entries: DataFrame) -> DataFrame:
    """entries: a stream of (grp, idx, payload); every group is a log of its own."""
    return entries.groupBy("grp").transformWithStateInPandas(OrderedApplier(), outputStructType=APPLIED, outputMode="Append", timeMode="None")


class PeerMonitor(StatefulProcessor):
    """Pings (peer, event_id, ok) become state changes: up at the first success, down at the second failure in a row."""

    fails = 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "state string, failed int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, failed = self.seen.get() if self.seen.exists() else ("UNKNOWN", 0)
        out = []
        for i, ok in sorted((i, ok) for f in rows for i, ok in zip(f["event_id"].tolist(), f["ok"].tolist(), strict=True)):
            failed = 0 if ok else failed + 1
            now = "UP" if ok else "DOWN" if failed >= self.fails else state
            if now != state:
                out.append((key[0], i, now))
            state = now
        self.seen.update((state, failed))
        yield pd.DataFrame(out, columns=["peer", "event_id", "state"])

    def close(self) -> None:
        pass


def watch_peers(pings: DataFrame) -> DataFrame:
    return pings.groupBy("peer").transformWithStateInPandas(PeerMonitor(), outputStructType="peer long, event_id long, state string", outputMode="Append", timeMode="None")
