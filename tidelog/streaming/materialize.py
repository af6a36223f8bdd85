"""A stream of versions into an engine's tables: every micro-batch is flushed once, and tables are merged when due."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Engine


def into(stream: DataFrame, engine: Engine, checkpoint: str, on_flushed: Callable[[int], None] | None = None, retained: int = 10, **trigger) -> StreamingQuery:
    """stream: (key, seq, type, value). A batch that comes again after a restart is known by its number and skipped. Readers
    of the newest `retained` versions go on undisturbed."""

    def flush(batch: DataFrame, number: int) -> None:
        m = engine.append(batch, batch=number)
        if on_flushed:
            on_flushed(m.high_water)
        if engine.needs_compaction():
            engine.compact()
            engine.vacuum(retained)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
