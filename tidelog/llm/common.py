"""Helpers that the training-data operators share: table access, lineage cuts and scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once (a longer document comes alone).
CHUNK_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir; one of our own only where that is
    unset and all run in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small frame in the shared folder; later reads survive the loss of any executor. Spark removes the
    files when the frame is no longer referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch(contextlib.AbstractContextManager):
    """Tables written to the shared folder for the time of a `with` block.

    Frames that outlive the block must have been passed through cut() inside it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.freed = _settings(spark)

    def __enter__(self) -> Scratch:
        self.freed.__enter__()
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}", compression="zstd")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Free a table that nothing will read again."""
        remove(self.spark, f"{self.root}/{name}")

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)
        self.freed.__exit__(*_)


#: Shuffle files of a finished execution go at once instead of waiting for a garbage collection; Python workers get
#: batches of so few rows that long texts fit.
_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Return freed memory of this worker to the system; workers stay for later tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(c):
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most about `most` bytes; null counts as empty.

    `bytes` are the rows' UTF-8 texts one after another, offsets[i]..offsets[i + 1] those of row first + i.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary()).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, flat[offsets[a] : offsets[b]], (offsets[a : b + 1] - offsets[a])
        a = b
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
