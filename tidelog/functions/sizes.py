"""Sizes of frames, records, pages and indexes, and checksums of records."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mvcc import byte_size

# Bytes of a frame's head and fixed payload in two log formats, a record's head, a page.
LOG_FRAME = 33
PLAIN_FRAME = 25
RECORD = 17
PAGE = 4096


def frame_size(fixed: int = LOG_FRAME) -> Column:
    return byte_size("key", "value") + fixed


def aligned(size: Column, page: int = PAGE) -> Column:
    return (F.floor((size + (page - 1)) / page) * page).cast("long")


def little_endian(value: Column, width: int) -> Column:
    """The low `width` bytes of a number as binary, least first."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*[F.unhex(F.substring(digits, 2 * (width - i) - 1, 2)) for i in range(width)])


def record_bytes() -> Column:
    """A version as its table record: lengths, sequence, type (0 put, 1 delete), key, value."""
    key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
    return F.concat(little_endian(F.octet_length(key).cast("long"), 4), little_endian(F.octet_length(value).cast("long"), 4), little_endian(F.col("seq"), 8), little_endian((F.col("type") - 1).cast("long"), 1), key, value)


def file_digests(entries: DataFrame) -> DataFrame:
    """file_no, records, digest: CRC-32 over a file's records laid end to end in canonical order, as its footer holds it. The
    checksum is chained from batch to batch, so a file of any size takes constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, crc, out = None, 0, 0, []
        for batch in batches:
            for file_no, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file_no != now:
                    out += [(now, n, crc)] if n else []
                    now, n, crc = file_no, 0, 0
                n, crc = n + 1, zlib.crc32(record.as_buffer(), crc)
        out += [(now, n, crc)] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, ["file_no", "records", "digest"])

    rows = entries.select(F.col("file_no").cast("long").alias("file_no"), record_bytes().alias("record"), "key", "seq").repartition("file_no").sortWithinPartitions("file_no", "key", F.desc("seq"))
    return rows.select("file_no", "record").mapInArrow(run, "file_no long, records long, digest long")


def verified(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_no, intact: do a file's records still have the manifest's count and digest?"""
    now = file_digests(entries).toDF("file_no", "n", "d")
    return manifest.join(now, "file_no", "left").select("file_no", F.coalesce((F.col("n") == F.col("records")) & (F.col("d") == F.col("digest")), F.lit(False)).alias("intact"))


def sparse_index_size(index: DataFrame, bounds: DataFrame) -> DataFrame:
    """file_no, bytes of the serialized index: 12, both bounds, and 16 and the key for each block."""
    blocks = index.groupBy("file_no").agg(F.sum(byte_size("key") + 16).alias("b"))
    return bounds.join(blocks, "file_no").select("file_no", (F.lit(12) + byte_size("min_key", "max_key") + F.col("b")).alias("bytes"))


def table_size(data: Column, index: Column, bits: Column) -> Column:
    """Bytes of a binary table: data, index and filter padded to pages, and the footer's page."""
    return aligned(data) + aligned(index) + aligned((F.lit(28) + F.ceil(bits / 8)).cast("long")) + PAGE
