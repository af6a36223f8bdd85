"""Write-ahead logs as binary files: frames of checksum, length and payload, one pass per file in bounded pieces.

Two frame orders are read and written: "crc_first" (checksum, length; the payload carries a version) and "len_first"
(length, checksum). A log is a folder of files, each a range of sequences and named by its last; files are the unit of
parallelism, as order within one is strict.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import DELETE, PUT, LogError
from .files import Folder, task_stream

# Layouts of the head and of the payload's numbers, and the longest payload.
HEAD = struct.Struct("<II")
VERSIONED = struct.Struct("<QBQI")
PLAIN = struct.Struct("<QBII")
LENGTH = struct.Struct("<I")
MOST_PAYLOAD = 64 << 20

RECORD, END, TRUNCATED_TAIL, CORRUPT = "RECORD", "END", "TRUNCATED_TAIL", "CORRUPT"


@dataclass(frozen=True)
class Record:
    seq: int
    type: int
    key: bytes
    value: bytes
    version: int = 0


def encode(r: Record, form: str = "crc_first") -> bytes:
    if form == "crc_first":
        payload = VERSIONED.pack(r.seq, r.type, r.version, len(r.key)) + r.key + LENGTH.pack(len(r.value)) + r.value
        return HEAD.pack(zlib.crc32(payload), len(payload)) + payload
    payload = PLAIN.pack(r.seq, r.type, len(r.key), len(r.value)) + r.key + r.value
    return HEAD.pack(len(payload), zlib.crc32(payload)) + payload


def _payload(p: bytes, form: str) -> Record | str:
    """The record, or what is wrong with the payload."""
    if form == "crc_first":
        if len(p) < VERSIONED.size:
            return "malformed payload"
        seq, kind, version, k = VERSIONED.unpack_from(p)
        at = VERSIONED.size + k
        if k == 0 or at > len(p):
            return "key length out of bounds"
        if at + 4 > len(p):
            return "value length missing"
        (v,) = LENGTH.unpack_from(p, at)
        key, value, rest = p[VERSIONED.size : at], p[at + 4 :], at + 4 + v
    else:
        if len(p) < PLAIN.size:
            return "malformed payload"
        seq, kind, k, v = PLAIN.unpack_from(p)
        version, at = 0, PLAIN.size
        key, value, rest = p[at : at + k], p[at + k :], at + k + v
        if k == 0:
            return "key length out of bounds"
    if rest != len(p):
        return "value length out of bounds"
    if kind not in (PUT, DELETE):
        return "unknown operation"
    if kind == DELETE and value:
        return "a delete carries a value"
    return Record(seq, kind, key, value, version)


def frames(data: bytes, form: str = "crc_first", damaged_tail: str = "corrupt") -> Iterator[tuple[str, int, int, Record | None, str]]:
    """(status, offset, frame length, record, reason) of the longest valid prefix, then one row with how it ended.

    A cut frame is a torn tail. A damaged frame is corruption; with damaged_tail='torn' it is a torn tail if it is the
    last. Sequences must rise."""
    at, last = 0, None
    while at < len(data):
        if len(data) - at < HEAD.size:
            yield TRUNCATED_TAIL, at, 0, None, "head cut"
            return
        a, b = HEAD.unpack_from(data, at)
        crc, n = (a, b) if form == "crc_first" else (b, a)
        if n > MOST_PAYLOAD:
            yield CORRUPT, at, 0, None, "payload too long"
            return
        end = at + HEAD.size + n
        if end > len(data):
            yield TRUNCATED_TAIL, at, 0, None, "payload cut"
            return
        payload = data[at + HEAD.size : end]
        if zlib.crc32(payload) != crc:
            yield (TRUNCATED_TAIL if damaged_tail == "torn" and end == len(data) else CORRUPT), at, 0, None, "checksum mismatch"
            return
        r = _payload(payload, form)
        if isinstance(r, str) or last is not None and r.seq <= last:
            yield CORRUPT, at, 0, None, r if isinstance(r, str) else "sequence does not rise"
            return
        yield RECORD, at, end - at, r, ""
        last, at = r.seq, end
    yield END, at, 0, None, ""


COLUMNS = "path string, status string, offset long, frame_len long, seq long, type int, version long, key binary, value binary, reason string"


def read(spark: SparkSession, path: str, form: str = "crc_first", damaged_tail: str = "corrupt") -> DataFrame:
    """Frames of every log file under path; each file's last row says how its valid prefix ended."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for status, at, n, r, why in frames(bytes(data), form, damaged_tail):
                    rows.append((p, status, at, n, *((r.seq, r.type, r.version, r.key, r.value) if r else (None,) * 5), why))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"seq": "Int64", "type": "Int32", "version": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, COLUMNS)


def records(spark: SparkSession, path: str, form: str = "crc_first", damaged_tail: str = "corrupt") -> DataFrame:
    """key, seq, type, value of the valid prefixes; a corrupt file is refused when its frames are read."""
    from pyspark.sql import functions as F

    rows = read(spark, path, form, damaged_tail)
    bad = F.raise_error(F.concat(F.lit("corrupt log "), F.col("path"), F.lit(": "), F.col("reason")))
    return rows.where(F.when(F.col("status") == CORRUPT, bad.isNotNull()).otherwise(F.col("status") == RECORD)).select("key", "seq", "type", "value")


def _name(last: int) -> str:
    return f"{last:020d}.wal"


def last_sequences(spark: SparkSession, path: str) -> list[int]:
    """The last sequence of each file of a log, in order: that is what files are named by."""
    return sorted(int(n[:-4]) for n in Folder(spark, path).sizes() if n.endswith(".wal"))


def write(log: DataFrame, path: str, form: str = "crc_first", files: int | None = None) -> None:
    """Append rows to a log: a file of frames for each range of sequences, written by its task and named by the driver once
    all are there (`files` of them at most, or as many as adaptive execution finds worth a task). Sequences must rise,
    over those in the log too. An empty frame writes nothing."""
    spark = log.sparkSession
    folder = Folder(spark, path)
    folder.make()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, first, last = None, f".{uuid.uuid4().hex}", None, None
        for batch in batches:
            for seq, kind, key, value in zip(*(batch[c].tolist() for c in ("seq", "type", "key", "value")), strict=True):
                if last is not None and seq <= last:
                    raise LogError("sequences must rise")
                if out is None:
                    out, first = task_stream(path, name), seq
                last = seq
                out.write(encode(Record(seq, kind, bytes(key), bytes(value)), form))
        if out is not None:
            out.close()
            yield pd.DataFrame([(name, first, last)], columns=["name", "first", "last"])

    rows = log.selectExpr("seq", "cast(type as int) as type", "cast(key as binary) as key", "cast(value as binary) as value")
    done = sorted(rows.repartitionByRange(*([files] if files else []), "seq").sortWithinPartitions("seq").mapInPandas(run, "name string, first long, last long").collect(), key=lambda r: r["first"])
    before = last_sequences(spark, path)
    if before and done and done[0]["first"] <= before[-1]:
        for r in done:
            folder.delete(r["name"])
        raise LogError("sequences must rise")
    for r in done:
        folder.rename(r["name"], _name(r["last"]))


def truncate(spark: SparkSession, path: str, name: str, valid_bytes: int, last: int | None) -> None:
    """Cut a file's torn tail: its valid prefix is written aside, renamed to its own last sequence, and the old file goes."""
    folder = Folder(spark, path)
    if last is not None:
        folder.write(_name(last), folder.read(name)[:valid_bytes], replace=True)
    if last is None or _name(last) != name:
        folder.delete(name)


def discard_through(spark: SparkSession, path: str, seq: int, form: str = "crc_first") -> int:
    """Drop all records up to seq: whole files go, and the file that holds seq and more is replaced by one of the rest. The
    number of files that went. A crash on the way leaves files that replay skips by their sequences."""
    folder, gone = Folder(spark, path), 0
    for last in last_sequences(spark, path):
        if last <= seq:
            folder.delete(_name(last))
            gone += 1
            continue
        raw = folder.read(_name(last))
        found = list(frames(raw, form))
        if found[-1][0] == CORRUPT:
            raise LogError(f"corrupt log {path}/{_name(last)}: {found[-1][4]}")
        start = next((at for status, at, _, r, _ in found if status == RECORD and r.seq > seq), len(raw))
        if start:
            folder.write(_name(last), raw[start:], replace=True)
        break
    return gone
