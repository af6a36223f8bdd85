"""Binary codecs as Arrow UDFs: little-endian numbers, commands, and the composite key that orders versions."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DELETE, NOOP, PUT

# Version of the command format, and its header: version, type, three 32-bit lengths.
COMMAND_VERSION = 1
COMMAND_HEADER = struct.Struct("<BBIII")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def encode_command(kind: int, key: bytes, value: bytes, request_id: bytes) -> bytes:
    return COMMAND_HEADER.pack(COMMAND_VERSION, kind, len(key), len(value), len(request_id)) + key + value + request_id


def decode_command(raw: bytes) -> dict:
    """type, key, value, request_id and error (null if the buffer is a command)."""
    out = {"type": None, "key": None, "value": None, "request_id": None, "error": None}
    if len(raw) < COMMAND_HEADER.size:
        return out | {"error": "shorter than a header"}
    version, kind, k, v, r = COMMAND_HEADER.unpack_from(raw)
    if version != COMMAND_VERSION:
        return out | {"error": f"format {version} is not known"}
    if kind not in (PUT, DELETE, NOOP):
        return out | {"error": f"type {kind} is not known"}
    at = COMMAND_HEADER.size
    if at + k + v + r != len(raw):
        return out | {"error": "lengths do not add up"}
    return out | {"type": kind, "key": raw[at : at + k], "value": raw[at + k : at + k + v], "request_id": raw[at + k + v :]}


@F.pandas_udf(T.BinaryType())
def command_encode(kind: pd.Series, key: pd.Series, value: pd.Series, request_id: pd.Series) -> pd.Series:
    return pd.Series([encode_command(int(t), bytes(k), bytes(v), bytes(r)) for t, k, v, r in zip(kind, key, value, request_id, strict=True)])


@F.pandas_udf(_struct(type=T.IntegerType(), key=T.BinaryType(), value=T.BinaryType(), request_id=T.BinaryType(), error=T.StringType()))
def command_decode(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_command(bytes(r)) for r in raw], columns=["type", "key", "value", "request_id", "error"])


def composite_key(key: bytes, seq: int) -> bytes:
    """Bytes that order by key ascending, then sequence descending: zero bytes escaped, the key ended by two of them, the
    sequence's complement big-endian."""
    return key.replace(b"\0", b"\0\xff") + b"\0\0" + (~seq & (1 << 64) - 1).to_bytes(8, "big")


def split_composite(raw: bytes) -> tuple[bytes, int]:
    body, tail = raw[:-8], raw[-8:]
    if len(raw) < 10 or body[-2:] != b"\0\0" or b"\0" in body[:-2].replace(b"\0\xff", b""):
        raise ValueError("malformed composite key")
    return body[:-2].replace(b"\0\xff", b"\0"), ~int.from_bytes(tail, "big") & (1 << 64) - 1


def version_key(key: Column | str, seq: Column | str) -> Column:
    """composite_key() of columns, in hexadecimal digits all the way: every zero byte of the key gets an FF behind it."""
    key = F.col(key) if isinstance(key, str) else key
    seq = F.col(seq) if isinstance(seq, str) else seq
    digits = F.regexp_replace(F.hex(key.cast("binary")), r"\G((?:(?!00)[0-9A-F]{2})*+)00", "$100FF")
    return F.unhex(F.concat(digits, F.lit("0000"), F.lpad(F.hex(F.bitwise_not(seq)), 16, "0")))


@F.pandas_udf(_struct(key=T.BinaryType(), seq=T.LongType()))
def version_key_decode(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_composite(bytes(r)) for r in raw], columns=["key", "seq"])


def _swapped(digits: Column, width: int) -> Column:
    return F.concat(*[F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)])


def fixed32_encode(x: Column) -> Column:
    return F.unhex(_swapped(F.lpad(F.hex(x), 8, "0"), 4))


def fixed64_encode(x: Column) -> Column:
    return F.unhex(_swapped(F.lpad(F.hex(x), 16, "0"), 8))


def fixed32_decode(b: Column) -> Column:
    return F.conv(_swapped(F.hex(b), 4), 16, 10).cast("long")


def fixed64_decode(b: Column) -> Column:
    """Numbers under 2 ** 63, which all sequences are."""
    return F.conv(_swapped(F.hex(b), 8), 16, 10).cast("long")
