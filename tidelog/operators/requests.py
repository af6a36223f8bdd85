"""Validation of requests and commands: a code and a message for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, MAX_KEY_BYTES, MAX_REQUEST_ID_BYTES, MAX_VALUE_BYTES, NOOP, PUT

# Wire codes.
OK, INVALID = 0, 1


def _first(*rules: tuple[Column, Column | str]) -> Column:
    out = F
    for bad, message in rules:
        out = out.when(bad, message if isinstance(message, Column) else F.lit(message))
    return out.otherwise(F.lit(""))


def _over(column: str, most: int) -> Column:
    return F.concat(F.lit(f"{column} exceeds {most} bytes (got "), F.octet_length(column), F.lit(")"))


def request_message(kind: str = "op") -> Column:
    """'' if the request may go on. Only a PUT's value is looked at."""
    return _first(
        (F.octet_length("request_id") > MAX_REQUEST_ID_BYTES, f"request_id exceeds {MAX_REQUEST_ID_BYTES} bytes"),
        (F.octet_length("key") == 0, "key must not be empty"),
        (F.octet_length("key") > MAX_KEY_BYTES, _over("key", MAX_KEY_BYTES)),
        ((F.col(kind) == "PUT") & (F.octet_length("value") > MAX_VALUE_BYTES), _over("value", MAX_VALUE_BYTES)),
    )


def command_message() -> Column:
    size = {c: F.octet_length(c) for c in ("key", "value", "request_id")}
    noop = F.col("cmd") == NOOP
    return _first(
        (noop & (size["key"] + size["value"] + size["request_id"] > 0), "no-op command must not carry fields"),
        (noop, ""),
        (~F.col("cmd").isin(PUT, DELETE), "unknown command type"),
        (size["key"] == 0, "key must not be empty"),
        (size["key"] > MAX_KEY_BYTES, f"key exceeds {MAX_KEY_BYTES} bytes"),
        (size["value"] > MAX_VALUE_BYTES, f"value exceeds {MAX_VALUE_BYTES} bytes"),
        ((F.col("cmd") == DELETE) & (size["value"] > 0), "delete command must not carry a value"),
        (size["request_id"] > MAX_REQUEST_ID_BYTES, f"request_id exceeds {MAX_REQUEST_ID_BYTES} bytes"),
    )


def validated(rows: DataFrame, message: Column) -> DataFrame:
    """rows with code and message."""
    out = rows.withColumn("message", message)
    return out.withColumn("code", F.when(F.col("message") == "", OK).otherwise(INVALID))


def split_valid(rows: DataFrame, message: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with code and message)."""
    out = validated(rows, message)
    return out.where(F.col("code") == OK).drop("code", "message"), out.where(F.col("code") != OK)
