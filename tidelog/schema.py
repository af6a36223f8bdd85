"""Types of the change log and its files."""

from __future__ import annotations

from pyspark.sql import types as T

# Entry types, command types and limits.
PUT, DELETE, NOOP = 1, 2, 3
MAX_KEY_BYTES = 1024
MAX_VALUE_BYTES = 1 << 20
MAX_REQUEST_ID_BYTES = 128
MAX_SEQUENCE = (1 << 63) - 1
LEVELS = 7

#: One version of a key; key and value are binary, or strings where people write them.
ENTRY = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("type", T.ByteType(), False), T.StructField("value", T.BinaryType(), False)])
WAL_RECORD = "seq long, type tinyint, version long, key binary, value binary, offset long, frame_len long"
FILES = "file_no long, level int, entry_count long, min_key string, max_key string, min_seq long, max_seq long, file_size long"


class LogError(ValueError):
    """A log, table or manifest breaks one of its rules."""
