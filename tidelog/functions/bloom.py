"""Bloom filter hashing and sizes. 64-bit products wrap around, which the session's ANSI arithmetic forbids, so the hash
is an Arrow UDF over whole batches; all else is built in."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The filter's parameters, the FNV-1a basis and prime, two seeds, and the finaliser's shifts and factors.
PROBES = 7
BITS_PER_KEY = 10
LEAST_BITS = 64
MOST_BITS = 480 << 20
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FINAL = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))


def hash64(keys: list[bytes], seed: int) -> np.ndarray:
    """FNV-1a with a seed and a final avalanche, one byte position of all keys at a time."""
    h = np.full(len(keys), FNV_BASIS ^ seed, np.uint64)
    size = np.array([len(k) for k in keys], np.int64)
    if len(keys):
        grid = np.zeros((len(keys), int(size.max())), np.uint8)
        grid[np.arange(grid.shape[1]) < size[:, None]] = np.frombuffer(b"".join(keys), np.uint8)
        for i in range(grid.shape[1]):
            more = size > i
            h[more] = (h[more] ^ grid[more, i].astype(np.uint64)) * np.uint64(FNV_PRIME)
    for shift, factor in FINAL:
        h = h ^ (h >> np.uint64(shift))
        if factor:
            h = h * np.uint64(factor)
    return h


def positions(keys: list[bytes], bits: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """(keys, probes) bit numbers by double hashing."""
    one, two = hash64(keys, SEEDS[0]), hash64(keys, SEEDS[1]) | np.uint64(1)
    steps = np.arange(probes, dtype=np.uint64)
    return ((one[:, None] + steps * two[:, None]) % bits[:, None].astype(np.uint64)).astype(np.int64)


def bit_count(entries: Column) -> Column:
    return F.greatest(F.lit(LEAST_BITS), F.least(F.greatest(entries, F.lit(1)), F.lit(MOST_BITS // BITS_PER_KEY)) * BITS_PER_KEY).cast("long")


def _raw(keys) -> list[bytes]:
    return [k.encode() if isinstance(k, str) else bytes(k) for k in keys]


def build(entries: DataFrame) -> DataFrame:
    """file_no, bits, field: each file's filter as one binary of its bits, the least first. The size counts entries
    (versions), not distinct keys. A file is bounded by its target size and lies in one task; keys are hashed by batches of
    rows, whatever files these belong to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bits, field = None, 0, None
        done: list[tuple[int, int, bytes]] = []
        for f in frames:
            no, size, at = f["file_no"].to_numpy(), f["bits"].to_numpy(), positions(_raw(f["key"]), f["bits"].to_numpy())
            edges = [0, *(np.flatnonzero(no[1:] != no[:-1]) + 1).tolist(), len(no)] if len(no) else [0]
            for a, b in pairwise(edges):
                if field is None or no[a] != now:
                    if field is not None:
                        done.append((now, bits, np.packbits(field, bitorder="little").tobytes()))
                    now, bits = int(no[a]), int(size[a])
                    field = np.zeros(-(-bits // 8) * 8, np.uint8)
                field[at[a:b].ravel()] = 1
            if done:
                yield pd.DataFrame(done, columns=["file_no", "bits", "field"])
                done = []
        if field is not None:
            yield pd.DataFrame({"file_no": [now], "bits": [bits], "field": [np.packbits(field, bitorder="little").tobytes()]})

    counted = entries.groupBy(F.col("file_no").cast("long").alias("file_no"), "key").agg(F.count("*").alias("_n"))
    # the window leaves the rows of a file together
    sized = counted.withColumn("bits", bit_count(F.sum("_n").over(Window.partitionBy("file_no"))))
    return sized.select("file_no", "key", "bits").mapInPandas(run, "file_no long, bits long, field binary")


def probe(asked: DataFrame, filters: DataFrame) -> DataFrame:
    """file_no, probe, may_contain of the asked (file_no, key) pairs, such as the files whose range holds a key. Keys meet
    the filter of their file in one group, so a filter moves once."""

    def run(_: tuple, keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if held.empty or keys.empty:
            return pd.DataFrame({"file_no": keys["file_no"], "probe": keys["key"], "may_contain": False})
        set_bits = np.unpackbits(np.frombuffer(held["field"].iloc[0], np.uint8), bitorder="little")
        at = positions(_raw(keys["key"]), np.full(len(keys), int(held["bits"].iloc[0])))
        return pd.DataFrame({"file_no": keys["file_no"], "probe": keys["key"], "may_contain": set_bits[at].all(1)})

    pairs = asked.select("file_no", "key").distinct()
    return pairs.groupBy("file_no").cogroup(filters.groupBy("file_no")).applyInPandas(run, "file_no long, probe string, may_contain boolean")


@F.pandas_udf(T.ArrayType(T.LongType()))
def halves(key: pd.Series) -> pd.Series:
    """The PROBES hashes of a key before they are cut to a filter's size, each as its upper and lower 32 bits."""
    raw = _raw(key)
    one, two = hash64(raw, SEEDS[0]), hash64(raw, SEEDS[1]) | np.uint64(1)
    all_ = one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]
    return pd.Series(list(np.stack([all_ >> np.uint64(32), all_ & np.uint64(0xFFFFFFFF)], 2).reshape(len(raw), 2 * PROBES).astype(np.int64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def words(field: pd.Series) -> pd.Series:
    """A filter's bits as 64-bit numbers, the least first."""
    return pd.Series([np.frombuffer(bytes(x).ljust(-(-len(x) // 8) * 8, b"\0"), "<i8") for x in field])


def contains(halves: str, bits: str, fold: str, words: str) -> Column:
    """Whether a filter's words hold all of a key's bits; fold is 2^32 modulo bits. With at most MOST_BITS bits the upper
    half times fold stays under 2^63."""
    out = F.lit(True)
    for i in range(PROBES):
        at = (F.col(halves)[2 * i] * F.col(fold) + F.col(halves)[2 * i + 1]) % F.col(bits)
        word, bit = F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")
        out = out & (F.getbit(F.col(words)[word], bit) == 1)
    return out


def serialized_size(bits: Column) -> Column:
    """Header of 24 bytes, the bits and a checksum."""
    return (F.lit(28) + F.ceil(bits / 8)).cast("long")
