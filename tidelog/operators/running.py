"""Running sums, minima and ranks without a single-partition window: blocks of the order first, then rows within a block.

Every function takes rows with a whole-number order column; a block is `block` values of it wide, so its rows fit a
task, and only one row for each block meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16
#: Stretches of an order that predecessors are searched in, and that a chain of boundaries is walked in, side by side.
STRETCHES = 256
SEGMENTS = 64


def running(df: DataFrame, order: str, block: int = BLOCK, inclusive: bool = True, **columns: tuple[str, Column]) -> DataFrame:
    """df with running aggregates: name=(kind, expression), kind in sum, min, max; exclusive ones start from null (sum: 0)."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    dealt = df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    for name, (_, e) in columns.items():
        dealt = dealt.withColumn(f"_v_{name}", e)
    parts = dealt.groupBy("_block").agg(*[fold[k](f"_v_{n}").alias(n) for n, (k, _) in columns.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each block
    parts = parts.select("_block", *[fold[k](n).over(before).alias(f"_b_{n}") for n, (k, _) in columns.items()])
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = dealt.join(parts, "_block")
    for name, (kind, _) in columns.items():
        here, carried = fold[kind](f"_v_{name}").over(inner), F.col(f"_b_{name}")
        if kind == "sum":
            both = F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        else:
            both = (F.least if kind == "min" else F.greatest)(here, carried)
        out = out.withColumn(name, both)
    return out.select(*df.columns, *columns)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 over (group, order): groups are counted, their offsets summed, rows numbered inside."""
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    sizes = df.groupBy(*named).agg(F.count("*").alias("_n"))
    at = [f"_g{i}" for i in range(len(group))]
    offsets = sizes.select(*at, F.coalesce(F.sum("_n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # a null group is a group
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group, at, strict=True)])
    return df.join(offsets, same).withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*group).orderBy(*order))).select(*df.columns, name)


def prefix_sums(df: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """df with the sum of `size` over all rows of smaller keys (strings, distinct). Keys are summed within groups of their
    first bytes, so only a row a group meets in one place."""
    grouped = df.withColumn("_head", F.substring(key, 1, 7))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy("_head").agg(F.sum(size).alias("_s")).select("_head", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_head").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(offsets, "_head").withColumn(name, F.col("_before") + F.coalesce(F.sum(size).over(inner), F.lit(0))).select(*df.columns, name)


def drawn_keys(df: DataFrame, key: str, n: int, parts: int) -> list[bytes]:
    """At most `parts` keys, in byte order, that cut the order into stretches of about equal numbers of keys. They are drawn
    by hash from n rows, so that some thousand keys at most reach the driver."""
    every = max(1, n // (16 * parts))
    drawn = sorted(_bytes(r[0]) for r in df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).where(F.col(key).isNotNull()).distinct().collect())
    return drawn[:: max(1, -(-len(drawn) // parts))]


def stretch_of(cuts: list[bytes]):
    """A function of a key column: the number of the stretch between `cuts` that the key lies in."""

    @F.pandas_udf(T.IntegerType())
    def stretch(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, object), np.array([b"" if x is None else _bytes(x) for x in k], object), "right").astype("int32"))

    return stretch if cuts else lambda k: F.lit(0)


def _bytes(key) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def predecessors(points: DataFrame, marks: DataFrame, key: str, value: list[str], stretches: int = STRETCHES) -> DataFrame:
    """points with _mark, a struct of `value` of the last mark whose key (a string) is not over the point's; null if none.

    Marks are sampled by hash for at most some thousand keys that cut the order into stretches; points and marks of a
    stretch are swept together, and the last mark of the stretches before is carried in. Of marks with one key the
    greatest value counts."""
    marks = marks.select(F.col(key).alias("_key"), F.struct(*[F.col(c).alias(c) for c in value]).alias("_held"))
    n = marks.count()
    cuts = drawn_keys(marks, "_key", n, stretches) if n > 64 * stretches else []
    stretch = stretch_of(cuts)

    dealt = lambda df, k: df.withColumn("_at", stretch(F.col(k)))
    asked, held = dealt(points, key), dealt(marks, "_key")
    if not cuts:
        carried = None
    else:
        # a row a stretch
        lasts = held.groupBy("_at").agg(F.max(F.struct("_key", "_held")).alias("_last")).select("_at", F.col("_last._held").alias("_last"))
        whole = asked.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_at"))
        carried = whole.join(lasts, "_at", "left").select("_at", F.last("_last", ignorenulls=True).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    both = asked.withColumns({"_held": F.lit(None).cast(held.schema["_held"].dataType), "_key": F.col(key), "_kind": F.lit(1)}).unionByName(held.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("_at").orderBy("_key", "_kind", "_held").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_held", ignorenulls=True).over(sweep)).where("_kind = 1")
    if carried is None:
        return found.select(*points.columns, F.col("_seen").alias("_mark"))
    return found.join(F.broadcast(carried), "_at").select(*points.columns, F.coalesce("_seen", "_carried").alias("_mark"))


def chained(df: DataFrame, start: str, limit: int, segments: int = SEGMENTS) -> DataFrame:
    """df with _no, the number (from 1) of the greedy stretch that a row is in: a stretch begins at the first row, and the
    next at the first row whose `start` (exclusive running sums, distinct) is at least `limit` over the beginning.

    Each boundary depends on the one before it, so segments of the order are walked side by side from every row that
    may come first in them; where walks from there lead is one function a segment. The driver chains these (at most as
    many numbers as rows over one limit, for each segment), and a second pass numbers rows from the known beginnings.
    A walk holds one number for each possible beginning, whatever the segment's size."""
    top = df.agg(F.max(start)).first()[0]
    if top is None:
        return df.withColumn("_no", F.lit(1).cast("long"))
    wide = max(2 * limit, -(-(top + 1) // segments))
    rows = df.withColumn("_seg", F.floor(F.col(start) / wide).cast("long"))
    gaps = rows.groupBy("_seg").agg(F.min(start).alias("a"), F.max(start).alias("b")).orderBy("_seg").collect()
    ordered = rows.select("_seg", F.col(start).alias("_p")).repartition("_seg").sortWithinPartitions("_seg", "_p")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, due, steps = None, None, None, None

        def out() -> pd.DataFrame:
            change = np.r_[True, (due[1:] != due[:-1]) | (steps[1:] != steps[:-1])]
            change = np.flatnonzero(np.r_[change[1:], True])  # a walk's result holds for all beginnings up to here
            return pd.DataFrame({"seg": now, "upto": first[change], "due": due[change], "steps": steps[change]})

        for f in frames:
            for seg, part in f.groupby("_seg", sort=True):
                p = part["_p"].to_numpy()
                if seg != now:
                    if now is not None:
                        yield out()
                    now, first, due, steps = seg, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    bound, early = max(int(p[0]), seg * wide) + limit, True
                # a stretch that is open when the segment begins ends at `bound` or, after a gap, at the first row over it
                reached = int(np.searchsorted(p, bound)) if early else 0
                more = p[: reached + 1] if early else p[:0]
                early = early and reached >= len(p)
                # beginnings that have come before walk on over these rows; those rows that may be beginnings start here
                while (mask := due <= p[-1]).any():
                    due[mask] = p[np.searchsorted(p, due[mask])] + limit
                    steps[mask] += 1
                if len(more):
                    own_due, own_steps = more + limit, np.ones(len(more), np.int64)
                    while (mask := own_due <= p[-1]).any():
                        own_due[mask] = p[np.searchsorted(p, own_due[mask])] + limit
                        own_steps[mask] += 1
                    first, due, steps = np.r_[first, more], np.r_[due, own_due], np.r_[steps, own_steps]
        if now is not None:
            yield out()

    runs: dict[int, list[tuple[int, int, int]]] = {}
    for r in ordered.mapInPandas(walk, "seg long, upto long, due long, steps long").collect():
        runs.setdefault(r["seg"], []).append((r["upto"], r["due"], r["steps"]))
    due, no, begins = 0, 0, []
    for r in gaps:
        begins.append((r["_seg"], due, no))
        if r["b"] >= due:
            _, due, steps = next(x for x in sorted(runs[r["_seg"]]) if x[0] >= due)
            no += steps
    known = {seg: (d, n) for seg, d, n in begins}
    schema = T.StructType([*rows.schema.fields, T.StructField("_no", T.LongType())])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for f in frames:
            parts = []
            for seg, part in f.groupby("_seg", sort=True):
                if seg != now:
                    now, (due, no) = seg, known[seg]
                p = part[start].to_numpy()
                edges, at = [], due
                while at <= p[-1]:
                    i = int(np.searchsorted(p, at))
                    edges.append(i)
                    at = int(p[i]) + limit
                parts.append(part.assign(_no=no + np.searchsorted(edges, np.arange(len(p)), "right")))
                due, no = at, no + len(edges)
            yield pd.concat(parts)

    return rows.repartition("_seg").sortWithinPartitions("_seg", start).mapInPandas(number, schema).drop("_seg")


def ntile_keys(keys: DataFrame, key: str, tiles: int, name: str) -> DataFrame:
    """ntile(tiles) over distinct keys in byte order. Keys are numbered within groups of their first bytes."""
    grouped = keys.withColumn("_head", F.substring(key, 1, 7))
    ranked = numbered(grouped, ["_head"], [key], "_rank").drop("_head")
    n = F.broadcast(keys.agg(F.count("*").alias("_n")))
    r, size, rest = F.col("_rank") - 1, F.floor(F.col("_n") / tiles), F.col("_n") % tiles
    wide = rest * (size + 1)
    tile = F.when(r < wide, F.floor(r / (size + 1))).otherwise(rest + F.floor((r - wide) / F.greatest(size, F.lit(1)))) + 1
    return ranked.crossJoin(n).select(key, tile.cast("int").alias(name))
