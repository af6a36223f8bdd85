"""Best-fit packing by linear grouping.

Only the histogram of piece lengths (at most `capacity` numbers) decides the plan. Large lengths are rounded up
within groups of equal cardinality; configurations over the few group sizes are built from the largest size down, each
the fullest sum that the sizes left allow; actual lengths then take the slots of their group; small lengths
go best-fit into what room is left. The plan is a table of slots (length, ranks, sequence, offset), whose size
depends on the capacity alone; pieces find their slot by their rank within their length, so nothing but the
histogram reaches the driver. Tasks number the pieces of each length as they cut them; sums of the tasks' counts turn
that into ranks, so no length, however common, meets in one place.

Defined results: null text is empty, an empty document is one piece of one id (the separator); rows that repeat
are packed each time; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut
from .tokens import encoder, vocabulary

CAPACITY = 2048
SEPARATOR = 0
#: Equal-cardinality groups of large lengths; lengths up to capacity / SMALL are small.
GROUPS = 512
SMALL = 3

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_task", pa.int32()), ("_nth", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every document's ids and the separator, cut into pieces of `capacity` from the end; the first may be shorter. With
    the task that cut a piece and the number of pieces of its length that the task had cut before."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get().partitionId()
        cut_before: Counter[int] = Counter()
        for batch in batches:
            out: list[list[int]] = [[] for _ in _PIECES]
            for i, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), SEPARATOR], "<u4")
                first = len(ids) % capacity or capacity
                for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[a : a + capacity] if a else ids[:first]
                    n = len(part)
                    for col, x in zip(out, (i, k, a, n, zlib.crc32(part.tobytes()), task, cut_before[n]), strict=True):
                        col.append(x)
                    cut_before[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long")


class _Runs:
    """Bins that hold the same lengths, kept as (number of bins, first bin, tokens used)."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.slots = capacity, 0, []
        self.taken: dict[int, int] = {}
        self.by_room: dict[int, list[tuple[int, int]]] = {}

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def place(self, length: int, first: int, n: int, per_bin: int, offset: int) -> None:
        """The next n * per_bin pieces of this length go to bins first.. , per_bin to each, from this offset on."""
        rank = self.taken.get(length, 0)
        self.taken[length] = rank + n * per_bin
        self.slots.append((length, rank, rank + n * per_bin, first, per_bin, offset))

    def leave(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.by_room.setdefault(room, []).append((first, n))


def _fullest(room: int, sizes: list[int], left: dict[int, int]) -> dict[int, int]:
    """The sizes (largest first, as many as are left) whose sum is the largest up to room."""
    reach, steps = 1, []
    keep = (1 << (room + 1)) - 1
    for s in sizes:
        for _ in range(min(left[s], room // s)):
            wider = (reach | reach << s) & keep
            if wider == reach:
                break
            steps.append((s, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for s, before in reversed(steps):
        if not before >> at & 1:
            chosen[s] = chosen.get(s, 0) + 1
            at -= s
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, first sequence, pieces a sequence, offset) for all pieces."""
    small = capacity // SMALL if small is None else small
    runs = _Runs(capacity)
    large = sorted((x for x in counts if small < x), reverse=True)
    total = sum(counts[x] for x in large)
    grouped: list[list[int]] = []
    seen = number = 0
    for x in large:
        if not grouped or x * 2 <= capacity < grouped[-1][0] * 2 or seen * groups // total > number:
            grouped.append([])
            number = seen * groups // total
        grouped[-1].append(x)
        seen += counts[x]
    lengths_of = {g[0]: g for g in grouped}
    left = {g[0]: sum(counts[x] for x in g) for g in grouped}
    queue = {g[0]: [[x, counts[x]] for x in g] for g in grouped}

    def fill(config: list[int], times: int) -> None:
        """Actual lengths in place of the rounded ones: split into stretches over which every slot keeps its length."""
        first = runs.open(times)
        stretches = []
        for size in config:
            now, need = [], times
            while need:
                x, n = queue[size][0]
                take = min(n, need)
                now.append((x, take))
                need -= take
                queue[size][0][1] -= take
                if not queue[size][0][1]:
                    queue[size].pop(0)
            stretches.append(now)
        marks = sorted({0, times} | {int(m) for now in stretches for m in np.cumsum([n for _, n in now])})
        for a, b in zip(marks, marks[1:], strict=False):
            used = 0
            for now in stretches:
                at = 0
                for x, n in now:
                    if at <= a < at + n:
                        runs.place(x, first + a, b - a, 1, used)
                        used += x
                        break
                    at += n
            runs.leave(capacity - used, first + a, b - a)

    for size in lengths_of:
        while left[size]:
            left[size] -= 1
            others = [s for s in lengths_of if s <= size and s <= capacity - size and left[s]]
            more = _fullest(capacity - size, others, left) if others else {}
            left[size] += 1
            need = dict(more)
            need[size] = need.get(size, 0) + 1
            times = min(left[s] // k for s, k in need.items())
            for s, k in need.items():
                left[s] -= k * times
            fill([s for s, k in sorted(need.items(), reverse=True) for _ in range(k)], times)

    for x in sorted((x for x in counts if x <= small), reverse=True):
        n = counts[x]
        while n:
            room = min((r for r in runs.by_room if r >= x), default=0)
            if room:
                first, bins = runs.by_room[room].pop()
                if not runs.by_room[room]:
                    del runs.by_room[room]
            else:
                room = capacity
                bins = -(-n // (capacity // x))
                first = runs.open(bins)
            each = room // x
            whole = min(bins, n // each)
            if whole:
                runs.place(x, first, whole, each, capacity - room)
                runs.leave(room - each * x, first, whole)
                n -= whole * each
            if whole < bins:
                if 0 < n < each:
                    runs.place(x, first + whole, 1, n, capacity - room)
                    runs.leave(room - n * x, first + whole, 1)
                    whole, n = whole + 1, 0
                runs.leave(room, first + whole, bins - whole)
    return runs.slots


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces with sequence_id and offset; it is read twice, so pass one that is materialised."""
    spark = cut_pieces.sparkSession
    counts = cut(cut_pieces.groupBy("length", "_task").agg(F.count("*").alias("n")))
    before = counts.select("length", "_task", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # at most `capacity` rows
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(hist, capacity) or [(0, 0, 0, 0, 1, 0)], "length long, _from long, _to long, _first long, _each long, _base long")
    ranked = cut_pieces.join(before, ["length", "_task"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    k = F.col("_rank") - F.col("_from")
    return (
        # the slots' number is bounded by the capacity, not by the documents
        ranked.join(F.broadcast(slots), "length")
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.floor(k / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_base") + (k % F.col("_each")) * F.col("length")).cast("long").alias("offset"))
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(cut(pieces(docs, capacity, path)), capacity)
