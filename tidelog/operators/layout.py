"""Files and levels: metadata, scores, the compaction picker, overlap, greedy file boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LEVELS
from .mvcc import byte_size
from .running import chained, drawn_keys, predecessors, prefix_sums, running, stretch_of

# Defaults of the compaction options.
L0_TRIGGER = 4
L1_BYTES = 10 << 20
MULTIPLIER = 10
TARGET_BYTES = 2 << 20
TIERED_TRIGGER = 4
RECORD_HEADER = 17
#: Keys of a stretch of the order; ranges meet stretches before they meet keys.
STRETCH = 512


def record_size() -> Column:
    return byte_size("key", "value") + RECORD_HEADER


def file_metadata(entries: DataFrame, by: tuple[str, ...] = ("file_no",)) -> DataFrame:
    """A row a file: entry_count, min_key, max_key, min_seq, max_seq, data_bytes."""
    return entries.groupBy(*by).agg(
        F.count("*").alias("entry_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum(record_size()).alias("data_bytes")
    )


def level_budget(level: Column, l1_bytes: int = L1_BYTES, multiplier: int = MULTIPLIER) -> Column:
    return F.lit(float(l1_bytes)) * F.pow(F.lit(float(multiplier)), level - 1)


def level_scores(files: DataFrame, size: str = "file_size", trigger: int = L0_TRIGGER, l1_bytes: int = L1_BYTES, multiplier: int = MULTIPLIER) -> DataFrame:
    """level, files, bytes, score: level 0 by its number of files, deeper ones by their bytes over the budget."""
    sums = files.groupBy("level").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("files") / trigger).otherwise(F.col("bytes") / level_budget(F.col("level"), l1_bytes, multiplier))
    return sums.withColumn("score", score.cast("double"))


def pick(files: DataFrame, pointers: dict[int, str] | None = None, size: str = "file_size", **options) -> DataFrame:
    """level, file_no, role (input or next_input) of the next compaction; no rows if every level is within its budget.

    The level with the greatest score of at least 1 (the deeper on ties, never the last); level 0 gives all its
    files, others the first past the level's pointer or else the first; and the next level's files that overlap."""
    worst = level_scores(files, size, **options).where((F.col("score") >= 1) & (F.col("level") < LEVELS - 1)).orderBy(F.desc("score"), F.desc("level")).limit(1).select("level")
    chosen = files.join(F.broadcast(worst), "level")
    pointer = F.lit(None).cast("string")
    for level, key in (pointers or {}).items():
        pointer = F.when(F.col("level") == level, F.lit(key)).otherwise(pointer)
    turn = F.struct((F.col("min_key") <= F.coalesce(pointer, F.lit(""))).alias("past"), "min_key", "file_no")
    first = chosen.where("level > 0").agg(F.min(turn).alias("t")).select("t.file_no")
    inputs = chosen.where("level = 0").unionByName(chosen.where("level > 0").join(F.broadcast(first), "file_no", "left_semi").select(chosen.columns))
    span = inputs.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"), F.min("level").alias("from"))
    below = files.join(F.broadcast(span), (F.col("level") == F.col("from") + 1) & (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))).select("level", "file_no", F.lit("next_input").alias("role"))
    return inputs.select("level", "file_no", F.lit("input").alias("role")).unionByName(below)


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file_a, file_b) of files whose key ranges meet; both are file metadata."""
    x, y = a.select(F.col("file_no").alias("file_a"), F.col("min_key").alias("a0"), F.col("max_key").alias("a1")), b.select(F.col("file_no").alias("file_b"), F.col("min_key").alias("b0"), F.col("max_key").alias("b1"))
    return x.join(y, (F.col("a1") >= F.col("b0")) & (F.col("a0") <= F.col("b1"))).select("file_a", "file_b")


def held(keys: DataFrame, ranges: DataFrame, keep: list[str], stretch: int = STRETCH) -> DataFrame:
    """keys with the `keep` columns of every range that holds them: min_key to max_key, and before `until`, if that is a
    column and not null. Ranges may overlap, so this makes a row for each range and key inside.

    Keys are dealt to groups of the order, sorted and cut into stretches. A range goes to the groups that it reaches and is
    compared there with the ends of stretches, so the work goes with the rows that come out, and only those of the two
    stretches at a range's ends are looked at in vain. Neither keys nor their pairs with ranges move again."""
    tasks = 8 * keys.sparkSession.sparkContext.defaultParallelism
    keys = keys.where("key is not null")
    n = keys.count()
    # some groups a task, which even out: more ranges hold some keys than others
    groups = min(4 * tasks, n // stretch)
    group = stretch_of(drawn_keys(keys, "key", n, groups) if groups > 1 else [])
    dealt = keys.withColumn("_g", group(F.col("key"))).repartition(tasks, "_g").sortWithinPartitions("_g", "key").withColumn("_s", F.floor(F.monotonically_increasing_id() / stretch))
    row = F.struct(*keys.columns) if len(keys.columns) > 1 else F.col("key")
    stretches = dealt.groupBy("_g", "_s").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.collect_list(row).alias("_rows"))
    bounds = ["min_key", "max_key", *(["until"] if "until" in ranges.columns else [])]

    def before(c: Column) -> Column:
        return (c <= F.col("max_key")) & (F.col("until").isNull() | (c < F.col("until")) if "until" in bounds else F.lit(True))

    last = F.least("max_key", "until") if "until" in bounds else F.col("max_key")
    some = ranges.select(*bounds, *keep).where(before(F.col("min_key"))).withColumns({"_a": group(F.col("min_key")), "_z": group(last)})
    reached = some.select(*bounds, *keep, F.explode(F.sequence("_a", "_z")).alias("_h")).repartition(tasks, "_h")
    # stretch by stretch, so that a writer's dictionary holds the keys of few
    met = stretches.hint("merge").join(reached, (F.col("_h") == F.col("_g")) & before(F.col("_lo")) & (F.col("_hi") >= F.col("min_key")))
    whole = (F.col("_lo") >= F.col("min_key")) & before(F.col("_hi"))
    one = len(keys.columns) == 1
    inside = F.filter("_rows", lambda r: ((r if one else r["key"]) >= F.col("min_key")) & before(r if one else r["key"]))
    # rows are looked at before they are unfolded, and only at a range's ends
    rows = met.select(*keep, F.when(whole, F.col("_rows")).otherwise(inside).alias("_in")).select(*keep, F.explode("_in").alias("_row"))
    return rows.select(*([F.col("_row").alias("key")] if one else ["_row.*"]), *keep)


def candidates(keys: DataFrame, files: DataFrame, disjoint: bool = False) -> DataFrame:
    """(key, file_no) of the files whose range may hold a key; unknown bounds may hold any. On a level of disjoint files a
    key meets the one file that begins last before it; files that overlap meet stretches of sorted keys."""
    known = files.where("min_key is not null and max_key is not null")
    if disjoint:
        found = predecessors(keys.select("key"), known.withColumnRenamed("min_key", "key"), "key", ["file_no", "max_key"]).where("_mark.max_key >= key").select("key", F.col("_mark.file_no").alias("file_no"))
    else:
        found = held(keys.select("key"), known, ["file_no"])
    low, high = F.coalesce(F.col("min_key") <= F.col("key"), F.lit(True)), F.coalesce(F.col("max_key") >= F.col("key"), F.lit(True))
    unknown = files.where("min_key is null or max_key is null").select("file_no", "min_key", "max_key")
    return found.unionByName(keys.join(unknown, low & high).select("key", "file_no"))


def probed(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file_no) over all levels: level 0 overlaps, deeper ones are disjoint level by level. files: with level."""
    out = candidates(keys, files.where("level = 0"))
    for level in sorted(r[0] for r in files.where(F.col("level").between(1, LEVELS - 1)).select("level").distinct().collect()):
        out = out.unionByName(candidates(keys, files.where(F.col("level") == level), disjoint=True))
    return out


def overlapping_apart(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of level 0 whose bounds are known and whose number no other file has, and all others."""
    plain = (F.col("level") == 0) & F.col("min_key").isNotNull() & F.col("max_key").isNotNull() & (F.col("_n") == 1)
    counted = files.withColumn("_n", F.count("*").over(Window.partitionBy("file_no")))
    return counted.where(plain).drop("_n"), counted.where(~plain).drop("_n")


def disjoint_violations(files: DataFrame) -> DataFrame:
    """level, violations: neighbours by key that overlap, on levels from 1."""
    before = F.lag("max_key").over(Window.partitionBy("level").orderBy("min_key", "file_no"))
    rows = files.where("level > 0").withColumn("_before", before)
    return rows.groupBy("level").agg(F.count_if(F.col("_before") >= F.col("min_key")).alias("violations"))


def edit(current: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The next list of files: (current - removed) + added."""
    return current.join(removed.select("file_no"), "file_no", "left_anti").unionByName(added)


def reconcile(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """file_no, status: LIVE, ORPHAN (found, not listed), MISSING (listed, not found), DUPLICATE (listed twice)."""
    listed = manifest.groupBy("file_no").agg(F.count("*").alias("n"))
    both = listed.join(found.select("file_no").distinct().withColumn("f", F.lit(1)), "file_no", "full")
    status = F.when(F.col("n") > 1, "DUPLICATE").when(F.col("n").isNull(), "ORPHAN").when(F.col("f").isNull(), "MISSING").otherwise("LIVE")
    return both.select("file_no", status.alias("status"))


def record_layout(entries: DataFrame) -> DataFrame:
    """file_no, key, seq, offset, size of records laid end to end in canonical order."""
    size = record_size()
    before = Window.partitionBy("file_no").orderBy("key", F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    return entries.select("file_no", "key", "seq", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"), size.alias("size"))


def rotate(log: DataFrame, limit: int) -> DataFrame:
    """Memtables of one store: batch_id, entries, bytes, last_seq. A write first closes the active table if that is not empty
    and has reached the limit."""
    sized = log.select("seq", (byte_size("key", "value") + 9).alias("b"))
    placed = running(sized, "seq", inclusive=False, _before=("sum", F.col("b")))
    return chained(placed, "_before", limit).groupBy(F.col("_no").alias("batch_id")).agg(F.count("*").alias("entries"), F.sum("b").alias("bytes"), F.max("seq").alias("last_seq"))


def roll(entries: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """Output files of one merge: file_no, min_key, max_key, bytes. A file closes at the first new key after it has reached
    the target; a key's versions never part."""
    keys = entries.groupBy("key").agg(F.sum(record_size()).alias("b"))
    placed = prefix_sums(keys, "key", "b", "_before")
    return chained(placed, "_before", target).groupBy(F.col("_no").alias("file_no")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum("b").alias("bytes"))


def gauges(files: DataFrame, size: str = "data_bytes") -> DataFrame:
    """One row: tables and bytes over all levels."""
    return files.agg(F.count("*").alias("tables"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
