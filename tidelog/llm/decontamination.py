"""Benchmark decontamination: prefix-filtered set join of documents with item windows. DataFrame functions only.

A window is `size` consecutive words of an item (a shorter item is one window). Containment must be whole, so one
token is prefix enough: the window's rarest word by its count over all documents. Document words meet the windows
filed under them, positional and length bounds drop windows that would stick out of the document, and the words
around are compared with the window exactly. Only rows that hold a hit are shuffled, and one row for each document.

The windows are broadcast only while their number is under a checked bound; beyond it words and windows are joined by
shuffle and candidates meet their documents again.

Defined results: null or wordless texts have no words and no hits; wordless items have no windows; equal items each
count; a null item_id can hit but is not listed; rows that repeat are judged each; an empty table of either side
gives zero hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 10
#: Windows (rows of item, text and token; under 200 bytes each for common words) that may be broadcast.
BROADCAST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a text whose A-Z are not lower-cased yet; lower() of the parts gives the words asked for.
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def lowered(c: Column) -> Column:
    """A-Z lower-cased: the fast function on plain ASCII, letter by letter only on other strings with A-Z in them."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).when(c.rlike("[A-Z]"), F.translate(c, UPPER, LOWER)).otherwise(c)


def raw_words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(1))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (words joined by spaces), n (its words)."""
    w = items.select("item_id", raw_words("text").alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    at = w.select("item_id", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    return at.select("item_id", lowered(F.concat_ws(" ", F.slice("w", F.col("at"), F.col("n")))).alias("window"), "n").distinct()


def filed(found: DataFrame, docs: DataFrame, bounded: bool) -> DataFrame:
    """Every window with its rarest word (token) and that word's place (off, from 0)."""
    words = found.select("item_id", "window", "n", F.posexplode(F.split("window", " ")).alias("off", "token"))
    vocabulary = words.select("token").distinct()
    held = docs.select(F.explode(raw_words("text")).alias("word")).select(lowered(F.col("word")).alias("token"))
    counts = held.join(F.broadcast(vocabulary) if bounded else vocabulary, "token").groupBy("token").agg(F.count("*").alias("held"))
    rarest = words.join(cut(counts), "token", "left").groupBy("item_id", "window", "n").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "off", "token")).alias("best"))
    # a word that no document holds files a window that no document can hold
    return rarest.where("best.held > 0").select("item_id", "window", "n", "best.token", "best.off")


def _summed(matches: DataFrame, by: list[str]) -> DataFrame:
    """matches: start and stop (null: none), item_id, n_words; the union of the spans is summed per document."""
    spans = F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("hit"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["stop"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("hit"))
    return (
        matches.groupBy(*by)
        .agg(F.max("n_words").alias("n_words"), F.aggregate(spans, start, step)["hit"].alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", *[c for c in by if c != "doc_id"])
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every row of docs."""
    found = cut(windows(items, size))
    bounded = found.count() <= broadcast_windows
    index = filed(found, docs, bounded)
    if not bounded:
        return _joined(docs, index)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), raw_words("text").alias("w"))
    each = rows.select("doc_id", "_row", "w", F.posexplode_outer("w").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    first = F.col("pos") - F.col("off")
    inside = (F.col("word") == F.col("token")) & (first >= 0) & (first + F.col("n") <= F.size("w"))
    exact = lowered(F.concat_ws(" ", F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("n")))) == F.col("window")
    kept = F.col("window").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True))
    span = [F.when(F.col("window").isNotNull(), first).alias("start"), F.when(F.col("window").isNotNull(), first + F.col("n")).alias("stop")]
    matches = each.join(F.broadcast(cut(index)), inside & exact, "left").where(kept).select("doc_id", "_row", F.size("w").alias("n_words"), *span, "item_id")
    return _summed(matches, ["doc_id", "_row"]).drop("_row")


def _joined(docs: DataFrame, index: DataFrame) -> DataFrame:
    """With any number of windows: words and windows meet by a shuffle. Rows are told apart by their id and a hash of their
    text, which every evaluation gives alike; rows that repeat share a judgement and each get it."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), raw_words("text").alias("w"))
    index = cut(index)
    words = rows.select("doc_id", "_row", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
    first = F.col("pos") - F.col("off")
    near = words.withColumn("token", lowered(F.col("word"))).join(index, "token").where((first >= 0) & (first + F.col("n") <= F.col("size")))
    near = cut(near.select("doc_id", "_row", first.alias("first"), "n", "window", "item_id").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("_row") == F.col("at_row"))
    met = rows.join(near.withColumnsRenamed({"doc_id": "at_doc", "_row": "at_row"}), same)
    hits = met.where(lowered(F.concat_ws(" ", F.slice("w", F.col("first") + 1, F.col("n")))) == F.col("window"))
    hits = hits.select("doc_id", "_row", F.size("w").alias("n_words"), F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop"), "item_id")
    found = _summed(hits, ["doc_id", "_row"]).drop("n_words").withColumnsRenamed({"doc_id": "at_doc", "_row": "at_row"})
    out = rows.join(found, same, "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("items", none).alias("items"),
    )
