"""MinHash near-duplicates by bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed once; it keeps its size, a digest of the whole set and its K least
   values (the sketch). Documents with equal sets form a class, and only classes go on.
2. Inverted lists of retained values: of a pair with Jaccard j, each of the union's K least values is in both with
   chance j, so at 0.8 no value in common has chance 0.2 ** 32. Lists up to LIST classes give their pairs and the
   number of lists that a pair shares; a pair needs as many as its unfrequented values less SLACK (of 32 values at
   0.8, over 20 differ once in 10 ** 7), or, if one set is whole in its sketch, less what they can differ by at most.
3. Values in longer lists are frequent. Classes with more than SLACK other values are found by those. For the rest
   ("dense" classes: little but frequent values), each of their long lists links its classes with two leaders: the class
   of the most frequent values, which is what near copies were made from, and the least. Dense classes that still share
   a frequent value with another component are joined exactly, on whole sets: only values that several components
   hold count, a class with too few of them is done, and the others need one in common among their rarest, as many as
   they can miss and one more. A class with a fifth of its own values never meets anybody so, however long the list.
   Short lists of these give pairs; long ones are compared in blocks of bounded size, between classes of different
   components only, on sets up to WIDE values and on as many of larger ones (five deviations under what a pair at
   the threshold shows; all that passes is verified).
4. Union sketches estimate the Jaccard of candidates and drop those under FLOOR; the rest is verified on whole sets:
   first the best candidate of each class, then, once components are known, what would still join two.

Defined results: null doc_ids are returned, linked with nothing (component_id null, kept false); null, empty and
wordless texts have empty sets and are linked with nothing; rows that repeat a doc_id are judged each by its text;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, cut, text_chunks
from .components import components
from .words import mixed, words

SHINGLE = 4
K = 32
LIST = 32
SLACK = 20
FLOOR = 0.4
#: Rows of a block of a long list.
BLOCK = 512
#: Values by which the classes of a block are compared.
WIDE = 1024
#: Ids (8 bytes each) that may be broadcast to pick the texts to verify.
BROADCAST_IDS = 1_000_000


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    _, _, at, h = words(flat, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(at, np.arange(n + 1))
    grams = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        grams = mixed(grams + h[k : k + len(grams)] + np.uint64(k + 1))
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mixed(whole + h[k : k + 1] + np.uint64(k - a + 1))
            yield mixed(whole + np.uint64(b - a))
        else:
            yield grams[:0]


def _digest(s: np.ndarray) -> tuple[int, int]:
    two = (s.sum(dtype=np.uint64), mixed(s + np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))
    return tuple(int(mixed(np.array([x + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) for x in two)


def sketches(docs: DataFrame, size: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), sketch (its k least values, ascending as unsigned numbers moved to signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, low = [], [], [], []
            for _, _, flat, offsets in text_chunks(batch):
                for s in shingle_sets(flat, offsets, size):
                    n.append(len(s))
                    x, y = _digest(s)
                    d1.append(x)
                    d2.append(y)
                    low.append((s[:k] ^ np.uint64(1 << 63)).view(np.int64))
            ends = np.cumsum([0, *map(len, low)])
            values = pa.array(np.concatenate(low) if low else np.zeros(0, np.int64))
            arrays = [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "d1", "d2", "sketch"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """x (class) and its whole set as sorted 8-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, offsets in text_chunks(batch):
                sets = list(shingle_sets(flat, offsets, size))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["x", "shingles"])

    return docs.select("text").mapInArrow(run, "x long, shingles binary")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = column(batch, "a"), column(batch, "b"), []
            for sa, sb in zip(column(batch, "sa"), column(batch, "sb"), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left = pairs.join(sets.select(F.col("x").alias("a"), F.col("shingles").alias("sa")), "a")
    return left.join(sets.select(F.col("x").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _similar_sizes(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, est of the distinct pairs whose union sketch says at least FLOOR."""
    sk = classes.select("x", "n", "sketch")
    both = pairs.select("a", "b").distinct()
    both = both.join(sk.toDF("a", "na", "sa"), "a").join(sk.toDF("b", "nb", "sb"), "b").where(_similar_sizes(percent))
    union = F.array_sort(F.array_union("sa", "sb"))
    # a sketch shorter than K is the whole set, and so is the union of two
    union = F.when((F.col("na") <= K) & (F.col("nb") <= K), union).otherwise(F.slice(union, 1, K))
    both = both.withColumn("u", union)
    est = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) / F.size("u")
    return both.select("a", "b", est.alias("est")).where(F.col("est") >= FLOOR)


def close_pairs(n: np.ndarray, component: np.ndarray, values: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that may reach `percent`, by counts of common values: exact where both sets are
    whole, else at a floor five deviations under the estimate that such pairs have. Frequent values are counted by
    matrix products, others list by list; no row of the largest component meets another one of it. Of exact pairs
    only those come back that join what others have not joined, so there are fewer than rows."""
    names, counts = np.unique(component, return_counts=True)
    left = np.flatnonzero(component != names[counts.argmax()])
    at = np.full(len(n), -1)
    at[left] = np.arange(len(left))
    of = np.repeat(np.arange(len(n)), [len(v) for v in values])
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    cuts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
    size = np.diff(cuts)
    shared = np.zeros((len(left), len(n)), np.float32)
    wide = np.flatnonzero(size > 48)
    for part in (wide[i : i + 2048] for i in range(0, len(wide), 2048)):
        has = np.zeros((len(n), len(part)), np.float32)
        for k, w in enumerate(part):
            has[of[cuts[w] : cuts[w + 1]], k] = 1
        shared += has[left] @ has.T
    for w in np.flatnonzero((size > 1) & (size <= 48)):
        rows = of[cuts[w] : cuts[w + 1]]
        mine = at[rows]
        shared[np.ix_(mine[mine >= 0], rows)] += 1
    a, b = n[left][:, None], n[None]
    whole = (a <= WIDE) & (b <= WIDE)
    enough = np.where(whole, 100 * shared >= percent * (a + b - shared), shared >= (percent / 100 - 5 * (0.25 / WIDE) ** 0.5) * np.minimum(np.minimum(a, b), WIDE))
    i, j = np.nonzero(enough & (component[left][:, None] != component[None]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent))
    known, i = whole[i, j], left[i]
    names, root = np.unique(component, return_inverse=True)
    root, of, joins = np.arange(len(names)).tolist(), root.tolist(), ~known
    for k in np.flatnonzero(known).tolist():
        x, y = of[i[k]], of[j[k]]
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            joins[k] = True
    return i[joins], j[joins]


def _apart(dense: DataFrame, known: DataFrame) -> DataFrame:
    """x, n, component of the dense classes (x, n, hot) that share a frequent value with another component."""
    of = dense.join(known.withColumnRenamed("id", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    each = of.select("x", "n", "component", F.explode("hot").alias("v"))
    lists = each.groupBy("v").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("v")
    return each.join(lists, "v").select("x", "n", "component").distinct()


def _prefixes(apart: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """v, x, n, component: of each class the rarest values that it can share with another component, so many that any
    partner has one of them among its own; and only those that classes of several components hold so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, values = np.asarray(column(batch, "n")), column(batch, "shingles")
            done, most = 0, 1 << 18
            while done < len(n):  # a long set comes alone
                end = max(done + 1, int(np.searchsorted(np.cumsum(n[done:]), most, "right")) + done)
                flat = np.frombuffer(b"".join(v.as_py() for v in values[done:end]), np.uint64).view(np.int64)
                many = n[done:end]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(column(batch, c))[done:end], many)) for c in ("x", "n", "component")] + [pa.array(flat)], ["x", "n", "component", "v"])
                done = end

    each = scratch.keep(sets.select("x", "shingles").join(apart, "x").mapInArrow(run, "x long, n long, component long, v long"), "values")
    several = each.groupBy("v").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("v", "m")
    held = each.join(several, "v").groupBy("x", "n", "component").agg(F.sort_array(F.collect_list(F.struct("m", "v"))).alias("held"))
    need = F.ceil(F.col("n") * percent / 100)
    first = held.where(F.size("held") >= need).select("x", "n", "component", F.explode(F.slice("held", F.lit(1), F.size("held") - need.cast("int") + 1)).alias("h"))
    first = scratch.keep(first.select("x", "n", "component", F.col("h.v").alias("v")), "prefixes")
    lists = first.groupBy("v").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("v", "m")
    return scratch.keep(first.join(lists, "v"), "lists_apart")


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs between components in long lists. Every list is dealt into blocks of about BLOCK rows and every pair of blocks
    is a group of its own. rows: v, m (rows of the list), x, n, component, low (the WIDE least values of x)."""
    dealt = rows.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("p", F.pmod(F.xxhash64("x"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("v", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "x", "n", "component", "low")

    def run(_: tuple, t: pa.Table) -> pa.Table:
        n, x, c, p = (np.asarray(t[k]) for k in ("n", "x", "component", "p"))
        values = [np.frombuffer(v.as_buffer(), np.uint64) for chunk in t["low"].chunks for v in chunk]
        i, j = close_pairs(n, c, values, percent) if len(n) > 1 else (np.zeros(0, int), np.zeros(0, int))
        if len(set(p.tolist())) > 1:  # pairs within a block belong to that block's own group
            i, j = i[p[i] != p[j]], j[p[i] != p[j]]
        ab = np.unique(np.stack([np.minimum(x[i], x[j]), np.maximum(x[i], x[j])], 1), axis=0)
        return pa.table({"a": pa.array(ab[:, 0], pa.int64()), "b": pa.array(ab[:, 1], pa.int64())})

    return dealt.groupBy("v", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    with Scratch(spark) as scratch:
        each = scratch.keep(sketches(docs, size), "sketches")
        linked = each.where("n > 0 and doc_id is not null")
        classes = scratch.keep(linked.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")).withColumnRenamed("d1", "x"), "classes")

        lists = classes.select("x", "n", F.explode("sketch").alias("v"))
        lengths = lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
        found = lists.join(lengths, "v").groupBy("x", "n").agg(F.collect_list(F.when(F.col("m") <= LIST, F.col("v"))).alias("cold"), F.collect_list(F.when(F.col("m") > LIST, F.col("v"))).alias("hot"), F.sum("m").alias("fame"))
        # values of lists of one count as unfrequented as well
        found = scratch.keep(found.withColumn("others", F.least(F.lit(K), F.col("n")) - F.size("hot")), "lists")

        side = found.select("x", "n", "others", F.explode("cold").alias("v"))
        # the smaller set, if whole, misses its share of the other and what the other's sketch leaves out
        less, more = F.least("na", "nb"), F.greatest("na", "nb")
        slack = F.when(less <= K, F.floor(less * (100 - percent) / 100) + F.greatest(more - K, F.lit(0))).otherwise(SLACK)
        pairs = (
            side.toDF("a", "na", "oa", "v").join(side.toDF("b", "nb", "ob", "v"), "v").where((F.col("a") < F.col("b")) & _similar_sizes(percent))
            .groupBy("a", "b", "na", "nb", "oa", "ob").agg(F.count("*").alias("shared"))
            .where(F.col("shared") >= F.greatest(F.lit(1), F.least("oa", "ob") - slack))
        )
        dense = found.where(F.size("hot") > 0).where(F.col("others") <= SLACK).select("x", "n", "fame", "hot")
        hot = dense.select("x", "fame", F.explode("hot").alias("v"))
        # what copies were made from holds the group's frequent values and none of its edits
        leaders = hot.groupBy("v").agg(F.max_by("x", F.struct("fame", "x")).alias("l1"), F.min("x").alias("l2"))
        # a class's lists mostly name the same few leaders
        stars = hot.join(leaders, "v").groupBy("x").agg(F.array_union(F.collect_set("l1"), F.collect_set("l2")).alias("l")).select("x", F.explode("l").alias("l"))
        stars = stars.where("x <> l").select(F.least("x", "l").alias("a"), F.greatest("x", "l").alias("b")).distinct()

        likely = scratch.keep(_estimated(pairs.select("a", "b").unionByName(stars), classes, percent), "likely")
        ends = likely.select(F.col("a").alias("x")).unionByName(likely.select(F.col("b").alias("x"))).distinct()
        edges = []
        if not (likely.isEmpty() and dense.isEmpty()):
            ends = ends.unionByName(dense.select("x")).distinct().join(classes.select("x", "rep"), "x")
            ends = scratch.keep(ends.select("x", "rep"), "ends")
            wanted = ends.select(F.col("rep").alias("doc_id")).distinct()
            if ends.count() <= BROADCAST_IDS:
                wanted = F.broadcast(wanted)
            sets = scratch.keep(_sets(docs.join(wanted, "doc_id", "left_semi"), size).join(ends.select("x"), "x", "left_semi").dropDuplicates(["x"]), "sets")

            best = likely.select(F.col("a").alias("x"), "a", "b", "est").unionByName(likely.select(F.col("b").alias("x"), "a", "b", "est"))
            first = best.groupBy("x").agg(F.max(F.struct("est", F.col("a"), F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
            edges.append(cut(_exact(first, sets, percent)))
            known = components(edges[0])

            def apart(p: DataFrame) -> DataFrame:
                """Pairs that known components do not hold yet."""
                p = p.join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left")
                return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

            edges.append(cut(_exact(apart(likely.join(first, ["a", "b"], "left_anti")), sets, percent)))
            known = components(reduce(DataFrame.unionByName, edges))
            rows = _prefixes(_apart(dense, known), sets, scratch, percent)
            few = rows.where(F.col("m") <= LIST).select("v", "x", "n", "component")
            met = few.toDF("v", "a", "na", "ca").join(few.toDF("v", "b", "nb", "cb"), "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _similar_sizes(percent))
            long = rows.where(F.col("m") > LIST).join(sets.select("x", F.substring("shingles", 1, 8 * WIDE).alias("low")), "x")
            edges.append(cut(_exact(_estimated(met, classes, percent).select("a", "b").unionByName(_block_pairs(long, percent)).distinct(), sets, percent)))
            if not edges[-1].isEmpty():
                known = components(reduce(DataFrame.unionByName, edges))
            of = classes.join(known.withColumnRenamed("id", "x"), "x", "left").select("x", "d2", "n", "rep", F.coalesce("component", "x").alias("component"))
            of = of.join(of.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("x", "d2", "n", "component_id")
        else:
            of = classes.select("x", "d2", "n", F.col("rep").alias("component_id"))
        out = each.join(of.withColumnRenamed("x", "d1"), ["d1", "d2", "n"], "left")
        label = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        label = F.when(F.col("doc_id").isNotNull(), label)
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(False)).alias("kept")))
