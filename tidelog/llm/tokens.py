"""Token ids from public vocabularies, and the exact length histogram.

Lengths are counted once per document; the histogram of lengths is all that is aggregated (partial sums before the
shuffle), and suffix sums over it answer totals, quantiles and truncated totals of every context limit.

Defined results: null text counts as empty and has length 0; rows that repeat count each time; an empty table has an
empty histogram; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

#: Lengths per block of the two-level suffix sum.
BLOCK = 1024


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text; special tokens' strings are ordinary text. A byte-level BPE file whose ids follow its merges is
    run by tiktoken from the same file, which gives the same ids several times faster; others by tokenizers."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec.get("model", {})
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer"):
        pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if all(vocab.get(p) == 256 + i for i, p in enumerate(pairs)):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if i < 256 + len(pairs)}
            if len(ranks) == 256 + len(pairs):
                return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            counts = [len(encode(t.as_py() or "")) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents of each length, materialised: the histogram reads it twice, the tokenizer runs once."""
    return cut(lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("docs")))


def histogram(counted: DataFrame) -> DataFrame:
    """From (n_tokens, docs) rows a row per length: docs of it, and over all docs at least as long: docs_ge, tokens_ge; docs_le up to it; truncated
    = tokens left if every document is cut to this length; total. Two levels of suffix sums: no task sees all lengths."""
    hist = counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    sums = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    # one row for 1024 lengths
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(over).alias("all_docs"), F.sum("t").over(over).alias("total"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumns({"d0": F.sum("docs").over(inner), "t0": F.sum(F.col("docs") * F.col("n_tokens")).over(inner)})
        .join(sums, "block")
        .select(
            "n_tokens",
            "docs",
            (F.col("d0") + F.col("d")).alias("docs_ge"),
            (F.col("t0") + F.col("t")).alias("tokens_ge"),
            (F.col("all_docs") - F.col("d0") - F.col("d") + F.col("docs")).alias("docs_le"),
            (F.col("total") - F.col("t0") - F.col("t") + F.col("n_tokens") * (F.col("d0") + F.col("d"))).alias("truncated"),
            "total",
        )
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left by each context limit: from the histogram row of the shortest length at or over it."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    at = asked.join(hist, F.col("n_tokens") >= F.col("context"), "left").groupBy("context").agg(F.min_by(F.struct("n_tokens", "docs_ge", "tokens_ge", "total"), "n_tokens").alias("h"), F.min("total").alias("any"))
    whole = hist.agg(F.max("total").alias("whole"))
    return at.crossJoin(F.broadcast(whole)).select("context", F.when(F.col("h").isNull(), F.coalesce("whole", F.lit(0))).otherwise(F.col("h.total") - F.col("h.tokens_ge") + F.col("context") * F.col("h.docs_ge")).alias("kept_tokens"))


def quantiles(hist: DataFrame, per_mille: list[int]) -> DataFrame:
    """Nearest-rank quantiles: the shortest length with at least q/1000 of the documents at or under it."""
    asked = hist.sparkSession.createDataFrame([(int(q),) for q in per_mille], "q long")
    n = F.col("docs_le") + F.col("docs_ge") - F.col("docs")
    return asked.join(hist.withColumn("n", n), F.col("docs_le") * 1000 >= F.col("q") * F.col("n"), "inner").groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))
