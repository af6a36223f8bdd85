"""Corpus pipeline: quality classifier, near-dedup, passage dedup, decontamination and packing, over whole documents.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return docs' columns. Rows
that a stage drops are left out by an anti-join whose small side is broadcast only under a checked number of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontamination, near_dup, packing, quality, suffix_dedup
from tidelog.llm.common import Scratch, cut, table

#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in gone (materialised); nulls stay."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged by their (zero) statistics, equal texts
    alike, rows with a null doc_id too; without any label of 1 nothing goes; other columns pass as they are, whatever
    their names; an empty table stays empty."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays. Null, empty and wordless texts and rows with a null
    doc_id are nobody's copies and stay; a doc_id that goes does with all its rows, and one that stays keeps all, repeats
    too; other columns pass as they are; an empty table stays empty."""
    gone = near_dup.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return _without(docs, cut(gone), "doc_id").select(docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages that documents of smaller ids hold; no row goes. Null texts stay null, texts under 50 bytes
    and rows with a null doc_id stay whole, rows that repeat a doc_id take nothing from each other, and of copies all but
    the smallest id's become empty; a character that loses a part goes whole; n_chars follows, other columns pass as
    they are; an empty table stays empty."""
    return suffix_dedup.without_repeats(docs, suffix_dedup.deduplicate(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null, empty and wordless texts hold none and stay; rows that
    repeat are judged alike; a null doc_id is judged by its text; without items nothing goes; other columns pass as they
    are; an empty table stays empty."""
    keyed = docs.withColumn("__llm_key", F.xxhash64(F.col("doc_id"), F.lit("row"), F.col("text")))
    found = decontamination.decontaminate(keyed.select(F.col("__llm_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = cut(found.where("contaminated").select(F.col("doc_id").alias("__llm_key")).distinct())
    return _without(keyed, gone, "__llm_key").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into sequences of 2048 ids. A null or empty text is one piece of one id; rows that
    repeat, and rows with a null doc_id, are packed each; other columns are not read; an empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dup_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training a model and building shards of tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    with Scratch(spark) as scratch:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
