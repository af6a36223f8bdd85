"""The pipeline's stages against plain versions, one after the other, and run() as a whole."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import quality, tokens

from . import brute
from .conftest import prose


@pytest.fixture(scope="module")
def sf(spark, docs, rows, tmp_path_factory):
    """The fixture as a folder of tables, with a benchmark that some documents hold."""
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(3)
    texts = [t for _, t in rows if t and len(t.split()) > 100]
    items = [(1, " ".join(texts[0].split()[20:45])), (2, prose(rng, 30)), (3, None), (4, "")]
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, items


def plain(rows, items):
    near = brute.near(rows)
    gone = {r[0] for r in near if not r[3] and r[0] is not None}
    rows = [(d, t) for d, t in rows if d not in gone]
    rows = [(d, r[5].decode("utf-8", "ignore") if r[2] else t) for (d, t), r in zip(rows, brute.repeats(rows), strict=True)]
    return [(d, t) for (d, t), r in zip(rows, brute.leaks(rows, items), strict=True) if not r[5]]


def test_stages(spark, sf, rows, tmp_path):
    d, items = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = plain(rows, items)
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    encode = tokens.encoder(tokens.vocabulary())
    ids = Counter((i, len(encode(t or "")) + 1) for i, t in want)
    total = defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
    by_id = defaultdict(int)
    for (i, n), k in ids.items():
        by_id[i] += n * k
    assert dict(total) == dict(by_id)


def test_run(spark, sf, rows):
    d, items = sf
    want = Counter()
    encode = tokens.encoder(tokens.vocabulary())
    for i, t in plain(rows, items):
        x = np.array([*encode(t or ""), 0], "<u4")
        first = len(x) % 2048 or 2048
        for k, a in enumerate([0, *range(first, len(x), 2048)]):
            part = x[a : a + 2048] if k else x[:first]
            want[i, k, zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, d).collect()) == want


def test_quality_stage_follows_the_classifier(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    out = corpus_pipeline.quality_stage(spark, docs, sf).collect()
    assert {r["doc_id"] for r in out} == good and 0 < len(good) < docs.count()


def test_empty_corpus(spark, sf, tmp_path):
    d, _ = sf
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
