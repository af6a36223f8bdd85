"""Quality classifier by positive-unlabelled learning.

Texts become some thirty statistics (letter, symbol and repetition shares). A logistic model over them and their
squares minimises the non-negative unbiased risk: trusted positives (documents labelled 1), unlabelled web text (a
sample of all documents) and the class prior. The prior is estimated from positives and unlabelled texts alone: a probe
separates the two on one half of each; on the other half, the share of unlabelled over the share of positive texts
above a score is an upper bound of the prior, and it is taken at the score where it and its deviation are least. Labels
come only from rows whose crc32(doc_id as text) mod 5 is not 0; label 0 is never used.

Bounds, all parameters: at most `positives` labelled rows and `unlabelled` rows, each those of the lowest hashes of
their ids, so a larger table gives another sample and not a larger one. Every document is scored.

Defined results: null and empty texts get the score of their (zero) statistics; without any trusted positive every
score is 0.5; documents with several labels count with the lowest; equal texts get equal scores; rows with a null
doc_id are scored and not held out; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_chunks
from .words import mixed, words

POSITIVES = 8_000
UNLABELLED = 12_000
THRESHOLD = 0.3
FOLDS = 5
STEPS = 600

_KIND = np.full(256, 5, np.uint8)  # 0 upper, 1 lower, 2 digit, 3 space, 4 sentence marks, 5 other symbols, 6 beyond ASCII
for _k, _s in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\v\f\r", ".,;:?'\"-()"]):
    _KIND[[ord(_c) for _c in _s]] = _k
_KIND[128:] = 6
_MARKS = b"!|#%&*<>@_=/\\{}[]~$^+"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def statistics(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a run."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    many = np.maximum(size, 1).astype(float)
    kind = _KIND[flat]
    share = np.bincount(row * 7 + kind, minlength=7 * n).reshape(n, 7) / many[:, None]
    marks = np.stack([np.bincount(row[flat == m], minlength=n) for m in _MARKS], 1) / many[:, None]
    symbol = kind == 5
    pairs = symbol[1:] & symbol[:-1] & (row[1:] == row[:-1])
    runs = np.bincount(row[1:][pairs], minlength=n) / many
    lines = np.bincount(row[flat == 10], minlength=n) / many
    start, end, at, hashed = words(flat, offsets)
    count = np.bincount(at, minlength=n)
    least = np.maximum(count, 1).astype(float)
    mean = np.bincount(at, weights=end - start, minlength=n) / least
    wide = np.bincount(at, weights=(end - start).astype(float) ** 2, minlength=n) / least
    same = (hashed[1:] == hashed[:-1]) & (at[1:] == at[:-1])
    twice = np.bincount(at[1:][same], minlength=n) / least
    salt = mixed(at.astype(np.uint64) + np.uint64(1))

    def distinct(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        first = np.unique(x, return_index=True)[1]
        return np.bincount(of[first], minlength=n)

    kinds = distinct(hashed ^ salt, at)
    two = mixed(hashed[:-1] + np.uint64(3) * hashed[1:]) ^ salt[1:]
    inner = at[1:] == at[:-1]
    bigrams = distinct(two[inner], at[1:][inner]) / np.maximum(count - 1, 1)
    shown = np.bincount(at[symbol[np.maximum(end - 1, 0)]], minlength=n) / least if len(end) else np.zeros(n)
    lone = np.bincount(at[(end - start == 1) & symbol[np.minimum(start, max(len(flat) - 1, 0))]], minlength=n) / least if len(end) else np.zeros(n)
    extra = np.stack([np.log1p(size), np.log1p(count), runs, lines, mean, np.sqrt(np.maximum(wide - mean**2, 0)), twice, kinds / least, kinds / least * np.log1p(count), bigrams, shown, lone], 1)
    return np.concatenate([share, marks, extra], 1)


N_STATISTICS = 7 + len(_MARKS) + 12


class Model:
    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.centre, self.spread, self.weights = centre, spread, weights

    @staticmethod
    def design(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
        z = np.clip((x - centre) / spread, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 6], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x, self.centre, self.spread) @ self.weights, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, ridge: float = 1e-3) -> Model:
    """Non-negative unbiased risk with the logistic loss: prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).

    While the second part is negative its gradient is turned round, as the non-negative estimator asks."""
    centre = unlabelled.mean(0)
    spread = unlabelled.std(0) + 1e-6
    p, u = (Model.design(x, centre, spread) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        up = prior * p.T @ (sp - 1) / len(p)
        down = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        g = (up + down if negative >= 0 else -down) + ridge * np.r_[0, w[1:]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(centre, spread, w)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200) -> float:
    """Share of positives among unlabelled rows, between 0.02 and 0.98. Rows come in an order that says nothing of them."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    centre, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    (p, held_p), (u, held_u) = (((d := Model.design(x, centre, spread))[::2], d[1::2]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = p.T @ (1 / (1 + np.exp(-p @ w)) - 1) / len(p) + u.T @ (1 / (1 + np.exp(-u @ w))) / len(u) + 1e-2 * np.r_[0, w[1:]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    sp, su = np.sort(held_p @ w), np.sort(held_u @ w)
    over_p, over_u = (1 - np.searchsorted(s, sp) / len(s) for s in (sp, su))
    wide = np.sqrt(np.log(40) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = np.argmin((over_u + wide) / over_p)
    return float(np.clip(over_u[best] / over_p[best], 0.02, 0.98))


def _measured(rows: DataFrame) -> DataFrame:
    """doc_id, role and statistics of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(flat, offsets) for _, _, flat, offsets in text_chunks(batch)]
            x = np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "role"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "role", "x"])

    return rows.select("doc_id", "role", "text").mapInArrow(run, "doc_id long, role int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    lowest = lambda df, n, role: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.lit(role).alias("role"))
    trusted = lowest(known.where("quality = 1"), positives, 1)
    web = lowest(docs.where("doc_id is not null").select("doc_id"), unlabelled, 0)
    # bounded by the two parameters, so small enough to broadcast; of rows that repeat an id one text counts
    rows = docs.join(F.broadcast(trusted.unionByName(web.distinct())), "doc_id").groupBy("doc_id", "role").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = sorted(((r["doc_id"], r["role"], r["x"]) for r in _measured(rows).collect()), key=lambda r: (r[1], r[0]))
    x = {role: np.array([r[2] for r in got if r[1] == role]).reshape(-1, N_STATISTICS) for role in (0, 1)}
    if not len(x[1]) or not len(x[0]):
        return None
    return fit(x[1], x[0], estimated_prior(x[1], x[0]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of every row."""
    names = ("doc_id", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for a, b, flat, offsets in text_chunks(batch):
                    out[a:b] = model.score(statistics(flat, offsets))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.float64())], list(names))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts. One scan and no join: the whole rows pass
    through the scoring."""
    model = train(docs, labels)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(batch.num_rows)
            for a, b, flat, offsets in text_chunks(batch):
                out[a:b] = model.score(statistics(flat, offsets))
            yield batch.filter(pa.array(out >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
