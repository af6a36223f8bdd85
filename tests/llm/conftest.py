import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, x long, v long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{'abcdefgh'[rng.randrange(8)] * rng.randrange(1, 6)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def fixture_rows():
    """Nulls, empty and long texts, ties, repeated rows, exact and near copies, shared passages, odd bytes."""
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "one", "two words", "Two  WORDS", "a b c", "É é ß 日本語 text", "\x00\x01 nul \x7f", "|endoftext| <|endoftext|>"]
    base = [prose(rng, rng.choice([12, 60, 200, 420])) for _ in range(12)]
    passage = prose(rng, 70)
    texts += base
    texts += [base[i % 12] for i in range(14)]
    texts += [edited(rng, base[i % 12], rng.choice([1, 2, 3, 6])) for i in range(40)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, rng.choice([5, 40]))}" for _ in range(25)]
    texts += [edited(rng, base[3], 2) for _ in range(40)]
    texts += [prose(rng, 6000), "long" * 3000, "x" * 49, "x" * 50, "x" * 120, "ü" * 40 + base[1][:80] + "ü" * 40]
    texts += [f"{base[5]}\n{base[6]}", base[5][3:200], base[5].upper()]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[5], rows[20], (None, base[0]), (None, passage), (None, None)]


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}", len(t or ""), 9.0, "r", 1, 2) for d, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
