import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use themselves.
EXTRA = ["h", "n", "size", "copies", "kept", "grp", "token", "_id", "_other", "_copies", "_source", "row_key", "fp", "digest", "label"]


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"W{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): ordinary, near and exact copies, null, empty, blank, short, very long, repeated words."""
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (4, "ONE Two\nthree"), (5, "one"), (6, "a b c d e")]
    base = words(rng, 120)
    for k in range(30):
        other = list(base)
        for _ in range(k % 9):
            other[rng.randrange(len(other))] = f"x{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(other)))
    passage = words(rng, 60)
    for k in range(25):
        rows.append((200 + k, " ".join(words(rng, 30) + passage + words(rng, 40, 4000))))
    for k in range(40):
        rows.append((300 + k, " ".join(words(rng, rng.randrange(5, 200), 5000)) + "\nsame line\nsame line"))
    rows.append((400, " ".join(words(rng, 20000, 9000))))
    rows.append((401, "lo " * 300))
    rows += [(402, rows[10][1]), (403, rows[10][1]), (404, "the quick brown " * 5 + "fox")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def wide_docs(docs):
    """The documents with extra columns that clash with the operators' own names."""
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit(f"x_{c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
