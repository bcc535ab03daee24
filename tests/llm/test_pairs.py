"""Jaccard join, decontamination and decision lists against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from codedelta.llm import components, decision_list, jaccard_join, winnowing


def test_jaccard_components(wide_docs, texts):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(wide_docs).collect()}
    assert got == brute.components(texts)


def test_jaccard_repeated_and_null_ids(spark, docs):
    more = spark.createDataFrame([(None, "a b c d e", "en", "s", 9), (6, "a b c d e", "en", "s", 9)], docs.schema)
    rows = jaccard_join.jaccard_components(docs.filter("doc_id < 10").union(more)).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2] or 0) for r in rows)[-3:] == [(False, 6, 1, 6), (False, 6, 1, 6), (True, 0, 1, 0)]


def test_jaccard_empty(no_docs):
    assert jaccard_join.jaccard_components(no_docs).collect() == []


def test_one_of_each_keeps_columns(wide_docs, texts):
    out = jaccard_join.one_of_each(wide_docs)
    assert out.columns == wide_docs.columns
    expected = brute.components(texts)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(i for i in expected if expected[i][1] == i)


def test_jaccard_hot_passage_and_thresholds(spark):
    """Documents around the limit of 0.75, with a passage that all of them share."""
    rng = random.Random(9)
    shared = [f"p{i}" for i in range(80)]
    rows = []
    for k in range(60):
        own = rng.randrange(8, 30)
        rows.append((k, " ".join(shared + [f"q{rng.randrange(6)}_{i}" for i in range(own)])))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df.repartition(3)).collect()}
    assert got == brute.components(rows)


def test_jaccard_copies_before_the_least_id(spark):
    """Exact copies in descending doc_id in one partition; near copies in another size band."""
    w = [f"v{i}" for i in range(104)]
    rows = [(i, " ".join(w)) for i in (50, 40, 30, 10)] + [(60, " ".join(w[:100])), (55, " ".join(w[:99])), (70, " ".join(w[50:]))]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == brute.components(rows) and got[60] == (96, 10)


def test_jaccard_frequent_tokens_are_last(spark, monkeypatch):
    """A passage of 100 documents, a few in each partition: its shingles are among nobody's first tokens."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(20)]
    rows = [(k, " ".join([f"o{rng.randrange(10**9)}" for _ in range(100)] + passage)) for k in range(100)]
    rows += [(100 + k, rows[k][1] + " one more") for k in range(2)]
    tables = {}
    write = jaccard_join.write_table
    monkeypatch.setattr(jaccard_join, "write_table", lambda df, name: tables.setdefault(name, write(df, name)))
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(20)).collect()}
    assert got == brute.components(rows) and got[101] == (118, 1)
    assert tables["entries"].groupBy("token").agg(F.countDistinct("id").alias("c")).filter("c > 2").count() == 0


def test_jaccard_tokens_of_many_groups(spark, monkeypatch):
    """Near copies around the limit, with all tokens taken as those of many groups, packed and not."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(50):
        other = list(base)
        for _ in range(1 + k % 5):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(other)))
    expected = brute.components(rows)
    assert 3 < len({c for _, c in expected.values()}) < 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, wide=0).collect()} == expected
    monkeypatch.setattr(jaccard_join, "UNPACKED", 1)
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, wide=3).collect()} == expected


def test_components_of_a_path(spark):
    n = 60
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r[0]: r[1] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)}


ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def items(spark, texts):
    rng = random.Random(3)
    by_id = dict(texts)
    long = by_id[400].split()
    rows = [(1, " ".join(long[500:540])), (2, " ".join(long[520:530])), (3, " ".join(long[900:909])), (4, None), (5, "..."),
            (6, "One, TWO; three!"), (7, "lo lo"), (8, " ".join(by_id[210].split()[20:60])), (8, " ".join(by_id[300].split()[:12])),
            (9, " ".join(f"z{rng.randrange(50)}" for _ in range(30))), (10, "lo " * 12)]
    return spark.createDataFrame(rows, ITEMS)


def _rows(df):
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in df.withColumn(
        "items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)).collect())


def test_contamination(wide_docs, texts, items):
    got = _rows(winnowing.contamination(wide_docs, items))
    assert got == sorted(brute.contamination(texts, [tuple(r) for r in items.collect()]))


def test_contamination_edges(docs, no_docs, items, texts):
    assert winnowing.contamination(no_docs, items).collect() == []
    assert not any(r["contaminated"] for r in winnowing.contamination(docs, items.filter("false")).collect())
    twice = winnowing.contamination(docs.union(docs).filter("doc_id in (3, 400)"), items).collect()
    assert len(twice) == 4 and len(set((r["doc_id"], r["n_hit"]) for r in twice)) == 2


def test_contamination_by_items_without_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "one two three"), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(text.split()[5:17])), (None, "one two"), (7, " ".join(text.split()[:10]))], ITEMS)
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in winnowing.contamination(docs, items).collect()}
    assert got == {1: (17, 1, ["7"], True), 2: (2, 0, [], True), 3: (0, 0, [], False)}


def test_clean_documents(wide_docs, texts, items):
    out = winnowing.clean_documents(wide_docs, items)
    assert out.columns == wide_docs.columns
    expected = [r[0] for r in brute.contamination(texts, [tuple(r) for r in items.collect()]) if not r[5]]
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(expected)


def test_clean_documents_by_row(spark):
    """Rows that share an id, or have none, are judged by their own texts."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, "clean without id"), (4, text), (4, "clean with a shared id"), (4, "clean with a shared id"), (5, None)]
    out = winnowing.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, text)], ITEMS))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_statistics(wide_docs, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in decision_list.statistics(wide_docs).collect()}
    assert got == {i: brute.text_counts(t)[:5] for i, t in texts}


def test_repeated_words_of_many_kinds(spark):
    """More kinds of repeated windows than the look-up takes."""
    half = " ".join(f"k{i}" for i in range(200))
    text = f"{half} middle {half} a b c"
    df = spark.createDataFrame([(1, text), (2, "a a a a"), (3, "a b a b a")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in decision_list.statistics(df).collect()}
    assert got == {i: brute.text_counts(t)[4] for i, t in [(1, text), (2, "a a a a"), (3, "a b a b a")]}


def test_decision_list_learns_and_keeps(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/labels.parquet")
    held = labels.filter("doc_id % 2 = 1")
    j = decision_list.judge(docs, labels.filter("doc_id % 2 = 0")).join(held, "doc_id").filter("not base_failed").collect()
    low, good = [r for r in j if r["quality"] == 0], [r for r in j if r["quality"] == 1]
    assert sum(not r["kept"] for r in low) >= 0.8 * len(low) and sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_decision_list_without_labels(wide_docs, no_docs, labels):
    j = decision_list.judge(wide_docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in j)
    assert decision_list.judge(no_docs, labels).collect() == []


def test_native_plans_have_no_python(docs, items, labels):
    for df in (winnowing.contamination(docs, items), decision_list.judge(docs, labels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
