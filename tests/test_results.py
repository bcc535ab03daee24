"""Result sink, keyset paging, status transitions and rule packs."""
import random
import tempfile

from pyspark.sql import functions as F

from codedelta.operators import rulepack as RP
from codedelta.operators import store as ST
from codedelta.rules import text_rules

RESULTS = "pair_id string, language string, status string, submitted_at timestamp_ntz, overall_score int"
ORDER = [("submitted_at", True), ("pair_id", False)]


def _results(spark, ids, language, score, status="completed"):
    rows = [(f"p{i}", language, status, score) for i in ids]
    df = spark.createDataFrame(rows, "pair_id string, language string, status string, overall_score int")
    return df.select("pair_id", "language", "status", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("submitted_at"), "overall_score")


def test_a_batch_that_runs_again_replaces_its_own_partitions(spark):
    path = tempfile.mkdtemp(prefix="cd-sink-") + "/results"
    done = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:01.5'")
    first = _results(spark, range(10), "java", 1).unionByName(_results(spark, range(10, 15), "c", 1)).unionByName(_results(spark, [15], None, 0, "failed"))
    ST.write_results(first, path, 0, done)
    ST.write_results(_results(spark, range(20, 25), "java", 2), path, 1, done)
    ST.write_results(_results(spark, range(20, 24), "java", 3), path, 1, done)     # again, with another outcome
    back = ST.read_results(spark, path, first.schema)
    got = {r.pair_id: r for r in back.collect()}
    assert len(got) == back.count() == 20
    assert {got[f"p{i}"].overall_score for i in range(20, 24)} == {3} and got["p3"].batch_id == 0 and got["p3"].processing_ms == 1500.0
    assert got["p15"].language is None and got["p15"].completed_at is None and got["p15"].processing_ms is None
    plan = back.filter("language = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and back.filter("language = 'c'").count() == 5


def test_every_page_by_key_equals_the_page_by_offset(spark):
    rng = random.Random(2)
    rows = [(f"p{i}", rng.randrange(40) * 600) for i in range(57)]      # many equal times
    df = spark.createDataFrame(rows, "pair_id string, s long").select(
        "pair_id", F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("submitted_at")).cache()
    bounds = {r.page: r for r in ST.page_bounds(df, "submitted_at", "pair_id", 10).collect()}
    assert sorted(bounds) == [1, 2, 3, 4, 5, 6] and bounds[6].n == 7
    last = None
    for n in range(1, 8):
        want = [tuple(r) for r in ST.page(df, [F.desc("submitted_at"), F.asc("pair_id")], n, 10).collect()]
        got = [tuple(r) for r in ST.seek_page(df, ORDER, last, 10).collect()]
        assert got == want
        if n == 7:
            assert got == []
            break
        assert (bounds[n].first_key, bounds[n].last_key, bounds[n].n) == (got[0][0], got[-1][0], len(got))
        last = (bounds[n].last_ts, bounds[n].last_key)
    assert "TakeOrderedAndProject" in ST.seek_page(df, ORDER, last, 10)._jdf.queryExecution().executedPlan().toString()


def test_page_bounds_of_nothing(spark):
    empty = spark.createDataFrame([], "pair_id string, submitted_at timestamp_ntz")
    assert ST.page_bounds(empty, "submitted_at", "pair_id", 10).collect() == []
    assert ST.seek_page(empty, ORDER, None, 10).collect() == []


def test_illegal_transitions(spark):
    runs = {1: ["pending", "processing", "completed", "pending", "failed"], 2: ["processing", "processing", "completed", "failed"],
            3: ["pending", "pending", "completed"], 4: ["pending"]}
    rows = [(a, s, i) for a, run in runs.items() for i, s in enumerate(run)]
    ev = spark.createDataFrame(rows, "analysis_id long, status string, seq long").withColumn("ts", F.timestamp_seconds(F.col("seq") / 2))
    got = sorted((r.analysis_id, r.seq, r.previous, r.status) for r in ST.illegal_transitions(ev).collect())
    assert got == [(2, 0, None, "processing"), (2, 3, "completed", "failed"), (3, 2, "pending", "completed")]


def test_pack_of_ten_thousand_rules(spark):
    rng = random.Random(3)
    rules = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randrange(2, 7)))) for i in range(10_000)] + [(10_000, ""), (10_001, None)]
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 300))) for _ in range(20)] + [None, "", "abc" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = {k: None if t is None else [i for i, r in rules if r and r in t] for k, t in enumerate(texts)}
    for part_bytes in (RP.PART_BYTES, 60_000):       # one automaton, and several
        hits = RP.pack_hits(RP.pack_of(spark, rules), F.col("t"), part_bytes)
        assert {r.k: r.h for r in df.select("k", hits.alias("h")).collect()} == want


def test_pack_equals_the_literal_array(spark):
    rules = [(seq, text.lower()) for _, _, _, seq, text in text_rules()]
    words = [t for _, t in rules]
    rng = random.Random(4)
    df = spark.createDataFrame([(k, " ".join(rng.sample(words, 4))) for k in range(30)] + [(99, "none of it")], "k int, t string")
    literal = F.transform(F.filter(F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(t).alias("t")) for s, t in rules]),
                                   lambda r: F.instr(F.col("t"), r["t"]) > 0), lambda r: r["s"])
    rows = df.select(F.array_sort(F.array_distinct(literal)).alias("a"), RP.pack_hits(RP.pack_of(spark, rules), F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)


def test_an_empty_pack_finds_nothing(spark):
    df = spark.createDataFrame([(1, "text"), (2, None)], "k int, t string")
    assert {r.k: r.h for r in df.select("k", RP.pack_hits(RP.pack_of(spark, []), F.col("t")).alias("h")).collect()} == {1: [], 2: None}
