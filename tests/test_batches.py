"""Arrow steps over whole texts hold a few texts at a time, in one Python worker per task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codedelta.functions import batches as B
from codedelta.operators import elements as E

TEXT = "int f(int a) { return g(a, [1, 2]); }\n" * 200


def _evaluations(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def _pairs(spark, n=6):
    return spark.range(n).select(
        F.concat(F.lit("p"), "id").alias("pair_id"), F.lit("c").alias("language"), F.lit("o").alias("org"), F.lit("u").alias("user_id"),
        F.current_timestamp().alias("submitted_at"), F.lit(TEXT).alias("legacy"), F.concat(F.lit(TEXT), F.lit("int h() { return 0; }\n")).alias("refactored"),
        F.lit(None).cast("map<string,string>").alias("map_hints"), F.lit(True).alias("include_security_scan"))


def test_slices_are_bounded_and_sent_on_before_the_next():
    seen = []

    def make(text):
        seen.append(len(text))
        return text
    batch = pa.array([None, "x" * B.PIECE_BYTES, "y", "z" * (3 * B.PIECE_BYTES), ""])
    out = B.in_pieces(iter([(batch,), (batch.slice(0, 0),)]), make)
    assert next(out).to_pylist()[0] is None and seen == [2]
    assert [len(x) for x in out] == [2, 1, 0] and seen == [2, 2, 1, 0]


@pytest.mark.parametrize("udf", [E._nodes_udf, E._subtrees_udf, E._elements_udf])
def test_a_batch_of_many_texts_leaves_in_pieces(udf):
    n = 4 * B.PIECE_BYTES // len(TEXT)
    parts = list(udf.func(iter([(pa.array([TEXT] * n), pa.array(["c"] * n))])))
    assert len(parts) >= 4 and sum(len(p) for p in parts) == n
    assert all(p[0].as_py() == parts[0][0].as_py() for p in parts)


def test_the_session_bounds_rows_and_bytes_of_a_batch(spark):
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, "64m")
        E.node_rows(_pairs(spark))
        assert (spark.conf.get(rows), spark.conf.get(size)) == (str(B.BATCH_ROWS), str(B.BATCH_BYTES))
        spark.conf.set(rows, "10")
        spark.conf.set(size, "1m")
        E.node_rows(_pairs(spark))
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("10", "1m")
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])


def test_trees_are_scanned_once(spark):
    assert _evaluations(E.node_rows(_pairs(spark))) == 1
    assert _evaluations(E.subtree_counts(_pairs(spark))) == 1
