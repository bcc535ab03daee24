"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash: 36 bits of its id, then 24 of its text, which order rows that share an id.  A source's budget is met by whole
passes over the source plus the documents whose hash lies below a threshold.  The
threshold is found without sorting documents: words are summed by (source, top 12 bits);
the bucket in which the budget ends is refined by the next 12 bits, and again by the
next 12, so each level adds up only the rows of one bucket of a source.  Thresholds are
nested: a larger budget takes a superset of the documents of a smaller one.

Edge cases: null text has size 0; the null source is a source (last in order); repeated
rows with the same id (or none) and the same text are taken alike, rows that differ in either are not; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codedelta.llm.common import WORD_CLASS, fresh_name, read_table, write_table

BITS = 12
LEVELS = 5
HASH_BITS = 60


def row_hash(doc_id, text):
    """60-bit hash of a row: the first 9 hex digits of the MD5 of the decimal id and the first 6 of that of the text."""
    def digits(value, n):
        return F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, n)
    return F.conv(F.concat(digits(doc_id.cast("string"), 9), digits(text, 6)), 16, 10).cast("long")


def level_bits(h, level: int):
    """Bits of level 1, 2, ... of a hash, from the top."""
    return F.shiftright(h, HASH_BITS - BITS * level).bitwiseAND(F.lit((1 << BITS) - 1))


def targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code-point order, null last.  A target stops at
    ``max_repeat`` times its source's size; the excess is shared again by weight among the
    others until none is above, which is water filling: with sources in ascending order of
    limit / weight, the first level that its own source does not exceed is the final one."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "rank")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("rank", F.row_number().over(by_name) - 1)
         .withColumn("w", w.cast("long"))
         .withColumn("limit", F.lit(int(max_repeat)).cast("long") * F.col("source_size"))
         .withColumn("ratio", F.col("limit") / F.col("w"))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
         .withColumn("below", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
         .withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())))
    limit = F.col("limit").cast("double")
    return s.select("source", "source_size",
                    F.when(F.col("final").isNull(), limit).otherwise(F.least(limit, F.col("final") * F.col("w"))).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the narrow table that all levels read."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix(docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, source, size, h, source_size, target, copies (0 to ``max_repeat``).

    ``share`` is the budget as a part of all words."""
    narrow = write_table(sized(docs), "sized")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (targets(sizes, weights, max_repeat, share)
            .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
            .withColumn("prefix", F.lit(0).cast("long")))
    plan = write_table(plan, "targets")
    for level in range(1, LEVELS + 1):
        n, b = narrow.alias("n"), plan.alias("b")
        inside = (F.col("n.source").eqNullSafe(F.col("b.source"))
                  & (F.shiftright(F.col("n.h"), HASH_BITS - BITS * (level - 1)) == F.col("b.prefix")))
        hist = (n.join(b, inside).select("n.source", "n.size", level_bits(F.col("n.h"), level).alias("bucket"))
                .groupBy("source", "bucket").agg(F.sum("size").alias("words")))
        up_to = Window.partitionBy("source").orderBy("bucket")
        edges = hist.withColumn("upto", F.sum("words").over(up_to)).alias("e")
        found = (edges.join(b, F.col("e.source").eqNullSafe(F.col("b.source")))
                 .filter((F.col("upto") - F.col("e.words") <= F.col("b.left")) & (F.col("b.left") < F.col("upto"))))
        plan = write_table(found.select(
            "b.source", "b.source_size", "b.target", "b.passes",
            (F.col("b.left") - (F.col("upto") - F.col("e.words"))).alias("left"), F.col("e.words").alias("words"),
            (F.shiftleft(F.col("b.prefix"), BITS) + F.col("bucket")).alias("prefix")), f"level{level}")
        if level == 1:
            whole = b
    # The last bucket is taken if that comes nearer to the target.
    t = whole.join(plan.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"),
                               (2 * F.col("left") >= F.col("words")).alias("with_last")),
                   F.col("b.source").eqNullSafe(F.col("s")), "left").drop("s", "prefix", "left")
    t = write_table(t.select("source", "source_size", "target", "passes", "threshold", "with_last"), "thresholds").alias("t")
    top = F.shiftright(F.col("n.h"), HASH_BITS - BITS * LEVELS)
    once_more = F.coalesce((top < F.col("threshold")) | ((top == F.col("threshold")) & F.col("with_last")), F.lit(False))
    return (narrow.alias("n").join(t, F.col("n.source").eqNullSafe(F.col("t.source")))
            .select("n.doc_id", "n.source", "n.size", "n.h", "t.source_size", "t.target",
                    (F.col("passes") + once_more.cast("long")).alias("copies")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    own, copies, source, key = (fresh_name(docs, n) for n in ("_id", "_copies", "_source", "_key"))
    taken = mix(docs, **options).filter("copies > 0").select(
        F.col("doc_id").alias(own), F.col("source").alias(source), F.col("h").alias(key), F.col("copies").alias(copies)).distinct()
    joined = docs.join(taken, (row_hash(F.col("doc_id"), F.col("text")) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own))
                       & F.col("source").eqNullSafe(F.col(source)))
    # A document is taken a few times at most.
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(fresh_name(docs, "_copy"))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    m = mix(read_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM n GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
g AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lam FROM f),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN lam <= ratio THEN lam END) OVER () * w, CAST(cap AS DOUBLE))) AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM n GROUP BY source, h),
d AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
e AS (SELECT p.source, p.source_size, p.target, p.passes, d.h AS thr, d.words, p.target - p.passes * p.source_size - (d.upto - d.words) AS rem
      FROM p LEFT JOIN d ON p.source IS NOT DISTINCT FROM d.source
       AND d.upto - d.words <= p.target - p.passes * p.source_size AND p.target - p.passes * p.source_size < d.upto)
SELECT n.doc_id, n.size, e.source_size, e.target,
       CAST(n.size * (e.passes + CASE WHEN n.h < e.thr OR (n.h = e.thr AND 2 * e.rem >= e.words) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN e ON n.source IS NOT DISTINCT FROM e.source
"""
