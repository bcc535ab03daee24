"""Code pairs and tool scores derived from the driver tables.

Each builder has a DuckDB twin in ``codedelta.plans.sqlviews`` with the same
definition, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codedelta.functions.text import line_key, lines
from codedelta.sources.snippets import N_SNIPPETS, snippet_rows
from codedelta.sources.tables import read_table

SNIPPET_SCHEMA = T.StructType([
    T.StructField("snip_id", T.IntegerType(), False),
    T.StructField("language", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("hint_from", T.StringType(), True),
    T.StructField("hint_to", T.StringType(), True),
])

# Pairs whose doc_id % UNSUPPORTED_MOD == UNSUPPORTED_MOD - 1 get an accepted
# but unparsed language, to exercise the failure path.
UNSUPPORTED_MOD = 41
UNSUPPORTED_LANGUAGE = "cobol"
NO_SCAN_MOD = 9          # include_security_scan is false where doc_id % 9 == 4
N_ORGS = 5
N_USERS = 13             # user_id null where doc_id % 13 == 12
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def snippets(spark: SparkSession) -> DataFrame:
    """The 24-row literal snippet table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(snippet_rows(), SNIPPET_SCHEMA)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out where the input has fewer splits than the cluster has cores (one large row group); an
    input of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def code_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with snippet ``doc_id % 24`` appended: (doc_id, snip_id, language, text)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = snippets(spark)
    return (docs.join(F.broadcast(s), (docs.doc_id % N_SNIPPETS) == s.snip_id)
            .select("doc_id", "snip_id", "language",
                    F.concat(docs.text, F.lit("\n"), s.code).alias("text")))


def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis requests (schema M1): the legacy side carries snippet ``doc_id % 24``,
    the refactored side snippet ``(doc_id + 1) % 24``."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    old = snippets(spark).select(F.col("snip_id").alias("o_id"), F.col("code").alias("o_code"),
                                 "hint_from", "hint_to")
    new = snippets(spark).select(F.col("snip_id").alias("n_id"), F.col("code").alias("n_code"),
                                 F.col("language").alias("n_lang"))
    j = (docs.join(F.broadcast(old), (docs.doc_id % N_SNIPPETS) == old.o_id)
         .join(F.broadcast(new), ((docs.doc_id + 1) % N_SNIPPETS) == new.n_id))
    return j.select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("pair_id"),
        "doc_id",
        F.when(F.col("doc_id") % UNSUPPORTED_MOD == UNSUPPORTED_MOD - 1, F.lit(UNSUPPORTED_LANGUAGE))
         .otherwise(F.col("n_lang")).alias("language"),
        F.concat(F.col("text"), F.lit("\n"), F.col("o_code")).alias("legacy"),
        F.concat(F.col("text"), F.lit("\n"), F.col("n_code")).alias("refactored"),
        F.when(F.col("hint_from").isNotNull(),
               F.create_map(F.col("hint_from"), F.col("hint_to"))).alias("map_hints"),
        (F.col("doc_id") % NO_SCAN_MOD != 4).alias("include_security_scan"),
        F.concat(F.lit("org"), (F.col("doc_id") % N_ORGS).cast("string")).alias("org"),
        F.when(F.col("doc_id") % N_USERS != N_USERS - 1,
               F.concat(F.lit("u"), (F.col("doc_id") % N_USERS).cast("string"))).alias("user_id"),
        # wall-clock time, independent of the session time zone
        F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("submitted_at"),
    )


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy documents: each document paired with the earlier document that is the first holder of most of its
    lines (ties: the least id).  Returns (k, old, nw).

    Lines are compared by 96-bit keys.  Each line leads to its first document only, so a line of n documents gives n - 1 rows.  The first holders
    come from a partial aggregation; a line in very many documents is a skewed key of a plain equi-join,
    which adaptive execution splits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.inline(F.array_distinct(F.transform(lines(F.col("text")), line_key))))
    first = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    shared = (held.join(first, ["h1", "h2"]).filter(F.col("doc_id") > F.col("first_doc"))
              .groupBy("doc_id", "first_doc").agg(F.count(F.lit(1)).alias("n")))
    # max_by is a partial aggregation: no window over a document's partners.
    best = shared.groupBy("doc_id").agg(F.max_by("first_doc", F.struct(F.col("n"), -F.col("first_doc"))).alias("first_doc"))
    a = docs.select(F.col("doc_id").alias("first_doc"), F.col("text").alias("old"))
    b = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("nw"))
    return (best.join(a, "first_doc").join(b, best.doc_id == b.k)
            .select("k", "old", "nw"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation: (conv_id, turn, old, nw).

    Turns are numbered 0..n-1, so the previous turn is an equi-join on
    ``turn - 1``; unlike a window per conversation this spreads one long
    conversation over many tasks."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    return conv.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", "old", F.col("text").alias("nw"))


def diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text pairs used by the diff queries: (pair_id, legacy, refactored)."""
    cp = code_pairs(spark, sf_dir).select("pair_id", "legacy", "refactored")
    # One derivation gives both a near pair and the same pair with the new side's lines in reverse order.
    near = near_pairs(spark, sf_dir).select("old", F.explode(F.array(
        F.struct(F.concat(F.lit("n"), F.col("k").cast("string")).alias("pair_id"), F.col("nw").alias("refactored")),
        F.struct(F.concat(F.lit("m"), F.col("k").cast("string")).alias("pair_id"),
                 F.array_join(F.reverse(lines(F.col("nw"))), "").alias("refactored")))).alias("p"))
    near = near.select("p.pair_id", F.col("old").alias("legacy"), "p.refactored")
    turns = turn_pairs(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
        .alias("pair_id"), F.col("old").alias("legacy"), F.col("nw").alias("refactored"))
    return cp.unionByName(near).unionByName(turns)


def nation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tool scores (group_id, tool, tool_idx, kpi, score): tools are nations,
    compared within their region on seven lineitem aggregates K1..K7.

    lineitem is aggregated per supplier first (map-side partial aggregation),
    so the joins with the dimension tables see one row per supplier."""
    li = read_table(spark, sf_dir, "lineitem")
    per_supp = li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("l_quantity").alias("qty"),
        F.max("l_extendedprice").alias("max_price"),
        F.min("l_extendedprice").alias("min_price"),
        F.sum("l_discount").alias("disc"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (per_supp.join(supp, per_supp.l_suppkey == supp.s_suppkey)
         .join(nation, supp.s_nationkey == nation.n_nationkey)
         .join(region, nation.n_regionkey == region.r_regionkey))
    wide = j.groupBy("r_name", "n_name", "n_nationkey").agg(
        F.sum("cnt").cast("double").alias("K1"),
        F.round(F.sum("qty"), 6).alias("K2"),
        F.round(F.sum("qty") / F.sum("cnt"), 6).alias("K3"),
        F.round(F.max("max_price"), 6).alias("K4"),
        F.round(F.min("min_price"), 6).alias("K5"),
        F.round(F.sum("disc") / F.sum("cnt"), 6).alias("K6"),
        F.sum("returned").cast("double").alias("K7"),
    )
    return wide.select(
        F.col("r_name").alias("group_id"), F.col("n_name").alias("tool"),
        F.col("n_nationkey").cast("int").alias("tool_idx"),
        F.expr("stack(7, 'K1', K1, 'K2', K2, 'K3', K3, 'K4', K4, 'K5', K5, 'K6', K6, 'K7', K7)")
        .alias("kpi", "score"))
