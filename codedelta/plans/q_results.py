"""Result sink, keyset listing, status transitions and rule packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codedelta.operators import report as REP
from codedelta.operators import rulepack as RP
from codedelta.operators import store as ST
from codedelta.plans.q_report import _FULL_SQL
from codedelta.plans.q_store import _STATUS_SQL, PAGE_SIZE
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import _q, with_views
from codedelta.sources.derived import code_pairs
from codedelta.sources.tables import read_table, shared_path

TIME = "yyyy-MM-dd HH:mm:ss"


@register("keyset_pages", with_views(f"""
SELECT page, strftime(max(submitted_at), '%Y-%m-%d %H:%M:%S') AS first_ts, arg_min(pair_id, rk) AS first_key,
       strftime(min(submitted_at), '%Y-%m-%d %H:%M:%S') AS last_ts, arg_max(pair_id, rk) AS last_key, count(*) AS n
FROM (SELECT *, (rk - 1) // {PAGE_SIZE} + 1 AS page
      FROM (SELECT pair_id, submitted_at, row_number() OVER (ORDER BY submitted_at DESC, pair_id) AS rk FROM code_pairs))
GROUP BY page""", "code_pairs"))
def keyset_pages(spark, sf_dir):
    b = ST.page_bounds(code_pairs(spark, sf_dir), "submitted_at", "pair_id", PAGE_SIZE)
    return b.select("page", F.date_format("first_ts", TIME).alias("first_ts"), "first_key",
                    F.date_format("last_ts", TIME).alias("last_ts"), "last_key", "n")


# Two batches of one folder; an analysis is complete 250 to 1249 ms after its submission.
N_BATCHES = 2
RESULT_COLUMNS = ["pair_id", "status", "submitted_at", "overall_score", "level", "error_message", "language"]


@register("results_by_language", f"""
WITH f AS ({_FULL_SQL})
SELECT language, pair_id, status, overall_score, level, error_message, CAST(substr(pair_id, 2) AS BIGINT) % {N_BATCHES} AS batch_id,
       CASE WHEN status = 'completed' THEN CAST(250 + CAST(substr(pair_id, 2) AS BIGINT) % 1000 AS DOUBLE) END AS processing_ms
FROM f""")
def results_by_language(spark, sf_dir):
    """Every batch is written to the sink, and the sink read back."""
    cp = code_pairs(spark, sf_dir)
    path = shared_path(spark, "results")
    number = F.substring("pair_id", 2, 20).cast("long")
    completed = F.expr("timestampadd(MILLISECOND, 250 + CAST(substring(pair_id, 2) AS BIGINT) % 1000, submitted_at)")
    for batch in range(N_BATCHES):
        results = REP.analyze(spark, cp.filter(number % N_BATCHES == batch)).select(*RESULT_COLUMNS)
        ST.write_results(results, path, batch, completed)
    back = ST.read_results(spark, path, results.schema)
    return back.select("language", "pair_id", "status", "overall_score", "level", "error_message", "batch_id", "processing_ms")


_LEGAL_SQL = " OR ".join(f"(previous = {_q(a)} AND status IN ({', '.join(_q(x) for x in b)}))" for a, b in ST.NEXT_STATUS.items())


@register("illegal_transitions", f"""
WITH se AS ({_STATUS_SQL}),
p AS (SELECT *, lag(status) OVER (PARTITION BY analysis_id ORDER BY ts, seq) AS previous FROM se)
SELECT analysis_id, seq, previous, status FROM p
WHERE CASE WHEN previous IS NULL THEN status <> 'pending' ELSE previous <> status AND NOT ({_LEGAL_SQL}) END""")
def illegal_transitions(spark, sf_dir):
    return ST.illegal_transitions(ST.status_events_from(read_table(spark, sf_dir, "events"))).select("analysis_id", "seq", "previous", "status")


# The pack: all pairs of neighbouring words (every second one) of the benchmark texts.
_PAIR = "[a-z]+ [a-z]+"


@register("rule_pack_counts", f"""
WITH pack AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_PAIR}')) AS rule FROM benchmark)
SELECT rule, count(*) AS n_texts FROM pack JOIN (SELECT lower(text) AS low FROM documents) d ON contains(d.low, rule) GROUP BY rule""")
def rule_pack_counts(spark, sf_dir):
    texts = read_table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_PAIR), 0)).alias("text"))
    pack = texts.distinct().select(F.xxhash64("text").alias("seq"), "text")
    docs = read_table(spark, sf_dir, "documents").select(F.lower("text").alias("low"))
    return RP.pack_counts(docs, "low", pack).join(pack, "seq").select(F.col("text").alias("rule"), "n_texts")
