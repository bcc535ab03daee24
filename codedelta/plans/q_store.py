"""Request validation, listing, lookup, deletion, settings, outbox, status and
rate-limit queries, plus snippet clustering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codedelta.operators import cluster as CL
from codedelta.operators import kpi
from codedelta.operators import report as REP
from codedelta.operators import store as ST
from codedelta.plans.q_report import _FULL_SQL
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import _q, with_views
from codedelta.rules import ACCEPTED_LANGUAGES, KPIS, RATE_LIMIT_WINDOW, SOURCE_TYPES
from codedelta.sources.derived import code_docs, code_pairs
from codedelta.sources.tables import read_table

# ---------------------------------------------------------------- validation
# Requests derived from code pairs: every 17th legacy side is a repo without
# a url, every 29th request names a language outside the accepted set.


def _requests(spark, sf_dir):
    cp = code_pairs(spark, sf_dir)
    return cp.select(
        "pair_id",
        F.when(F.col("doc_id") % 29 == 7, F.lit("fortran")).otherwise(F.col("language")).alias("language"),
        F.when(F.col("doc_id") % 17 == 5, F.lit("repo")).otherwise(F.lit("paste")).alias("legacy_type"),
        "legacy", F.lit(None).cast("string").alias("legacy_url"),
        F.lit("paste").alias("refactored_type"), "refactored", F.lit(None).cast("string").alias("refactored_url"))


_TYPES = "[" + ", ".join(SOURCE_TYPES) + "]"


def _side_checks(name, typ, content, url):
    return [f"CASE WHEN {typ} IS NULL OR {typ} NOT IN ({', '.join(_q(t) for t in SOURCE_TYPES)}) "
            f"THEN {_q(f'\"{name}.type\" must be one of {_TYPES}')} END",
            f"CASE WHEN {typ} = 'paste' AND ({content} IS NULL OR {content} = '') THEN {_q(f'\"{name}.content\" is required')} END",
            f"CASE WHEN {typ} = 'repo' AND ({url} IS NULL OR {url} = '') THEN {_q(f'\"{name}.url\" is required')} END"]


_LANG_CHECK = (f"CASE WHEN language IS NULL OR language NOT IN ({', '.join(_q(x) for x in ACCEPTED_LANGUAGES)}) "
               f"THEN {_q(ST.LANGUAGE_MESSAGE)} END")
_ERRS = "list_filter([" + ", ".join([_LANG_CHECK] + _side_checks("legacy", "legacy_type", "legacy", "legacy_url")
                                   + _side_checks("refactored", "refactored_type", "refactored", "refactored_url")
                                   ) + "], lambda x: x IS NOT NULL)"

_VALIDATE_SQL = with_views(f"""
SELECT pair_id, len(errs) = 0 AS valid, CASE WHEN len(errs) > 0 THEN array_to_string(errs, ', ') END AS message
FROM (SELECT pair_id, {_ERRS} AS errs FROM req)""", "code_pairs", extra=[("req", """
SELECT pair_id, CASE WHEN doc_id % 29 = 7 THEN 'fortran' ELSE language END AS language,
       CASE WHEN doc_id % 17 = 5 THEN 'repo' ELSE 'paste' END AS legacy_type, legacy, NULL::VARCHAR AS legacy_url,
       'paste' AS refactored_type, refactored, NULL::VARCHAR AS refactored_url FROM code_pairs""")])


@register("validate_requests", _VALIDATE_SQL)
def validate_requests(spark, sf_dir):
    r = _requests(spark, sf_dir)
    errs = ST.request_errors(F.col("language"), [
        ("legacy", F.col("legacy_type"), F.col("legacy"), F.col("legacy_url")),
        ("refactored", F.col("refactored_type"), F.col("refactored"), F.col("refactored_url"))])
    return r.select("pair_id", (F.size(errs) == 0).alias("valid"),
                    F.when(F.size(errs) > 0, F.array_join(errs, ", ")).alias("message"))


# ----------------------------------------------------------- listing / lookup
PAGE_NO, PAGE_SIZE = 2, 10
LOOKUP_IDS = ["p5", "p40", "p-missing"]


def _full(spark, sf_dir):
    return REP.analyze(spark, code_pairs(spark, sf_dir))


@register("list_page", f"""
WITH f AS ({_FULL_SQL}),
c AS (SELECT pair_id, submitted_at FROM ({with_views('SELECT pair_id, submitted_at FROM code_pairs', 'code_pairs')}))
SELECT f.pair_id, f.status, f.language, strftime(c.submitted_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       f.overall_score, f.level, CAST(count(*) OVER () AS BIGINT) AS total,
       CAST(ceil(count(*) OVER () / {PAGE_SIZE}) AS BIGINT) AS pages
FROM f JOIN c USING (pair_id)
ORDER BY c.submitted_at DESC, f.pair_id LIMIT {PAGE_SIZE} OFFSET {(PAGE_NO - 1) * PAGE_SIZE}""")
def list_page(spark, sf_dir):
    """The page is taken from the pairs, and only its rows are analysed; the total counts the pairs."""
    cp = code_pairs(spark, sf_dir)
    total = cp.select(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    rows = ST.page(cp, [F.desc("submitted_at"), F.asc("pair_id")], PAGE_NO, PAGE_SIZE)
    return REP.analyze(spark, rows).select(
        "pair_id", "status", "language", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "overall_score", "level", total.cast("long").alias("total"),
        F.ceil(total / F.lit(PAGE_SIZE)).cast("long").alias("pages"))


@register("lookup", f"""
WITH f AS ({_FULL_SQL})
SELECT pair_id, status, language, CASE WHEN status = 'completed' THEN overall_score END AS overall_score,
       CASE WHEN status = 'completed' THEN summary END AS summary,
       CASE WHEN status = 'failed' THEN error_message END AS error_message
FROM f WHERE pair_id IN ({', '.join(_q(i) for i in LOOKUP_IDS)})""")
def lookup(spark, sf_dir):
    ids = spark.createDataFrame([(i,) for i in LOOKUP_IDS], "pair_id string")
    wanted = code_pairs(spark, sf_dir).join(ids, "pair_id", "left_semi")   # before anything is analysed
    return ST.lookup(REP.analyze(spark, wanted), ids)


@register("delete_ids", with_views("""
SELECT pair_id, language FROM code_pairs WHERE pair_id NOT IN (
  SELECT pair_id FROM code_pairs WHERE language = 'cobol' UNION ALL SELECT 'p-missing')""", "code_pairs"))
def delete_ids(spark, sf_dir):
    cp = code_pairs(spark, sf_dir).select("pair_id", "language")
    ids = cp.filter(F.col("language") == "cobol").select("pair_id").unionByName(
        spark.createDataFrame([("p-missing",)], "pair_id string"))
    remaining, _not_found = ST.delete_ids(cp, ids)
    return remaining


# ------------------------------------------------------------------ settings
# Orgs come from the pairs; current settings hold the default weights, the
# updates replace two orgs' maps and add a new org.
SETTINGS_UPDATES = [("org1", {"K1": 0.5, "K2": 0.5}), ("org3", {"K3": 0.9}), ("org9", {"K4": 1.0})]
_UPD_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(o)}, {_q(k)}, CAST({w} AS DOUBLE))" for o, m in SETTINGS_UPDATES for k, w in m.items()) + \
    ") v(org, kpi, weight)"
_DEF_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({_q(k)}, CAST({w} AS DOUBLE))" for k, _n, _d, w in KPIS) + \
    ") v(kpi, weight)"


@register("upsert_settings", with_views("""
SELECT org, kpi, weight FROM allr a WHERE ver = (SELECT max(ver) FROM allr b WHERE b.org = a.org)""",
                                       "code_pairs", extra=[
    ("cur", f"SELECT o.org, d.kpi, d.weight, 0 AS ver FROM (SELECT DISTINCT org FROM code_pairs) o, ({_DEF_SQL}) d"),
    ("upd", f"SELECT org, kpi, weight, 1 AS ver FROM ({_UPD_SQL})"),
    ("allr", "SELECT * FROM cur UNION ALL SELECT * FROM upd")]))
def upsert_settings(spark, sf_dir):
    orgs = code_pairs(spark, sf_dir).select("org").distinct()
    defaults = F.create_map(*[x for k, _n, _d, w in KPIS for x in (F.lit(k), F.lit(w))])
    cur = orgs.select("org", defaults.alias("kpi_weights"), F.lit(0).alias("updated_at"))
    schema = T.StructType([T.StructField("org", T.StringType()),
                           T.StructField("kpi_weights", T.MapType(T.StringType(), T.DoubleType())),
                           T.StructField("updated_at", T.IntegerType())])
    upd = spark.createDataFrame([(o, m, 1) for o, m in SETTINGS_UPDATES], schema)
    latest = ST.upsert_latest(cur.select("org", "kpi_weights", "updated_at"), upd, "org", "updated_at")
    return latest.select("org", F.explode("kpi_weights").alias("kpi", "weight"))


# -------------------------------------------------------------------- outbox
@register("outbox", f"""
WITH f AS ({_FULL_SQL}),
c AS (SELECT pair_id, user_id FROM ({with_views('SELECT pair_id, user_id FROM code_pairs', 'code_pairs')})),
u AS (SELECT DISTINCT user_id, CASE WHEN user_id <> 'u3' THEN user_id || '@example.org' END AS email,
             CASE WHEN user_id <> 'u5' THEN 'User ' || user_id END AS name FROM c WHERE user_id IS NOT NULL)
SELECT f.pair_id, u.email AS "to", 'Analysis Complete: ' || f.pair_id AS subject,
       'Hi ' || coalesce(u.name, 'there') || ', your code analysis (' || f.pair_id || ') is complete. Summary: '
       || f.summary || '. Overall Score: ' || CAST(f.overall_score AS VARCHAR) AS text
FROM f JOIN c USING (pair_id) JOIN u USING (user_id) WHERE f.status = 'completed' AND u.email IS NOT NULL""")
def outbox(spark, sf_dir):
    cp = code_pairs(spark, sf_dir)
    users = cp.filter(F.col("user_id").isNotNull()).select("user_id").distinct().select(
        "user_id", F.when(F.col("user_id") != "u3", F.concat("user_id", F.lit("@example.org"))).alias("email"),
        F.when(F.col("user_id") != "u5", F.concat(F.lit("User "), "user_id")).alias("name"))
    return REP.outbox(_full(spark, sf_dir), users)


# ------------------------------------------------------------- status events
_LANGS = "[" + ", ".join(_q(x) for x in ACCEPTED_LANGUAGES) + "]"
_STATUS_SQL = f"""SELECT user_id AS analysis_id,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing'
                       WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
       {_LANGS}[CAST(user_id % {len(ACCEPTED_LANGUAGES)} AS INTEGER) + 1] AS language,
       ts, event_id AS seq FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase', 'error')"""


@register("status_latest", f"""
WITH se AS ({_STATUS_SQL})
SELECT analysis_id, arg_max(status, (ts, seq)) AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts
FROM se GROUP BY analysis_id""")
def status_latest(spark, sf_dir):
    se = ST.status_events_from(read_table(spark, sf_dir, "events"))
    return ST.latest_status(se).select("analysis_id", "status",
                                       F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


@register("status_rollup", f"""
WITH se AS ({_STATUS_SQL}),
lt AS (SELECT analysis_id, arg_max(status, (ts, seq)) AS status, any_value(language) AS language FROM se GROUP BY analysis_id),
pt AS (SELECT analysis_id, (epoch_us(max(CASE WHEN status IN ('completed', 'failed') THEN ts END))
                            - epoch_us(min(CASE WHEN status = 'pending' THEN ts END))) / 1000.0 AS processing_ms
       FROM se GROUP BY analysis_id)
SELECT status, language, count(*) AS n, round(avg(processing_ms), 3) AS avg_processing_ms
FROM lt JOIN pt USING (analysis_id) GROUP BY status, language""")
def status_rollup(spark, sf_dir):
    return ST.status_rollup(ST.status_events_from(read_table(spark, sf_dir, "events")))


RATE_LIMIT_FIXTURE = 2  # the service default is 100 per window; the event fixture peaks at 3


@register("over_limit", f"""
SELECT user_id, strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) AS n
FROM events GROUP BY user_id, time_bucket(INTERVAL '15 minutes', ts) HAVING count(*) > {RATE_LIMIT_FIXTURE}""")
def over_limit(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    o = ST.over_limit(ev, "user_id", "ts", RATE_LIMIT_WINDOW, RATE_LIMIT_FIXTURE)
    return o.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@register("snippet_clusters")
def snippet_clusters(spark, sf_dir):
    """k-means cluster per code document (rows-only: no SQL twin for k-means)."""
    return CL.cluster_snippets(code_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "cluster")
