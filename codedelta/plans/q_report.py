"""Classification, impact scoring, next steps, summary and the full report.

The oracle rebuilds the report in SQL from the same definitions: the patch of
a code pair is its common prefix's last 4 lines, the differing middle and the
suffix's first 4 lines (on code pairs no middle line is shared, so this is the
minimal script), line counts come from the LCS dynamic programme, element
counts from the element-diff CTEs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codedelta.operators import classify as C
from codedelta.operators import diff as Dff
from codedelta.operators import mapping as M
from codedelta.operators import report as REP
from codedelta.operators import score as S
from codedelta.operators.elements import TOKEN_PATTERN
from codedelta.plans.q_diff import lcs_ctes
from codedelta.plans.q_elements import NODE_CTES
from codedelta.plans.q_risk import _struct_list
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import LINE_RE, _q, with_views
from codedelta.rules import (COMPLEX_TYPES, DEPENDENCY_LICENSE_SUGGESTION, DEPENDENCY_PATTERNS,
                             HIGH_SECURITY_STEP, IMPACT_DESCRIPTIONS, INFRASTRUCTURE_TYPES, LANGUAGE_ADJUSTMENTS,
                             LEVEL_WORDS, LICENSE_STEP, NO_REFACTORING_SUMMARY, PARSED_LANGUAGES,
                             SIMPLIFYING_TYPES, SUMMARY_RULE, TYPE_NEXT_STEPS, node_rules, text_rules)
from codedelta.sources.derived import code_pairs


def D(x):
    return f"CAST({x} AS DOUBLE)"


def _in(items):
    return "(" + ", ".join(_q(x) for x in items) + ")"


_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({seq}, {_q(t)}, {lv}, {_q(txt)})" for _o, t, lv, seq, txt in text_rules()) + ") v(seq, type, level, text)"
_STEPS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(t)}, {i}, {_q(st)})" for t, steps in TYPE_NEXT_STEPS for i, st in enumerate(steps)) + \
    ") v(type, i, step)"
_WORDS = "[" + ", ".join(_q(w) for w in LEVEL_WORDS) + "]"
_STYPE, _SLEVEL, _SWORDS, _SEVID, _SCONF = SUMMARY_RULE


def _sig(x, centre, scale):
    return (f"(CASE WHEN {x} = 0 THEN {D('0.0')} ELSE least({D('100.0')} / ({D('1.0')} + "
            f"exp(-({D(x)} - {D(centre)}) / {D(scale)})), {D('100.0')}) END)")


def _raw_sql(lines, nodes, infra, cov, cx):
    return (f"{_sig(lines, 200.0, 100.0)} * {D(0.3)} + {_sig(nodes, 50.0, 25.0)} * {D(0.25)} "
            f"+ least({D(infra)} * 20, {D('100.0')}) * {D(0.2)} "
            f"+ least(greatest(({D(cov)} + 50) * 2, {D('0.0')}), {D('100.0')}) * {D(0.15)} "
            f"+ least(greatest(({D('10.0')} - {D(cx)}) * 5, {D('0.0')}), {D('100.0')}) * {D(0.1)}")


def _level_sql(score):
    return (f"CASE WHEN {score} >= 80 THEN 4 WHEN {score} >= 60 THEN 3 WHEN {score} >= 40 THEN 2 "
            f"WHEN {score} >= 20 THEN 1 ELSE 0 END")


_DEP_SQL = " || ".join(f"regexp_extract_all({{t}}, {_q(p)}, 1)" for p in DEPENDENCY_PATTERNS)

REPORT_CTES = NODE_CTES + [
    ("cpo", f"SELECT * FROM code_pairs WHERE language IN {_in(PARSED_LANGUAGES)}"),
    *lcs_ctes("cpo", "lt", "ld"),
    ("lcs", """SELECT lt.k AS pair_id, CAST(len(lt.b) - ld.row_[len(ld.row_)] AS BIGINT) AS lines_added,
          CAST(len(lt.a) - ld.row_[len(ld.row_)] AS BIGINT) AS lines_removed
          FROM ld JOIN lt ON ld.k = lt.k WHERE ld.i = len(lt.a)"""),
    ("pl", f"""SELECT pair_id, regexp_extract_all(legacy, {LINE_RE}) AS a,
          regexp_extract_all(refactored, {LINE_RE}) AS b FROM cpo"""),
    ("pp", """SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1),
                                                         lambda i: a[i] = b[i]), false) - 1,
                            least(len(a), len(b))) AS p FROM pl"""),
    ("ps", """SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) - p + 1),
                                                         lambda i: a[len(a) - i + 1] = b[len(b) - i + 1]), false) - 1,
                            least(len(a), len(b)) - p) AS s FROM pp"""),
    ("pt", """SELECT pair_id,
            lower(array_to_string(CASE WHEN p = len(a) AND p = len(b) THEN []::VARCHAR[]
                  ELSE a[greatest(p - 3, 1):p] || a[p + 1:len(a) - s] || b[p + 1:len(b) - s]
                       || a[len(a) - s + 1:least(len(a) - s + 4, len(a))] END, chr(10))) AS patch_lower,
            array_to_string(b[p + 1:len(b) - s], chr(10)) AS added_text,
            array_to_string(a[p + 1:len(a) - s], chr(10)) AS removed_text
          FROM ps"""),
    ("tk", f"""SELECT pair_id, -1 AS w, unnest(regexp_extract_all(legacy, {_q(TOKEN_PATTERN)})) AS tok FROM cpo
          UNION ALL SELECT pair_id, 1 AS w, unnest(regexp_extract_all(refactored, {_q(TOKEN_PATTERN)})) FROM cpo"""),
    ("tc", """SELECT pair_id, tok, count(*) FILTER (WHERE w < 0) AS n_old, count(*) FILTER (WHERE w > 0) AS n_new
          FROM tk GROUP BY pair_id, tok"""),
    ("tks", """SELECT c.pair_id,
            CAST(coalesce(sum(CASE WHEN n_old = 0 THEN n_new ELSE 0 END), 0) AS BIGINT) AS tokens_added,
            CAST(coalesce(sum(CASE WHEN n_new = 0 THEN n_old ELSE 0 END), 0) AS BIGINT) AS tokens_removed
          FROM cpo c LEFT JOIN tc USING (pair_id) GROUP BY c.pair_id"""),
    ("summ", """SELECT pair_id, nodes_added, nodes_removed, nodes_modified,
            concat_ws(', ', CASE WHEN nodes_added > 0 THEN CAST(nodes_added AS VARCHAR) || ' nodes added' END,
                            CASE WHEN nodes_removed > 0 THEN CAST(nodes_removed AS VARCHAR) || ' nodes removed' END,
                            CASE WHEN nodes_modified > 0 THEN CAST(nodes_modified AS VARCHAR) || ' nodes modified' END)
              AS ast_diff_summary,
            CAST(least(nodes_added * 2 + nodes_removed * 3 + nodes_modified, 100) AS INTEGER) AS file_impact_score
          FROM node_counts"""),
    ("rules", _RULES_SQL),
    ("det", f"""SELECT pt.pair_id, r.seq, r.type, r.level, 'Found ' || r.text || ' in file changes' AS evidence,
                 {D(0.8)} AS conf
          FROM pt JOIN rules r ON contains(pt.patch_lower, r.text)
          UNION ALL
          SELECT pair_id, {len(node_rules()) + 1}, {_q(_STYPE)}, {_SLEVEL}, {_q(_SEVID)}, {D(_SCONF)} FROM summ
          WHERE {' OR '.join(f"contains(lower(ast_diff_summary), {_q(w)})" for w in _SWORDS)}"""),
    ("ev", "SELECT pair_id, type, evidence, min(seq) AS s FROM det GROUP BY pair_id, type, evidence"),
    ("mt", """SELECT pair_id, type, max(level) AS level, min(seq) AS first_seq,
            list_reduce(list(conf ORDER BY seq), lambda acc, x: (acc + x) / 2) AS confidence
          FROM det GROUP BY pair_id, type"""),
    ("rk", """SELECT mt.*, (SELECT list(evidence ORDER BY s) FROM ev WHERE ev.pair_id = mt.pair_id AND ev.type = mt.type)
              AS evidence,
            row_number() OVER (PARTITION BY pair_id ORDER BY level DESC, first_seq) AS rk FROM mt"""),
    ("met", f"""SELECT c.pair_id,
            CAST(coalesce(sum(CASE WHEN rk.type IN {_in(INFRASTRUCTURE_TYPES)} THEN 1 ELSE 0 END), 0) AS INTEGER) AS infra,
            CAST(coalesce(sum(CASE WHEN rk.level >= 4 THEN 1 ELSE 0 END), 0) AS INTEGER) AS arch,
            CAST(greatest(coalesce(sum(CASE WHEN rk.type IN {_in(COMPLEX_TYPES)} THEN rk.level * 2 ELSE rk.level END), 0)
                 - coalesce(sum(CASE WHEN rk.type IN {_in(SIMPLIFYING_TYPES)} THEN rk.level ELSE 0 END), 0), -10)
                 AS INTEGER) AS cx,
            CAST(greatest(least(coalesce(sum(CASE WHEN rk.type = 'Testing' THEN rk.level * 10
                                                WHEN rk.level >= 3 THEN -5 ELSE 0 END), 0), 50), -50) AS INTEGER) AS cov,
            CAST(count(rk.type) AS INTEGER) AS n_types
          FROM cpo c LEFT JOIN rk USING (pair_id) GROUP BY c.pair_id"""),
    ("sc0", """SELECT c.pair_id, c.language, l.lines_added, l.lines_removed, s.nodes_added, s.nodes_removed,
            s.nodes_modified, s.ast_diff_summary, s.file_impact_score, t.tokens_added, t.tokens_removed,
            m.infra, m.arch, m.cx, m.cov, m.n_types,
            l.lines_added + l.lines_removed AS lines_changed,
            s.nodes_added + s.nodes_removed + s.nodes_modified + t.tokens_added + t.tokens_removed AS nodes_changed
          FROM cpo c JOIN lcs l USING (pair_id) JOIN summ s USING (pair_id) JOIN tks t USING (pair_id)
          JOIN met m USING (pair_id)"""),
    ("sc", f"""SELECT *, {_raw_sql('lines_changed', 'nodes_changed', 'infra', 'cov', 'cx')} AS raw FROM sc0"""),
    ("scf", f"""SELECT *, CAST(floor(least(greatest(raw, {D('0.0')}), {D('100.0')}) + 0.5) AS INTEGER) AS overall_score
          FROM sc"""),
    ("fl0", f"""SELECT pair_id, type, severity, description, min(pattern_ord) AS first_ord FROM (
            SELECT pair_id, type, pattern_ord, severity, replace(tmpl, '{{n}}', CAST(n_hits AS VARCHAR)) AS description,
                   n_hits, min_hits
            FROM (SELECT pair_id, unnest({_struct_list(('security', 'license', 'compatibility'), 'refactored')},
                                          recursive := true)
                  FROM cpo WHERE coalesce(include_security_scan, true)))
          WHERE n_hits >= min_hits GROUP BY pair_id, type, severity, description"""),
    ("fl", "SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY first_ord) AS flag_ord FROM fl0"),
    ("tsteps", _STEPS_SQL),
    ("st0", f"""SELECT rk.pair_id, rk.rk * 10 + s.i AS o, s.step FROM rk JOIN tsteps s USING (type)
          UNION ALL
          SELECT pair_id, 100000 + flag_ord,
                 CASE WHEN type = 'security' AND severity = 'high' THEN {_q(HIGH_SECURITY_STEP)}
                      WHEN type = 'license' THEN {_q(LICENSE_STEP)} END FROM fl"""),
    ("st", """SELECT pair_id, step, row_number() OVER (PARTITION BY pair_id ORDER BY min(o)) AS step_ord
          FROM st0 WHERE step IS NOT NULL GROUP BY pair_id, step"""),
    ("smry", f"""SELECT c.pair_id,
            CASE WHEN count(rk.type) = 0 THEN {_q(NO_REFACTORING_SUMMARY)}
                 ELSE 'Major ' || coalesce({_WORDS}[max(CASE WHEN rk.rk = 1 THEN rk.level END) + 1], 'unknown')
                      || ' changes: ' || string_agg(lower(rk.type), ', ' ORDER BY rk.rk) END AS summary
          FROM cpo c LEFT JOIN (SELECT * FROM rk WHERE rk <= 3) rk USING (pair_id) GROUP BY c.pair_id"""),
]


def _report(spark, sf_dir, **kw):
    return REP.analyze(spark, code_pairs(spark, sf_dir), **kw)


def _completed(spark, sf_dir, **kw):
    return _report(spark, sf_dir, **kw).filter(F.col("status") == "completed")


@register("classify_file", with_views(
    "SELECT pair_id, CAST(seq AS INTEGER) AS seq, type, CAST(level AS INTEGER) AS level, evidence, conf AS confidence "
    "FROM det", "code_pairs", extra=REPORT_CTES))
def classify_file(spark, sf_dir):
    cp = code_pairs(spark, sf_dir).filter(F.col("language").isin(PARSED_LANGUAGES))
    d = REP.with_text_changes(Dff.with_alignment(cp, beside={"_ch": M.changes_col()}))
    summ = M.diff_summary(*[F.size(F.col("_ch")[n]) for n in ("added", "removed", "modified")])
    return d.select("pair_id", F.explode(C.file_detections(F.col("patch_lower"), summ)).alias("d")).select(
        "pair_id", "d.seq", "d.type", "d.level", "d.evidence", "d.confidence")


@register("merge_types", with_views(
    "SELECT pair_id, CAST(rk AS INTEGER) AS rank, type, CAST(level AS INTEGER) AS level, "
    "array_to_string(evidence, '; ') AS evidence, round(confidence, 6) AS confidence FROM rk",
    "code_pairs", extra=REPORT_CTES))
def merge_types(spark, sf_dir):
    r = _completed(spark, sf_dir)
    return r.select("pair_id", F.inline(F.transform("refactor_types", lambda t, i: F.struct(
        (i + 1).alias("rank"), t["type"].alias("type"), t["level"].alias("level"),
        F.array_join(t["evidence"], "; ").alias("evidence"), F.round(t["confidence"], 6).alias("confidence")))))


_NODE_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({seq}, {_q(t)}, {lv}, {_q(nt)}, {_q(txt)}, {_q(cond)})" for _o, t, lv, seq, nt, txt, cond in node_rules()) + \
    ") v(seq, type, level, node_type, rule, condition)"


def _node_hit(src: str, nodes: str, condition: str) -> str:
    return f"""SELECT e.pair_id, '{src}' AS src, e.ord, e.kind, e.name, e.imports, n.seq, n.type, n.level, n.node_type, n.rule
        FROM {nodes} e JOIN nr n ON {condition}"""


_FOUND = ("(n.node_type IS NULL OR n.node_type = e.kind) AND (n.rule IS NULL OR contains(lower(e.text), lower(n.rule))) "
          "AND n.condition = ")


@register("classify_nodes", with_views("""
SELECT pair_id, src, ord, seq, type, level,
       concat_ws(' ', CASE WHEN rule IS NOT NULL THEN 'Found ' || rule || ' usage' END, CASE WHEN name <> '' THEN 'in ' || name END,
                 '(' || kind || ')') AS evidence,
       least(CAST(0.5 AS DOUBLE) + CASE WHEN rule IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 0 END
             + CASE WHEN node_type IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END
             + CASE WHEN name <> '' THEN CAST(0.1 AS DOUBLE) ELSE 0 END
             + CASE WHEN len(imports) > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END, CAST(1 AS DOUBLE)) AS confidence
FROM hits""", "code_pairs", extra=NODE_CTES + [
    ("nr", _NODE_RULES_SQL),
    ("renamed", """SELECT x.* FROM modified m JOIN els o ON o.pair_id = m.pair_id AND o.side = 'legacy' AND o.ord = m.l_ord
          JOIN els x ON x.pair_id = m.pair_id AND x.side = 'refactored' AND x.ord = m.r_ord WHERE o.name <> x.name"""),
    ("hits", _node_hit("added", "added", _FOUND + "'isNew'") + " UNION ALL " + _node_hit("removed", "removed", _FOUND + "'removed'")
     + " UNION ALL " + _node_hit("modified", "renamed", "n.condition = 'nameChanged'"))]))
def classify_nodes(spark, sf_dir):
    """Node-level detections of added, removed and renamed elements."""
    cp = code_pairs(spark, sf_dir).filter(F.col("language").isin(PARSED_LANGUAGES))
    d = M.element_changes(cp).select("pair_id", F.explode(REP.node_detection_array()).alias("d"))
    return d.select("pair_id", "d.*")


@register("impact_metrics", with_views("""
SELECT pair_id, CAST(lines_changed AS BIGINT) AS total_lines_changed, 1 AS files_modified,
       CAST(nodes_changed AS BIGINT) AS ast_nodes_changed, infra AS new_infrastructure_components,
       arch AS architectural_changes, cx AS cyclomatic_complexity_delta, cov AS test_coverage_delta
FROM scf""", "code_pairs", extra=REPORT_CTES))
def impact_metrics(spark, sf_dir):
    return _completed(spark, sf_dir).select(
        "pair_id", F.col("total_lines_changed").cast("long"), "files_modified",
        F.col("ast_nodes_changed").cast("long"), "new_infrastructure_components", "architectural_changes",
        "cyclomatic_complexity_delta", "test_coverage_delta")


@register("impact_score", with_views(f"""
SELECT pair_id, round(raw, 6) AS raw_score, overall_score, {_level_sql('overall_score')} AS level FROM scf""",
                                     "code_pairs", extra=REPORT_CTES))
def impact_score(spark, sf_dir):
    return _completed(spark, sf_dir).select("pair_id", F.round("raw_score", 6).alias("raw_score"),
                                            "overall_score", "level")


_CM = "CASE language " + " ".join(f"WHEN {_q(k)} THEN {D(c)}" for k, (c, _i) in LANGUAGE_ADJUSTMENTS.items()) + \
    f" ELSE {D('1.0')} END"
_IW = "CASE language " + " ".join(f"WHEN {_q(k)} THEN {D(i)}" for k, (_c, i) in LANGUAGE_ADJUSTMENTS.items()) + \
    f" ELSE {D('1.0')} END"
_DESCS = "[" + ", ".join(_q(x) for x in IMPACT_DESCRIPTIONS) + "]"


@register("impact_adjusted", with_views(f"""
SELECT pair_id, round(adj_infra, 6) AS new_infrastructure_components, round(adj_cx, 6) AS cyclomatic_complexity_delta,
       adj_score AS overall_score, adj_level AS level,
       coalesce({_DESCS}[adj_level + 1], {_q(IMPACT_DESCRIPTIONS[0])})
       || CASE WHEN adj_infra > 0 THEN ' (' || CAST(round(adj_infra, 6) AS VARCHAR) || ' new infrastructure components)' ELSE '' END
       || CASE WHEN arch > 0 THEN ' (' || CAST(arch AS VARCHAR) || ' architectural changes)' ELSE '' END AS description
FROM (SELECT *, {_level_sql('adj_score')} AS adj_level FROM (
  SELECT *, CAST(floor(least(greatest({_raw_sql('lines_changed', 'nodes_changed', 'adj_infra', 'cov', 'adj_cx')},
                                     {D('0.0')}), {D('100.0')}) + 0.5) AS INTEGER) AS adj_score
  FROM (SELECT *, infra * {_IW} AS adj_infra, cx * {_CM} AS adj_cx FROM sc0)))""", "code_pairs", extra=REPORT_CTES))
def impact_adjusted(spark, sf_dir):
    r = _completed(spark, sf_dir, adjust_language=True)
    infra, arch = F.col("new_infrastructure_components"), F.col("architectural_changes")
    return r.select("pair_id", F.round(infra, 6).alias("new_infrastructure_components"),
                    F.round("cyclomatic_complexity_delta", 6).alias("cyclomatic_complexity_delta"),
                    "overall_score", "level",
                    S.impact_description(F.col("level"), F.round(infra, 6), arch).alias("description"))


@register("summary_top3", with_views("SELECT pair_id, summary FROM smry", "code_pairs", extra=REPORT_CTES))
def summary_top3(spark, sf_dir):
    return _completed(spark, sf_dir).select("pair_id", "summary")


@register("next_steps", with_views("SELECT pair_id, CAST(step_ord AS INTEGER) AS step_ord, step FROM st",
                                   "code_pairs", extra=REPORT_CTES))
def next_steps(spark, sf_dir):
    r = _completed(spark, sf_dir)
    return r.select("pair_id", F.inline(F.transform("next_steps", lambda s, i: F.struct((i + 1).alias("step_ord"), s.alias("step")))))


@register("dep_extract", with_views(f"""
SELECT DISTINCT pair_id, kind, dependency FROM (
  SELECT pair_id, 'new' AS kind, unnest({_DEP_SQL.format(t='added_text')}) AS dependency FROM pt
  UNION ALL
  SELECT pair_id, 'removed' AS kind, unnest({_DEP_SQL.format(t='removed_text')}) AS dependency FROM pt)""",
                                    "code_pairs", extra=REPORT_CTES))
def dep_extract(spark, sf_dir):
    r = _completed(spark, sf_dir)
    return (r.select("pair_id", F.lit("new").alias("kind"), F.explode("new_dependencies").alias("dependency"))
            .unionByName(r.select("pair_id", F.lit("removed").alias("kind"),
                                  F.explode("removed_dependencies").alias("dependency"))))


@register("dep_license", with_views(f"""
SELECT DISTINCT pair_id, dependency, 'license' AS type, 'high' AS severity,
       'Dependency ' || dependency || ' may have restrictive license' AS description,
       {_q(DEPENDENCY_LICENSE_SUGGESTION)} AS suggestion
FROM (SELECT pair_id, unnest({_DEP_SQL.format(t='added_text')}) AS dependency FROM pt)
WHERE contains(dependency, 'gpl') OR contains(dependency, 'copyleft')""", "code_pairs", extra=REPORT_CTES))
def dep_license(spark, sf_dir):
    from codedelta.operators import risk as R
    r = _completed(spark, sf_dir).select("pair_id", F.explode("new_dependencies").alias("dep"))
    return R.dependency_license(r, "dep", ["pair_id"])


_FULL_SQL = with_views(f"""
SELECT c.pair_id, c.language, CASE WHEN f.pair_id IS NULL THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN f.pair_id IS NULL THEN 'Unsupported language: ' || coalesce(c.language, 'null') END AS error_message,
       f.overall_score, CASE WHEN f.pair_id IS NOT NULL THEN {_level_sql('f.overall_score')} END AS level, sm.summary,
       f.lines_added, f.lines_removed, f.nodes_added, f.nodes_removed, f.nodes_modified,
       f.tokens_added, f.tokens_removed, f.file_impact_score, f.n_types AS n_refactor_types,
       (SELECT string_agg(type || ':' || CAST(level AS VARCHAR), '; ' ORDER BY rk) FROM rk WHERE rk.pair_id = c.pair_id)
         AS refactor_types,
       CASE WHEN f.pair_id IS NOT NULL THEN CAST((SELECT count(*) FROM fl WHERE fl.pair_id = c.pair_id) AS INTEGER) END
         AS n_risk_flags,
       CASE WHEN f.pair_id IS NOT NULL THEN
         coalesce((SELECT string_agg(step, '; ' ORDER BY step_ord) FROM st WHERE st.pair_id = c.pair_id), '') END
         AS next_steps
FROM code_pairs c LEFT JOIN scf f USING (pair_id) LEFT JOIN smry sm USING (pair_id)""",
                       "code_pairs", extra=REPORT_CTES)


def full_report_flat(report):
    return report.select(
        "pair_id", "language", "status", "error_message", "overall_score", "level", "summary",
        "lines_added", "lines_removed", "nodes_added", "nodes_removed", "nodes_modified",
        "tokens_added", "tokens_removed", "file_impact_score",
        F.size("refactor_types").alias("n_refactor_types"),
        F.when(F.size("refactor_types") > 0, F.array_join(F.transform(
            "refactor_types", lambda t: F.concat(t["type"], F.lit(":"), t["level"].cast("string"))), "; "))
        .alias("refactor_types"),
        F.size("risk_flags").alias("n_risk_flags"),
        F.array_join("next_steps", "; ").alias("next_steps"))


@register("full_report", _FULL_SQL)
def full_report(spark, sf_dir):
    return full_report_flat(_report(spark, sf_dir))
