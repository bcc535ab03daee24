"""Risk-scan queries over code documents and the refactored side of code pairs."""

from __future__ import annotations

from codedelta.operators import risk
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import _q, with_views
from codedelta.rules import risk_pattern_rows
from codedelta.sources.derived import code_docs, code_pairs


def _struct_list(packs, text="text"):
    items = []
    for pack, cat, ordn, regex, sev, min_hits, desc, sugg in risk_pattern_rows():
        if pack not in packs:
            continue
        items.append("{" + ", ".join([
            f"'type': {_q(pack)}", f"'category': {_q(cat)}", f"'pattern_ord': {ordn}",
            f"'severity': {_q(sev)}",
            f"'n_hits': CAST(len(regexp_extract_all({text}, {_q(risk.wide_spaces(regex))})) AS INTEGER)",
            f"'min_hits': {min_hits}", f"'tmpl': {_q(desc)}", f"'suggestion': {_q(sugg)}"]) + "}")
    return "[" + ",\n ".join(items) + "]"


def _scan_sql(packs):
    return with_views(f"""
SELECT doc_id, type, category, pattern_ord, severity, n_hits,
       replace(tmpl, '{{n}}', CAST(n_hits AS VARCHAR)) AS description, suggestion
FROM (SELECT doc_id, unnest({_struct_list(packs)}, recursive := true) FROM code_docs)
WHERE n_hits >= min_hits""", "code_docs")


def _scan_query(packs):
    def q(spark, sf_dir):
        return risk.scan(code_docs(spark, sf_dir), "text", ["doc_id"], packs)
    return q


for _name, _pack in [("risk_security", "security"), ("risk_license", "license"),
                     ("risk_compat", "compatibility"), ("risk_perf", "performance"),
                     ("risk_maintain", "maintainability")]:
    register(_name, _scan_sql((_pack,)))(_scan_query((_pack,)))


_DEDUP_SQL = with_views(f"""
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY first_ord) AS INTEGER) AS flag_ord,
       type, severity, description, suggestion
FROM (SELECT pair_id, type, severity, description, min(pattern_ord) AS first_ord, min(suggestion) AS suggestion
      FROM (SELECT pair_id, type, pattern_ord, severity, suggestion,
                   replace(tmpl, '{{n}}', CAST(n_hits AS VARCHAR)) AS description, n_hits, min_hits
            FROM (SELECT pair_id, unnest({_struct_list(risk.LIVE_PACKS, 'refactored')}, recursive := true)
                  FROM code_pairs WHERE coalesce(include_security_scan, true)))
      WHERE n_hits >= min_hits
      GROUP BY pair_id, type, severity, description)""", "code_pairs")


@register("risk_all_dedup", _DEDUP_SQL)
def risk_all_dedup(spark, sf_dir):
    return risk.risk_flags(code_pairs(spark, sf_dir), "refactored", ["pair_id"], "include_security_scan")
