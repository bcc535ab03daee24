"""DuckDB twins of the derived inputs, as composable CTEs.

``with_views(body, *names)`` prefixes ``body`` with the named CTEs and all
the CTEs they depend on, in dependency order.
"""

from __future__ import annotations

from codedelta.rules import KPIS
from codedelta.sources.snippets import snippet_rows

LINE_RE = r"'[^\n]*\n|[^\n]+'"


def _q(s):
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def _snippets_values() -> str:
    rows = ",\n".join(f"({i}, {_q(lang)}, {_q(code)}, {_q(hf)}, {_q(ht)})"
                      for i, lang, code, hf, ht in snippet_rows())
    return f"SELECT * FROM (VALUES {rows}) v(snip_id, language, code, hint_from, hint_to)"


def _kpis_values() -> str:
    rows = ", ".join(f"({_q(k)}, {_q(n)}, {_q(d)}, {w})" for k, n, d, w in KPIS)
    return f"SELECT * FROM (VALUES {rows}) v(kpi, name, description, default_weight)"


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("snippets", [], _snippets_values())
view("kpis", [], _kpis_values())
view("code_docs", ["snippets"], """
SELECT d.doc_id, s.snip_id, s.language, d.text || chr(10) || s.code AS text
FROM documents d JOIN snippets s ON d.doc_id % 24 = s.snip_id""")
view("code_pairs", ["snippets"], """
SELECT 'p' || CAST(d.doc_id AS VARCHAR) AS pair_id, d.doc_id,
       CASE WHEN d.doc_id % 41 = 40 THEN 'cobol' ELSE n.language END AS language,
       d.text || chr(10) || o.code AS legacy,
       d.text || chr(10) || n.code AS refactored,
       o.hint_from, o.hint_to,
       d.doc_id % 9 <> 4 AS include_security_scan,
       'org' || CAST(d.doc_id % 5 AS VARCHAR) AS org,
       CASE WHEN d.doc_id % 13 <> 12 THEN 'u' || CAST(d.doc_id % 13 AS VARCHAR) END AS user_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 60) AS submitted_at
FROM documents d
JOIN snippets o ON d.doc_id % 24 = o.snip_id
JOIN snippets n ON (d.doc_id + 1) % 24 = n.snip_id""")
view("near_pairs", [], f"""
WITH l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {LINE_RE})) AS line FROM documents),
f AS (SELECT line, min(doc_id) AS first_doc FROM l GROUP BY line),
s AS (SELECT l.doc_id, f.first_doc, count(*) AS n FROM l JOIN f USING (line)
      WHERE l.doc_id > f.first_doc GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_doc) AS rn FROM s)
SELECT r.doc_id AS k, a.text AS old, b.text AS nw
FROM r JOIN documents a ON a.doc_id = r.first_doc JOIN documents b ON b.doc_id = r.doc_id
WHERE rn = 1""")
view("turn_pairs", [], """
SELECT c.conv_id, c.turn, p.text AS old, c.text AS nw
FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn""")
view("diff_pairs", ["code_pairs", "near_pairs", "turn_pairs"], f"""
SELECT pair_id, legacy, refactored FROM code_pairs
UNION ALL SELECT 'n' || CAST(k AS VARCHAR), old, nw FROM near_pairs
UNION ALL SELECT 'm' || CAST(k AS VARCHAR), old,
                 array_to_string(list_reverse(regexp_extract_all(nw, {LINE_RE})), '') FROM near_pairs
UNION ALL SELECT 't' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), old, nw FROM turn_pairs""")
view("tool_scores", [], """
WITH ps AS (SELECT l_suppkey, count(*) AS cnt, sum(l_quantity) AS qty, max(l_extendedprice) AS max_price,
                   min(l_extendedprice) AS min_price, sum(l_discount) AS disc,
                   count(*) FILTER (WHERE l_returnflag = 'R') AS returned
            FROM lineitem GROUP BY l_suppkey),
w AS (SELECT r_name, n_name, n_nationkey,
             CAST(sum(cnt) AS DOUBLE) AS K1, round(sum(qty), 6) AS K2, round(sum(qty) / sum(cnt), 6) AS K3,
             round(max(max_price), 6) AS K4, round(min(min_price), 6) AS K5,
             round(sum(disc) / sum(cnt), 6) AS K6, CAST(sum(returned) AS DOUBLE) AS K7
      FROM ps JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, n_nationkey)
SELECT r_name AS group_id, n_name AS tool, CAST(n_nationkey AS INTEGER) AS tool_idx, kpi, score
FROM w UNPIVOT (score FOR kpi IN (K1, K2, K3, K4, K5, K6, K7))""")


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None,
               recursive: bool = False) -> str:
    """``WITH`` the named views (and their dependencies), then ``extra``
    (name, sql) CTEs in the given order, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in (extra or [])]
    if not parts:
        return body
    recursive = recursive or any("(" in n for n, _ in (extra or []))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
