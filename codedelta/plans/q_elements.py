"""Element extraction, mapping and element-diff queries over code pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codedelta.operators import elements as E
from codedelta.operators import mapping as M
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import _q, with_views
from codedelta.sources.derived import code_pairs

ELEMENT_COLS = ["pair_id", "side", "ord", "kind", "line", "name", "parameters", "imports", "text"]
D = "CAST({} AS DOUBLE)"


# The oracle's own patterns, written apart from the engine's, and set logic in place of its scan: brackets, strings and comments are rows, a
# bracket's partner is the first later one of its kind at a lower running depth.
_STRINGS = r""""(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'"""
_SLASHES = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_MARKS = {
    "java": r'"""[\s\S]*?"""|' + _STRINGS + "|" + _SLASHES + r"|[(){}\[\]]",
    "javascript": _STRINGS + r"|`(?:[^`\\]|\\[\s\S])*`|" + _SLASHES + r"|[(){}\[\]]",
    "c": _STRINGS + "|" + _SLASHES + r"|[(){}\[\]]",
    "python": r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + _STRINGS + r"|#[^\n]*|[(){}\[\]]",
}
_MODS = r"(?:@[$\w]+(?:\([^()\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*"
# What stands before a statement, and (kind, statement start up to the name or parenthesis).
_STARTS = {
    "javascript": ("[;{}]", [
        ("function_declaration", r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*[*]?[ \t]*[$\w]*\s*\("),
        ("function", r"(?:export[ \t]+)?(?:const|let|var)[ \t]+[$\w]+[ \t]*=\s*(?:async[ \t]+)?function[ \t]*[*]?[ \t]*[$\w]*\s*\("),
        ("import_statement", "import")]),
    "java": ("[;{}]", [
        ("class_declaration", _MODS + r"class[ \t]+[$\w]+"), ("import_declaration", r"import[ \t]+(?:static[ \t]+)?[\w.*]+[ \t]*"),
        ("method_declaration", _MODS + r"[A-Za-z_<][\w<>,.?\[\] \t]*[ \t][$\w]+\s*\(")]),
    "python": (";", [
        ("function_definition", r"(?:async[ \t]+)?def[ \t]+\w+[ \t]*\("), ("import_statement", r"import[ \t]"),
        ("import_from_statement", r"from[ \t]+[^ \t\r\n]+[ \t]+import")]),
    "c": ("[;{}]", [
        ("preproc_include", r"#[ \t]*include"), ("function_definition", r"[A-Za-z_][\w:<>,*& \t]*[ \t*&\r\n][A-Za-z_][\w:~]*[ \t]*\(")]),
}
_STATEMENTS = {
    "javascript": r"^import(?:[^;\n{]|\{[^{};]*\})*;?", "java": r"^import[^;]*;",
    "python": r"^(?:import[ \t][^;\n]*|from[ \t]+[^ \t\r\n]+[ \t]+import[ \t]*(?:\([^()]*\)|[^;\n(]*))", "c": r"^#[ \t]*include[^\n]*",
}
_NOT_NAMES = ", ".join(_q(k) for k in ("if for while switch catch return new else do try sizeof throw case synchronized").split())
_NOT_TYPES = r"(?:^|[^$\w])(?:if|for|while|switch|catch|return|new|else|do|try|sizeof|throw|case)(?:[^$\w]|$)"
_IMPORTS = "'import_statement', 'import_declaration', 'import_from_statement', 'preproc_include'"
_PARAMETER = _q(r"""(?:[^,()<>\[\]{}"']|"[^"]*"|'[^']*'|=>|[(<\[{](?:[^()<>\[\]{}]|[(<\[{](?:[^()<>\[\]{}]|[(<\[{][^()<>\[\]{}]*[)>\]}])*[)>\]}])*[)>\]}]|["'<>()\[\]{}])+""")
_TRIM = "' ' || chr(9) || chr(13) || chr(10)"


def _by_language(make):
    """A CASE over the languages; C++ goes as C."""
    return "CASE " + " ".join(f"WHEN fam = {_q(lang)} THEN {make(lang)}" for lang in _STARTS) + " END"


def _heads_sql(group):
    def one(lang):
        before, heads = _STARTS[lang]
        return "regexp_extract_all(t, " + _q(rf"(?m)([\s\S]*?(?:^|{before}))([ \t]*(?:" + "|".join(h for _, h in heads) + "))") + f", {group})"
    return _by_language(one)


def _marks_sql(group):
    return _by_language(lambda lang: f"regexp_extract_all(t, {_q(r'([\s\S]*?)(' + _MARKS[lang] + ')')}, {group})")


def _kind_sql():
    return _by_language(lambda lang: "CASE " + " ".join(
        f"WHEN regexp_full_match(sig, {_q(r'[ \t]*(?:' + h + ')')}) THEN {_q(k)}" for k, h in _STARTS[lang][1]) + " END")


ELEMENT_CTES = [
    ("sides", """SELECT pair_id, CASE WHEN language = 'cpp' THEN 'c' ELSE language END AS fam, side, t FROM (
            SELECT pair_id, language, 'legacy' AS side, legacy AS t FROM code_pairs UNION ALL SELECT pair_id, language, 'refactored', refactored FROM code_pairs)
          WHERE language IN ('javascript', 'java', 'python', 'c', 'cpp')"""),
    ("mk", f"""SELECT pair_id, side, tok, i, sum(length(gap) + length(tok)) OVER (PARTITION BY pair_id, side ORDER BY i) - length(tok) AS pos FROM (
            SELECT pair_id, side, unnest({_marks_sql(1)}) AS gap, unnest({_marks_sql(2)}) AS tok,
                   unnest(range(1, len({_marks_sql(2)}) + 1)) AS i FROM sides)"""),
    ("spans", "SELECT pair_id, side, pos, pos + length(tok) AS stop FROM mk WHERE tok NOT IN ('(', ')', '[', ']', '{', '}')"),
    ("br", """SELECT pair_id, side, pos, tok,
            sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) OVER w AS dp,
            sum(CASE WHEN tok = '{' THEN 1 WHEN tok = '}' THEN -1 ELSE 0 END) OVER w AS dc,
            sum(CASE WHEN tok IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER w AS da
          FROM mk WHERE tok IN ('(', ')', '[', ']', '{', '}') WINDOW w AS (PARTITION BY pair_id, side ORDER BY pos)"""),
    ("hd", f"""SELECT pair_id, fam, side, t, i, sig, sum(length(gap) + length(sig)) OVER (PARTITION BY pair_id, side ORDER BY i) AS send FROM (
            SELECT pair_id, fam, side, t, unnest({_heads_sql(1)}) AS gap, unnest({_heads_sql(2)}) AS sig,
                   unnest(range(1, len({_heads_sql(2)}) + 1)) AS i FROM sides)"""),
    ("kd", f"""SELECT *, {_kind_sql()} AS kind, length(regexp_extract(sig, '^[ \\t]*')) AS lead, send - length(ltrim(sig, ' ' || chr(9))) AS start,
            CASE WHEN sig LIKE '%(' THEN regexp_extract(sig, '([$\\w:~]*)\\s*\\($', 1) WHEN sig LIKE '%class%' THEN regexp_extract(sig, '[$\\w]+$') END AS nm FROM hd"""),
    # Parentheses: the partner of the one that ends the signature.
    ("cl", """SELECT k.pair_id, k.side, k.i, min(c.pos) AS q FROM kd k
          JOIN br o ON o.pair_id = k.pair_id AND o.side = k.side AND o.pos = k.send - 1 AND o.tok = '('
          JOIN br c ON c.pair_id = k.pair_id AND c.side = k.side AND c.pos > o.pos AND c.tok = ')' AND c.dp < o.dp
          WHERE k.kind IN ('function_declaration', 'function', 'method_declaration', 'function_definition') GROUP BY ALL"""),
    ("tl", f"""SELECT k.*, cl.q, CASE
              WHEN kind = 'class_declaration' THEN send + length(regexp_extract(substr(t, CAST(send + 1 AS BIGINT)), '^[^;{{}}()]*\\{{'))
              WHEN fam = 'javascript' THEN q + 1 + length(regexp_extract(substr(t, CAST(q + 2 AS BIGINT)), '^[ \\t\\r\\n]*\\{{'))
              WHEN fam = 'java' THEN q + 1 + length(regexp_extract(substr(t, CAST(q + 2 AS BIGINT)), '^[ \\t\\r\\n]*(?:throws[ \\t\\r\\n]+[\\w., \\t\\r\\n]+)?\\{{'))
              WHEN fam = 'c' THEN q + 1 + length(regexp_extract(substr(t, CAST(q + 2 AS BIGINT)), '^[ \\t\\r\\n]*(?:const[ \\t\\r\\n]*)?\\{{')) END - 1 AS b
          FROM kd k LEFT JOIN cl ON cl.pair_id = k.pair_id AND cl.side = k.side AND cl.i = k.i
          WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.pair_id = k.pair_id AND s.side = k.side AND s.pos <= k.start AND k.start < s.stop)"""),
    ("cb", """SELECT x.pair_id, x.side, x.i, min(c.pos) AS stop FROM tl x
          JOIN br o ON o.pair_id = x.pair_id AND o.side = x.side AND o.pos = x.b AND o.tok = '{'
          JOIN br c ON c.pair_id = x.pair_id AND c.side = x.side AND c.pos > o.pos AND c.tok = '}' AND c.dc < o.dc GROUP BY ALL"""),
    # Lines of Python texts that can end a body, with the depth before them.
    ("pyl", """SELECT pair_id, side, line, sum(length(line) + 1) OVER (PARTITION BY pair_id, side ORDER BY n) - length(line) - 1 AS pos FROM (
            SELECT pair_id, side, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n
            FROM sides WHERE fam = 'python')"""),
    ("pyd", """SELECT l.pair_id, l.side, l.pos, length(regexp_extract(line, '^[ \\t]*')) AS indent, coalesce(b.da, 0) AS depth
          FROM (SELECT * FROM pyl WHERE regexp_matches(line, '^[ \\t]*[^ \\t\\r#]')
                AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.pair_id = pyl.pair_id AND s.side = pyl.side AND s.pos <= pyl.pos AND pyl.pos < s.stop)) l
          ASOF LEFT JOIN br b ON b.pair_id = l.pair_id AND b.side = l.side AND b.pos < l.pos"""),
    ("pye", """SELECT x.pair_id, x.side, x.i, min(p.pos) AS stop
          FROM (SELECT x.pair_id, x.side, x.i, x.q, x.lead, coalesce(b.da, 0) AS depth FROM (SELECT * FROM tl WHERE kind = 'function_definition' AND fam = 'python') x
                ASOF LEFT JOIN br b ON b.pair_id = x.pair_id AND b.side = x.side AND b.pos < x.start) x
          JOIN pyd p ON p.pair_id = x.pair_id AND p.side = x.side AND p.pos > x.q AND p.indent <= x.lead AND p.depth <= x.depth GROUP BY ALL"""),
    ("ek", f"""SELECT x.*, CASE
              WHEN kind IN ({_IMPORTS}) THEN start + length({_by_language(lambda lang: f"regexp_extract(substr(t, CAST(start + 1 AS BIGINT)), {_q(_STATEMENTS[lang])})")})
              WHEN fam = 'python' THEN coalesce(pye.stop, length(t))
              WHEN kind = 'class_declaration' AND b >= send THEN coalesce(cb.stop + 1, length(t))
              WHEN b > q THEN coalesce(cb.stop + 1, length(t))
              WHEN fam = 'javascript' THEN q + 1 END AS stop
          FROM tl x LEFT JOIN cb ON cb.pair_id = x.pair_id AND cb.side = x.side AND cb.i = x.i
          LEFT JOIN pye ON pye.pair_id = x.pair_id AND pye.side = x.side AND pye.i = x.i
          WHERE CASE WHEN kind = 'import_statement' AND fam = 'javascript' THEN substr(t, CAST(send + 1 AS BIGINT), 1) IN (' ', chr(9), '{{', '"', '''', '*')
                     WHEN kind = 'import_declaration' THEN substr(t, CAST(send + 1 AS BIGINT), 1) = ';'
                     WHEN kind IN ({_IMPORTS}, 'class_declaration') THEN true
                     ELSE q IS NOT NULL AND nm NOT IN ({_NOT_NAMES})
                       AND (fam NOT IN ('java', 'c') OR NOT regexp_matches(regexp_replace(substr(sig, CAST(lead + 1 AS BIGINT)), '[$\\w:~]*\\s*\\($', ''), {_q(_NOT_TYPES)}))
                       AND (fam <> 'java' OR length(regexp_replace(regexp_replace(substr(sig, CAST(lead + 1 AS BIGINT)), '[$\\w]*\\s*\\($', ''), {_q('^' + _MODS)}, '')) > 0) END"""),
    ("els", f"""SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY start) - 1 AS INTEGER) AS ord, kind,
                CAST(1 + length(substr(t, 1, CAST(start AS BIGINT))) - length(replace(substr(t, 1, CAST(start AS BIGINT)), chr(10), '')) AS INTEGER) AS line,
                CASE WHEN fam = 'c' AND kind = 'function_definition'
                       THEN nm || regexp_extract(sig, '([ \\t]*)\\($', 1) || substr(t, CAST(send AS BIGINT), CAST(q - send + 2 AS BIGINT))
                     WHEN length(nm) > 0 THEN nm END AS name,
                CASE WHEN q IS NOT NULL
                     THEN list_filter(list_transform(regexp_extract_all(substr(t, CAST(send + 1 AS BIGINT), CAST(q - send AS BIGINT)), {_PARAMETER}), lambda p: trim(p, {_TRIM})), lambda p: length(p) > 0)
                     ELSE []::VARCHAR[] END AS parameters,
                CASE WHEN kind IN ({_IMPORTS}) THEN [trim(substr(t, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), {_TRIM})] ELSE []::VARCHAR[] END AS imports,
                trim(substr(t, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), {_TRIM}) AS text
          FROM ek WHERE stop IS NOT NULL"""),
]

_SIM_SQL = f"""CASE WHEN l.name = r.name THEN {D.format('1.0')} ELSE
  (CASE WHEN greatest(length(l.name), length(r.name)) > 0
        THEN 1 - levenshtein(l.name, r.name) / greatest(length(l.name), length(r.name))
        ELSE {D.format('0.0')} END) * {D.format('0.5')}
  + (CASE WHEN l.kind = r.kind THEN {D.format('1.0')} ELSE {D.format('0.5')} END) * {D.format('0.3')}
  + (CASE WHEN len(l.parameters) = 0 AND len(r.parameters) = 0 THEN {D.format('1.0')}
          WHEN len(l.parameters) = 0 OR len(r.parameters) = 0 THEN {D.format('0.0')}
          ELSE len(list_filter(l.parameters, lambda x: list_contains(r.parameters, x)))
               / greatest(len(l.parameters), len(r.parameters)) END) * {D.format('0.2')} END"""

MAPPING_CTES = ELEMENT_CTES + [
    ("nm", "SELECT * FROM els WHERE name IS NOT NULL AND name <> ''"),
    ("fb", "SELECT pair_id, side, name, min(ord) AS ord FROM nm GROUP BY pair_id, side, name"),
    ("hm", """SELECT c.pair_id, l.ord AS l_ord, arg_max(r.ord, c.hint_to) AS r_ord FROM code_pairs c
          JOIN fb l ON l.pair_id = c.pair_id AND l.side = 'legacy' AND l.name = c.hint_from
          JOIN fb r ON r.pair_id = c.pair_id AND r.side = 'refactored' AND r.name = c.hint_to
          GROUP BY c.pair_id, l.ord"""),
    ("cand", f"""SELECT l.pair_id, l.ord AS l_ord, r.ord AS r_ord, {_SIM_SQL} AS sim
          FROM nm l JOIN nm r ON l.pair_id = r.pair_id AND l.side = 'legacy' AND r.side = 'refactored'
          WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.pair_id = l.pair_id AND hm.l_ord = l.ord)"""),
    ("best", """SELECT pair_id, l_ord, r_ord, sim FROM (
            SELECT *, row_number() OVER (PARTITION BY pair_id, l_ord ORDER BY sim DESC, r_ord) AS rn
            FROM cand WHERE sim > 0.7) WHERE rn = 1"""),
    ("mp", """SELECT pair_id, l_ord, r_ord, 'hint' AS source FROM hm
          UNION ALL
          SELECT pair_id, l_ord, r_ord, CASE WHEN sim = 1.0 THEN 'name' ELSE 'fuzzy' END FROM best"""),
]

_EQUIV = ("o.kind = x.kind AND o.text = x.text AND o.name IS NOT DISTINCT FROM x.name "
          "AND o.parameters = x.parameters AND o.imports = x.imports")

NODE_CTES = MAPPING_CTES + [
    ("added", f"""SELECT x.* FROM els x WHERE x.side = 'refactored'
          AND NOT EXISTS (SELECT 1 FROM els o WHERE o.pair_id = x.pair_id AND o.side = 'legacy' AND {_EQUIV})
          AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.pair_id = x.pair_id AND mp.r_ord = x.ord)"""),
    ("removed", f"""SELECT o.* FROM els o WHERE o.side = 'legacy'
          AND NOT EXISTS (SELECT 1 FROM els x WHERE x.pair_id = o.pair_id AND x.side = 'refactored' AND {_EQUIV})
          AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.pair_id = o.pair_id AND mp.l_ord = o.ord)"""),
    ("modified", f"""SELECT mp.pair_id, mp.l_ord, mp.r_ord,
            list_filter([CASE WHEN o.kind <> x.kind THEN 'Type changed: ' || o.kind || ' -> ' || x.kind END,
                         CASE WHEN o.text <> x.text THEN 'Content modified' END,
                         CASE WHEN NOT (o.name IS NOT DISTINCT FROM x.name AND o.parameters = x.parameters
                                        AND o.imports = x.imports) THEN 'Metadata changed' END],
                        lambda c: c IS NOT NULL) AS changes
          FROM mp JOIN els o ON o.pair_id = mp.pair_id AND o.side = 'legacy' AND o.ord = mp.l_ord
                  JOIN els x ON x.pair_id = mp.pair_id AND x.side = 'refactored' AND x.ord = mp.r_ord
          WHERE NOT ({_EQUIV})"""),
    ("node_counts", """SELECT c.pair_id,
            CAST((SELECT count(*) FROM added a WHERE a.pair_id = c.pair_id) AS BIGINT) AS nodes_added,
            CAST((SELECT count(*) FROM removed r WHERE r.pair_id = c.pair_id) AS BIGINT) AS nodes_removed,
            CAST((SELECT count(*) FROM modified m WHERE m.pair_id = c.pair_id) AS BIGINT) AS nodes_modified
          FROM code_pairs c WHERE c.language IN ('javascript', 'java', 'python', 'c', 'cpp')"""),
]


def _elements_sql(langs):
    inlist = ", ".join(_q(x) for x in langs)
    return with_views(f"""
SELECT e.pair_id, e.side, e.ord, e.kind, e.line, e.name, e.parameters, e.imports, e.text
FROM els e JOIN code_pairs c USING (pair_id) WHERE c.language IN ({inlist})""", "code_pairs", extra=ELEMENT_CTES)


def _elements_query(langs):
    def q(spark, sf_dir):
        cp = code_pairs(spark, sf_dir).filter(F.col("language").isin(langs))
        return E.elements(cp).select(*ELEMENT_COLS)
    return q


for _name, _langs in [("elements_js", ["javascript"]), ("elements_java", ["java"]),
                      ("elements_py", ["python"]), ("elements_c", ["c", "cpp"])]:
    register(_name, _elements_sql(_langs))(_elements_query(_langs))


def _changed(spark, sf_dir):
    """Element arrays and changes of all pairs, in the row."""
    return M.element_changes(code_pairs(spark, sf_dir))


@register("map_hints", with_views("SELECT pair_id, l_ord, r_ord FROM hm", "code_pairs", extra=MAPPING_CTES))
def map_hints(spark, sf_dir):
    return M.mapping_rows(M.changed_positions(code_pairs(spark, sf_dir))).filter("source = 'hint'").select("pair_id", "l_ord", "r_ord")


@register("map_fuzzy", with_views("SELECT pair_id, l_ord, r_ord, source FROM mp", "code_pairs", extra=MAPPING_CTES))
def map_fuzzy(spark, sf_dir):
    return M.mapping_rows(M.changed_positions(code_pairs(spark, sf_dir)))


def _nodes(changed, elements, positions):
    rows = changed.select("pair_id", F.explode(M.at_positions(F.col(elements), F.col(positions))).alias("e"))
    return rows.select("pair_id", "e.ord", "e.kind", "e.name")


@register("node_added", with_views("SELECT pair_id, ord, kind, name FROM added", "code_pairs", extra=NODE_CTES))
def node_added(spark, sf_dir):
    return _nodes(_changed(spark, sf_dir), "_re", "_ch.added")


@register("node_removed", with_views("SELECT pair_id, ord, kind, name FROM removed", "code_pairs", extra=NODE_CTES))
def node_removed(spark, sf_dir):
    return _nodes(_changed(spark, sf_dir), "_le", "_ch.removed")


@register("node_modified", with_views("SELECT pair_id, l_ord, r_ord, changes FROM modified", "code_pairs",
                                      extra=NODE_CTES))
def node_modified(spark, sf_dir):
    rows = _changed(spark, sf_dir).select("pair_id", F.explode(M.modified_array()).alias("m"))
    return rows.select("pair_id", "m.l_ord", "m.r_ord", "m.changes")


@register("ast_summary", with_views("""
SELECT pair_id, nodes_added, nodes_removed, nodes_modified,
       concat_ws(', ', CASE WHEN nodes_added > 0 THEN CAST(nodes_added AS VARCHAR) || ' nodes added' END,
                       CASE WHEN nodes_removed > 0 THEN CAST(nodes_removed AS VARCHAR) || ' nodes removed' END,
                       CASE WHEN nodes_modified > 0 THEN CAST(nodes_modified AS VARCHAR) || ' nodes modified' END)
         AS ast_diff_summary,
       CAST(least(nodes_added * 2 + nodes_removed * 3 + nodes_modified, 100) AS BIGINT) AS impact_score
FROM node_counts""", "code_pairs", extra=NODE_CTES))
def ast_summary(spark, sf_dir):
    parsed = code_pairs(spark, sf_dir).filter(F.col("language").isin(E.LANGUAGES))
    c = M.changed_positions(parsed).select("pair_id", *[F.size(F.col("_ch")[n]).cast("long").alias(f"nodes_{n}") for n in ("added", "removed", "modified")])
    a, r, m = F.col("nodes_added"), F.col("nodes_removed"), F.col("nodes_modified")
    return c.select("pair_id", a, r, m, M.diff_summary(a, r, m).alias("ast_diff_summary"),
                    M.element_impact(a, r, m).cast("long").alias("impact_score"))


_LEAVES = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\r\f\v]"
_TOKENS_SQL = _by_language(lambda lang: f"regexp_extract_all(t, {_q(_MARKS[lang].replace('|' + '[(){}' + chr(92) + '[' + chr(92) + ']]', '') + '|' + _LEAVES)})")

# Depths are running sums; closing brackets that meet no open one only lower the least depth so far.
NODE_TREE_CTES = [ELEMENT_CTES[0]] + [
    ("nt", f"""SELECT pair_id, side, i, tok, sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER w AS d,
            sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 ELSE 0 END) OVER w AS opens
          FROM (SELECT pair_id, side, unnest({_TOKENS_SQL}) AS tok, unnest(range(1, len({_TOKENS_SQL}) + 1)) AS i FROM sides)
          WINDOW w AS (PARTITION BY pair_id, side ORDER BY i)"""),
    ("nc", """SELECT *, d - least(0, min(d) OVER w) AS c, i + opens AS pre FROM nt WINDOW w AS (PARTITION BY pair_id, side ORDER BY i)"""),
    ("nl", """SELECT *, 1 + greatest(c, coalesce(lag(c) OVER (PARTITION BY pair_id, side ORDER BY i), 0)) AS depth FROM nc"""),
    ("nn", """SELECT s.pair_id, s.side, coalesce(max(l.pre), 0) AS last FROM sides s LEFT JOIN nl l ON l.pair_id = s.pair_id AND l.side = s.side GROUP BY ALL"""),
    ("ng", """SELECT o.pair_id, o.side, o.pre - 1 AS pre, coalesce(min(z.pre), any_value(nn.last)) AS post, any_value(o.c) AS depth
          FROM nl o JOIN nn ON nn.pair_id = o.pair_id AND nn.side = o.side
          LEFT JOIN nl z ON z.pair_id = o.pair_id AND z.side = o.side AND z.tok IN (')', ']', '}') AND z.i > o.i AND z.d < o.d
          WHERE o.tok IN ('(', '[', '{') GROUP BY o.pair_id, o.side, o.pre"""),
    ("nd", """SELECT pair_id, side, pre, post, depth, 'group' AS kind FROM ng
          UNION ALL SELECT pair_id, side, 0, last, 0, 'program' FROM nn
          UNION ALL SELECT pair_id, side, pre, pre, depth,
                      CASE WHEN regexp_matches(tok, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(tok, '^[0-9]') THEN 'number'
                           WHEN length(tok) = 1 AND tok <> '#' THEN 'punctuation' WHEN tok = '#' AND pair_id IN (SELECT pair_id FROM sides WHERE fam <> 'python') THEN 'punctuation'
                           WHEN regexp_matches(tok, '^[/#]') THEN 'comment' ELSE 'string' END FROM nl"""),
]


def _trees(spark, sf_dir):
    return code_pairs(spark, sf_dir).filter(F.col("language").isin(E.LANGUAGES))


@register("node_rows", with_views("""
SELECT n.pair_id, CAST(n.pre AS INTEGER) AS pre, CAST(n.post AS INTEGER) AS post, CAST(n.depth AS INTEGER) AS depth,
       CASE WHEN n.depth = 1 THEN 0 ELSE CAST(g.pre AS INTEGER) END AS parent, n.kind, CAST(n.post - n.pre + 1 AS INTEGER) AS size
FROM nd n ASOF LEFT JOIN ng g ON g.pair_id = n.pair_id AND g.side = n.side AND g.depth = n.depth - 1 AND g.pre < n.pre
WHERE n.side = 'refactored'""", "code_pairs", extra=NODE_TREE_CTES))
def node_rows(spark, sf_dir):
    """Every node of every refactored text."""
    return E.node_rows(_trees(spark, sf_dir)).filter("side = 'refactored'").select("pair_id", "pre", "post", "depth", "parent", "kind", "size")


@register("subtree_counts", with_views("""
SELECT g.pair_id, g.side, CAST(g.pre AS INTEGER) AS pre, CAST(g.depth AS INTEGER) AS depth, CAST(g.post - g.pre + 1 AS INTEGER) AS size,
       """ + ", ".join(f"count(*) FILTER (WHERE n.kind = '{k}') AS n_{k}" for k in E.COUNTED_KINDS) + """
FROM nd g JOIN nd n ON n.pair_id = g.pair_id AND n.side = g.side AND n.pre BETWEEN g.pre AND g.post
WHERE g.kind IN ('group', 'program') GROUP BY g.pair_id, g.side, g.pre, g.depth, g.post""", "code_pairs", extra=NODE_TREE_CTES))
def subtree_counts(spark, sf_dir):
    return E.subtree_counts(_trees(spark, sf_dir))
