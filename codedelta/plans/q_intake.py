"""Request intake queries: JSON in strings, domain checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codedelta.operators import store as ST
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import _q, with_views
from codedelta.rules import ACCEPTED_LANGUAGES, SOURCE_TYPES
from codedelta.sources.derived import code_pairs
from codedelta.sources.intake import OPTIONS, parse_requests
from codedelta.sources.tables import read_table

# Raw requests made from the code pairs; by doc_id some fields are cut off, no object, of a wrong type or absent.
_URLS = ["https://git.example.org/a/b.git", "git@git.example.org:a/b", "ssh://git@h:22/x?ref=1#top", "", "http://a b/", "file:///srv/x%20y"]


def _pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def raw_requests(spark, sf_dir):
    cp = code_pairs(spark, sf_dir)
    i = F.col("doc_id")

    def side(text, shift):
        k = (i + shift) % 23
        paste = F.to_json(F.struct(F.lit("paste").alias("type"), F.col(text).alias("content")))
        repo = F.to_json(F.struct(F.lit("repo").alias("type"), _pick(_URLS, i).alias("url"), F.lit("main").alias("ref")))
        return (F.when(k == 3, F.concat(F.lit('{"type": "paste", "content": '), i.cast("string")))
                .when(k == 5, F.lit('["paste"]')).when(k == 7, F.lit('{"type": "paste", "content": 5, "files": {}}'))
                .when(k == 9, F.lit('{"type": 1}')).when(k == 11, F.lit('{"content": "x"}')).when(k == 13, F.lit(None).cast("string"))
                .when(k == 15, F.lit("no json")).when(k == 17, F.lit('{"type": "file", "files": ["a.py", "b.py"], "content": ""}'))
                .when(k.isin(1, 19), repo).otherwise(paste))
    k = i % 19
    options = (F.when(k == 2, F.lit('{"includeSecurityScan": false, "runStaticChecks": "TRUE"}')).when(k == 4, F.lit('{"analyzeTests": "no", "mapHints": []}'))
               .when(k == 6, F.lit("{broken")).when(k == 8, F.lit('{"mapHints": {"a": "b", "c": "d"}}')).when(k == 10, F.lit("null"))
               .when(k == 12, F.lit(None).cast("string")).otherwise(F.lit("{}")))
    return cp.select(F.col("pair_id").alias("id"), F.when(i % 29 == 7, F.lit("fortran")).otherwise(F.col("language")).alias("language"),
                     side("legacy", 0).alias("legacy"), side("refactored", 4).alias("refactored"), options.alias("options"))


def _raw_side(text, shift):
    k = f"(doc_id + {shift}) % 23"
    urls = "[" + ", ".join(_q(u) for u in _URLS) + "]"
    return f"""CASE {k} WHEN 3 THEN '{{"type": "paste", "content": ' || CAST(doc_id AS VARCHAR) WHEN 5 THEN '["paste"]'
        WHEN 7 THEN '{{"type": "paste", "content": 5, "files": {{}}}}' WHEN 9 THEN '{{"type": 1}}' WHEN 11 THEN '{{"content": "x"}}' WHEN 13 THEN NULL
        WHEN 15 THEN 'no json' WHEN 17 THEN '{{"type": "file", "files": ["a.py", "b.py"], "content": ""}}'
        WHEN 1 THEN CAST(json_object('type', 'repo', 'url', {urls}[doc_id % {len(_URLS)} + 1], 'ref', 'main') AS VARCHAR)
        WHEN 19 THEN CAST(json_object('type', 'repo', 'url', {urls}[doc_id % {len(_URLS)} + 1], 'ref', 'main') AS VARCHAR)
        ELSE CAST(json_object('type', 'paste', 'content', {text}) AS VARCHAR) END"""


_RAW_SQL = f"""SELECT pair_id AS id, CASE WHEN doc_id % 29 = 7 THEN 'fortran' ELSE language END AS language,
  {_raw_side('legacy', 0)} AS legacy, {_raw_side('refactored', 4)} AS refactored,
  CASE doc_id % 19 WHEN 2 THEN '{{"includeSecurityScan": false, "runStaticChecks": "TRUE"}}' WHEN 4 THEN '{{"analyzeTests": "no", "mapHints": []}}'
    WHEN 6 THEN '{{broken' WHEN 8 THEN '{{"mapHints": {{"a": "b", "c": "d"}}}}' WHEN 10 THEN 'null' WHEN 12 THEN NULL ELSE '{{}}' END AS options
FROM code_pairs"""

_FIELDS = ["legacy", "refactored", "options"]
_OBJ_SQL = "SELECT *, " + ", ".join(f"CASE WHEN json_valid({f}) AND json_type({f}) = 'OBJECT' THEN {f} END AS o_{f}" for f in _FIELDS) + " FROM raw"


def _side_sql(f):
    o, types = f"o_{f}", "[" + ", ".join(SOURCE_TYPES) + "]"
    kind = lambda m: f"json_type({o}, '$.{m}')"
    val = lambda m: f"json_extract_string({o}, '$.{m}')"
    known = f"coalesce({kind('type')} = 'VARCHAR' AND {val('type')} IN ({', '.join(_q(t) for t in SOURCE_TYPES)}), false)"
    out = [(f"{f} IS NULL", f'"{f}" is required'), (f"{f} IS NOT NULL AND {o} IS NULL", f'"{f}" must be of type object'),
           (f"{o} IS NOT NULL AND {kind('type')} IS NULL", f'"{f}.type" is required'),
           (f"{kind('type')} IS NOT NULL AND NOT {known}", f'"{f}.type" must be one of {types}')]
    for m, by in (("content", "paste"), ("url", "repo")):
        needed = f"{known} AND {val('type')} = '{by}'"
        out += [(f"{needed} AND {kind(m)} IS NULL", f'"{f}.{m}" is required'), (f"{kind(m)} IS NOT NULL AND {kind(m)} <> 'VARCHAR'", f'"{f}.{m}" must be a string'),
                (f"{needed} AND {kind(m)} = 'VARCHAR' AND {val(m)} = ''", f'"{f}.{m}" is not allowed to be empty')]
    out += [(f"{val('type')} = 'repo' AND {kind('url')} = 'VARCHAR' AND {val('url')} <> '' AND NOT regexp_matches({val('url')}, {_q(ST.uri_pattern())})", f'"{f}.url" must be a valid uri'),
            (f"{kind('ref')} <> 'VARCHAR'", f'"{f}.ref" must be a string'), (f"{kind('files')} NOT IN ('ARRAY', 'NULL')", f'"{f}.files" must be an array')]
    return out


def _options_sql():
    out = [("options IS NOT NULL AND o_options IS NULL", '"options" must be of type object'),
           ("json_type(o_options, '$.mapHints') NOT IN ('OBJECT', 'NULL')", '"options.mapHints" must be of type object')]
    for name, _, _ in OPTIONS:
        t, v = f"json_type(o_options, '$.{name}')", f"lower(json_extract_string(o_options, '$.{name}'))"
        out.append((f"{t} IS NOT NULL AND NOT ({t} = 'BOOLEAN' OR ({t} = 'VARCHAR' AND {v} IN ('true', 'false')))", f'"options.{name}" must be a boolean'))
    return out


_LANGUAGE = (f"language IS NULL OR language NOT IN ({', '.join(_q(x) for x in ACCEPTED_LANGUAGES)})", ST.LANGUAGE_MESSAGE)
_MESSAGES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_q(m)} END" for c, m in [_LANGUAGE, *_side_sql("legacy"), *_side_sql("refactored"), *_options_sql()]) + "], lambda x: x IS NOT NULL)"


@register("json_requests", with_views(f"""
SELECT id, language, len(errs) = 0 AS valid, array_to_string(errs, ', ') AS message,
       """ + ", ".join(f"json_extract_string(o_{f}, '$.type') AS {f}_type, md5(json_extract_string(o_{f}, '$.content')) AS {f}_content, "
                       f"json_extract_string(o_{f}, '$.url') AS {f}_url, CAST(json_array_length(o_{f}, '$.files') AS BIGINT) * "
                       f"CASE WHEN json_type(o_{f}, '$.files') = 'ARRAY' THEN 1 END AS {f}_files" for f in ("legacy", "refactored")) + f""",
       CAST(CASE WHEN json_type(o_options, '$.mapHints') = 'OBJECT' THEN len(json_keys(o_options, '$.mapHints')) END AS BIGINT) AS n_hints,
       """ + ", ".join(f"coalesce(CASE lower(json_extract_string(o_options, '$.{name}')) WHEN 'true' THEN true WHEN 'false' THEN false END, {str(default).lower()}) AS {col}"
                       for name, col, default in OPTIONS) + """,
       """ + ", ".join(f"CASE WHEN o_{f} IS NULL THEN {f} END AS {f}_raw" for f in _FIELDS) + f"""
FROM (SELECT *, {_MESSAGES} AS errs FROM obj)""", "code_pairs", extra=[("raw", _RAW_SQL), ("obj", _OBJ_SQL)]))
def json_requests(spark, sf_dir):
    """Requests whose fields hold JSON in strings: parsed, checked, the unparsable kept."""
    p = parse_requests(raw_requests(spark, sf_dir))
    sides = [c for f in ("legacy", "refactored") for c in (
        F.col(f"{f}.type").alias(f"{f}_type"), F.md5(F.col(f"{f}.content")).alias(f"{f}_content"), F.col(f"{f}.url").alias(f"{f}_url"),
        F.when(F.col(f"{f}.files").isNotNull(), F.size(f"{f}.files")).cast("long").alias(f"{f}_files"))]
    return p.select("id", "language", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ", ").alias("message"), *sides,
                    F.when(F.col("map_hints").isNotNull(), F.size("map_hints")).cast("long").alias("n_hints"),
                    *[c for _, c, _ in OPTIONS], "legacy_raw", "refactored_raw", "options_raw")


# ------------------------------------------------------------- domain checks
_RULES = {"enums": {"lang": ["en", "de", "fr"], "source": [f"src{i}" for i in range(15)]}, "ranges": {"n_chars": (100, 5000)},
          "required": ["text", "lang"], "unique": ["doc_id", "text"]}
_VIOLATIONS_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, '{c}' AS \"column\", 'enum' AS rule FROM documents WHERE {c} IS NOT NULL AND {c} NOT IN ({', '.join(_q(v) for v in vs)})" for c, vs in _RULES["enums"].items()]
    + [f"SELECT doc_id, '{c}', 'range' FROM documents WHERE {c} < {lo} OR {c} > {hi}" for c, (lo, hi) in _RULES["ranges"].items()]
    + [f"SELECT doc_id, '{c}', 'required' FROM documents WHERE {c} IS NULL" for c in _RULES["required"]]
    + [f"SELECT doc_id, '{c}', 'unique' FROM documents WHERE {c} IN (SELECT {c} FROM documents GROUP BY {c} HAVING count(*) > 1)" for c in _RULES["unique"]])


@register("domain_checks", _VIOLATIONS_SQL)
def domain_checks(spark, sf_dir):
    """Every violated rule of the document table."""
    return ST.domain_violations(read_table(spark, sf_dir, "documents"), "doc_id", **_RULES)


@register("domain_counts", f'SELECT "column", rule, count(*) AS n FROM ({_VIOLATIONS_SQL}) GROUP BY ALL')
def domain_counts(spark, sf_dir):
    return ST.violation_counts(domain_checks(spark, sf_dir), "doc_id")


@register("delete_not_found", with_views("SELECT pair_id FROM (VALUES ('p-missing'), ('p1'), ('px')) v(pair_id) WHERE pair_id NOT IN (SELECT pair_id FROM code_pairs)", "code_pairs"))
def delete_not_found(spark, sf_dir):
    """Ids to delete that the table does not hold."""
    ids = spark.createDataFrame([("p-missing",), ("p1",), ("px",)], "pair_id string")
    return ST.delete_ids(code_pairs(spark, sf_dir).select("pair_id"), ids)[1]
