"""Request intake: fields that hold JSON in strings, parsed on read.

A request's ``legacy``, ``refactored`` and ``options`` come as strings.  Each is parsed once into a VARIANT; a string that is no
JSON, or no JSON object, stays as it is in ``<field>_raw`` and gives a message, as do members of a wrong type.  Messages are
collected in the row, so intake is one scan without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.operators.store import LANGUAGE_MESSAGE, is_uri
from codedelta.rules import ACCEPTED_LANGUAGES, SOURCE_TYPES

SIDES = ("legacy", "refactored")
#: Option and default.
OPTIONS = [("analyzeTests", "analyze_tests", True), ("runStaticChecks", "run_static_checks", False), ("includeSecurityScan", "include_security_scan", True)]


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null) or a number's type; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _side_messages(name: str, raw: Column, v: Column, kind: Column) -> list[Column]:
    is_object = kind == "OBJECT"
    say = lambda cond, text: F.when(is_object & cond, F.lit(f'"{name}{text}'))
    typ, content, url, files = (_member(v, m) for m in ("type", "content", "url", "files"))
    text = lambda m: F.try_variant_get(v, f"$.{m}", "string")
    known = F.coalesce((_kind(typ) == "STRING") & text("type").isin(SOURCE_TYPES), F.lit(False))
    is_text = lambda x: _kind(x) == "STRING"
    out = [F.when(raw.isNull(), F.lit(f'"{name}" is required')).when(v.isNull() | (kind != "OBJECT"), F.lit(f'"{name}" must be of type object')),
           say(typ.isNull(), '.type" is required'),
           say(typ.isNotNull() & ~known, '.type" must be one of [' + ", ".join(SOURCE_TYPES) + "]")]
    for member, value, needed_by in (("content", content, "paste"), ("url", url, "repo")):
        needed = F.coalesce(text("type") == needed_by, F.lit(False)) & known
        out += [say(needed & value.isNull(), f'.{member}" is required'),
                say(value.isNotNull() & ~is_text(value), f'.{member}" must be a string'),
                say(needed & is_text(value) & (text(member) == ""), f'.{member}" is not allowed to be empty')]
    out += [say(F.coalesce(text("type") == "repo", F.lit(False)) & is_text(url) & (text("url") != "") & ~is_uri(text("url")), '.url" must be a valid uri'),
            say(_member(v, "ref").isNotNull() & ~is_text(_member(v, "ref")), '.ref" must be a string'),
            say(files.isNotNull() & ~_kind(files).isin("ARRAY", "VOID"), '.files" must be an array')]
    return out


def _is_boolean(v: Column, name: str) -> Column:
    """true and false, also as strings in any case."""
    kind = _kind(_member(v, name))
    return (kind == "BOOLEAN") | ((kind == "STRING") & F.lower(F.try_variant_get(v, f"$.{name}", "string")).isin("true", "false"))


def _option_messages(raw: Column, v: Column, kind: Column) -> list[Column]:
    is_object = kind == "OBJECT"
    out = [F.when(raw.isNotNull() & (v.isNull() | (kind != "OBJECT")), F.lit('"options" must be of type object'))]
    hints = _member(v, "mapHints")
    out.append(F.when(is_object & hints.isNotNull() & ~_kind(hints).isin("OBJECT", "VOID"), F.lit('"options.mapHints" must be of type object')))
    for name, _, _ in OPTIONS:
        out.append(F.when(is_object & _member(v, name).isNotNull() & ~_is_boolean(v, name), F.lit(f'"options.{name}" must be a boolean')))
    return out


def parse_requests(requests: DataFrame) -> DataFrame:
    """Adds to (..., language, legacy, refactored, options as strings): structs ``legacy`` and ``refactored`` (type, content, url, ref,
    files) and columns map_hints and one per option in place of the strings, ``legacy_raw``, ``refactored_raw``, ``options_raw`` (the
    string where it could not be parsed, else null) and ``errors``."""
    fields = [*SIDES, "options"]
    d = requests
    for f in fields:
        d = d.withColumn(f"_{f}", F.try_parse_json(F.col(f)))
    for f in fields:
        d = d.withColumn(f"_{f}_kind", _kind(F.col(f"_{f}")))
    language = F.col("language")
    checks = [F.when(language.isNull() | ~language.isin(ACCEPTED_LANGUAGES), F.lit(LANGUAGE_MESSAGE))]
    for f in SIDES:
        checks += _side_messages(f, F.col(f), F.col(f"_{f}"), F.col(f"_{f}_kind"))
    checks += _option_messages(F.col("options"), F.col("_options"), F.col("_options_kind"))
    d = d.withColumn("errors", F.array_compact(F.array(*checks)))

    def parsed(f):
        return F.coalesce(F.col(f"_{f}_kind") == "OBJECT", F.lit(False))
    out = [c for c in requests.columns if c not in fields]
    for f in SIDES:
        v = F.col(f"_{f}")
        members = [F.try_variant_get(v, f"$.{m}", "string").alias(m) for m in ("type", "content", "url", "ref")]
        out.append(F.when(parsed(f), F.struct(*members, F.try_variant_get(v, "$.files", "array<string>").alias("files"))).alias(f))
    v = F.col("_options")
    out.append(F.try_variant_get(v, "$.mapHints", "map<string,string>").alias("map_hints"))
    out += [F.coalesce(F.when(_is_boolean(v, name), F.try_variant_get(v, f"$.{name}", "boolean")), F.lit(default)).alias(column) for name, column, default in OPTIONS]
    out += [F.when(~parsed(f), F.col(f)).alias(f"{f}_raw") for f in fields]
    return d.select(*out, "errors")


def code_pairs_of(parsed: DataFrame, key: str = "id") -> DataFrame:
    """Code pairs of the valid requests whose sides carry their content."""
    ok = parsed.filter((F.size("errors") == 0) & F.col("legacy.content").isNotNull() & F.col("refactored.content").isNotNull())
    return ok.select(F.col(key).alias("pair_id"), "language", F.col("legacy.content").alias("legacy"), F.col("refactored.content").alias("refactored"),
                     "map_hints", "include_security_scan")
