"""Risk scans: security, license, compatibility, performance, maintainability.

One pass per text: every pattern becomes a ``regexp_count`` column inside one
array of candidate flags, which is filtered by the pattern's hit threshold.
Deduplication on (type, severity, description) happens inside the row with
``array_distinct`` (first occurrence kept), so scans never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.functions.text import pin
from codedelta.rules import (DEPENDENCY_LICENSE_DESCRIPTION, DEPENDENCY_LICENSE_SUGGESTION,
                             DEPENDENCY_LICENSE_WORDS, risk_pattern_rows)

LIVE_PACKS = ("security", "license", "compatibility")

# White space as the rules mean it, with no-break and other Unicode spaces; Java's and RE2's own \s are narrower.
WHITE_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def wide_spaces(regex: str) -> str:
    """The regex with every ``\\s`` (never inside a class in the rules) as the wider class."""
    return regex.replace(r"\s", WHITE_SPACE)


# For each pattern (in rule order) a lower-case literal that every match must
# contain; the regex only runs on texts whose lower-cased form contains it.
# This is a pruning guard: it never changes a count.
PATTERN_GUARDS = [
    "password", "key", "secret", "token", "key", "key", "aws", "aws", "github", "database",
    "md5", "sha1", "des", "rc4", "createhash", "createhash", "messagedigest", "messagedigest",
    "executequery", "query", "statement.execute", "cursor.execute",
    "innerhtml", "document.write", "eval", "function", "settimeout",
    "../../", "..\\..\\", "..%2f..%2f", "..%5c..%5c", "readfile", "open",
    "gpl", "gnu", "agpl", "gnu", "copyleft", "copyleft", "proprietary", "commercial", "closed",
    "new", ".call", "arguments.callee", "with", "eval",
    "document.all", "window.event", "attachevent", "detachevent", "createstylesheet",
    "process.version", "node", "v8",
    "for", "document.getelementbyid", "new",
    "function", "{", "//",
]
ALL_PACKS = LIVE_PACKS + ("performance", "maintainability")


def _check_guards():
    assert len(PATTERN_GUARDS) == len(risk_pattern_rows())


def pattern_rows(packs=ALL_PACKS, rows=None):
    """Pattern rows of the given packs, in rule order (a custom ``rows`` list is a rule pack)."""
    rows = rows if rows is not None else risk_pattern_rows()
    return [r for r in rows if r[0] in packs]


def candidate_flags(text: Column, packs=LIVE_PACKS, rows=None, low: Column | None = None) -> Column:
    """array<struct<type, category, pattern_ord, severity, n_hits, description, suggestion>>
    of the patterns that fire on ``text``, in rule order."""
    structs = []
    low = F.lower(text) if low is None else low
    for pack, cat, ordn, regex, sev, min_hits, desc, sugg in pattern_rows(packs, rows):
        n = F.regexp_count(text, F.lit(wide_spaces(regex)))
        if rows is None:  # built-in packs: guard the regex with its required literal
            n = F.when(text.isNull(), F.lit(None)).when(
                F.contains(low, F.lit(PATTERN_GUARDS[ordn - 1])), n).otherwise(F.lit(0))
        structs.append(F.struct(
            F.lit(pack).alias("type"), F.lit(cat).alias("category"), F.lit(ordn).alias("pattern_ord"),
            F.lit(sev).alias("severity"), n.alias("n_hits"),
            F.lit(min_hits).alias("min_hits"), F.lit(desc).alias("tmpl"), F.lit(sugg).alias("suggestion")))
    # Each pattern is counted once; the description is filled in afterwards.
    fired = F.filter(F.array(*structs), lambda s: s["n_hits"] >= s["min_hits"])
    return F.transform(fired, lambda s: F.struct(
        s["type"].alias("type"), s["category"].alias("category"), s["pattern_ord"].alias("pattern_ord"),
        s["severity"].alias("severity"), s["n_hits"].alias("n_hits"),
        F.replace(s["tmpl"], F.lit("{n}"), s["n_hits"].cast("string")).alias("description"),
        s["suggestion"].alias("suggestion")))


def dedup_flags(flags: Column) -> Column:
    """Keep the first flag of each (type, severity, description)."""
    return F.array_distinct(F.transform(flags, lambda s: F.struct(
        s["type"].alias("type"), s["severity"].alias("severity"),
        s["description"].alias("description"), s["suggestion"].alias("suggestion"))))


def scan(df: DataFrame, text_col: str, key_cols: list[str], packs=LIVE_PACKS, rows=None) -> DataFrame:
    """Long rows: one per fired pattern (not de-duplicated)."""
    d = df.select(*key_cols, text_col, pin(F.lower(F.col(text_col))).alias("_low"))
    return (d.select(*key_cols, F.explode(candidate_flags(F.col(text_col), packs, rows, F.col("_low"))).alias("f"))
            .select(*key_cols, "f.type", "f.category", "f.pattern_ord", "f.severity", "f.n_hits",
                    "f.description", "f.suggestion"))


def risk_flags(df: DataFrame, text_col: str, key_cols: list[str], enabled_col: str | None = None,
               packs=LIVE_PACKS, rows=None) -> DataFrame:
    """De-duplicated flags per row, long form with ``flag_ord`` (1-based, rule order).

    With ``enabled_col`` rows whose flag is false get no flags (a null flag
    means enabled)."""
    d = df.select(*key_cols, text_col, *([enabled_col] if enabled_col else []),
                  pin(F.lower(F.col(text_col))).alias("_low"))
    flags = dedup_flags(candidate_flags(F.col(text_col), packs, rows, F.col("_low")))
    if enabled_col:
        flags = F.when(F.coalesce(F.col(enabled_col), F.lit(True)), flags)
    return (d.select(*key_cols, F.posexplode(flags).alias("pos", "f"))
            .select(*key_cols, (F.col("pos") + 1).alias("flag_ord"), "f.type", "f.severity",
                    "f.description", "f.suggestion"))


def risk_flags_array(text: Column, enabled: Column | None = None, packs=LIVE_PACKS,
                     low: Column | None = None) -> Column:
    """The de-duplicated flags as an array column (for result assembly); pass a
    materialised lower-cased ``low`` column to share it across patterns."""
    flags = dedup_flags(candidate_flags(text, packs, None, low))
    if enabled is not None:
        flags = F.when(F.coalesce(enabled, F.lit(True)), flags).otherwise(F.array().cast(flags_type()))
    return flags


def flags_type() -> str:
    return "array<struct<type:string,severity:string,description:string,suggestion:string>>"


def dependency_license(deps: DataFrame, dep_col: str, key_cols: list[str]) -> DataFrame:
    """Dependencies whose name contains a restrictive-license word (case-sensitive)."""
    cond = None
    for w in DEPENDENCY_LICENSE_WORDS:
        c = F.col(dep_col).contains(w)
        cond = c if cond is None else (cond | c)
    pre, post = DEPENDENCY_LICENSE_DESCRIPTION.split("{dep}")
    return deps.filter(cond).select(
        *key_cols, F.col(dep_col).alias("dependency"), F.lit("license").alias("type"),
        F.lit("high").alias("severity"),
        F.concat(F.lit(pre), F.col(dep_col), F.lit(post)).alias("description"),
        F.lit(DEPENDENCY_LICENSE_SUGGESTION).alias("suggestion"))
