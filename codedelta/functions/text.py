"""Text column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A line keeps its newline; a last line without one is a line of its own, so
# "a\nb" and "a\nb\n" differ in their last line.
LINE_PATTERN = r"[^\n]*\n|[^\n]+"


def lines(text: Column) -> Column:
    """array<string> of the lines of ``text`` (empty array for ''/null)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(LINE_PATTERN), 0), F.array().cast("array<string>"))


def line_key(line: Column) -> Column:
    """Compact 96-bit key of a line for shuffles: xxhash64 and murmur3 together."""
    return F.struct(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def js_lower(text: Column) -> Column:
    return F.lower(text)


def pin(c: Column) -> Column:
    """Keep an expensive column computed once when lambdas read it.

    Catalyst's CollapseProject inlines a column referenced once, and a
    reference inside a higher-order-function lambda counts as one even though
    the lambda runs per element; filters are pushed below a projection the same way.  A projection
    holding a non-deterministic expression is never inlined nor passed, so ``when(id >= 0, c)`` with the row's running
    id (always true) keeps ``c`` evaluated once per row.  (``rand() >= 0`` would not do: Catalyst folds it.)"""
    return F.when(F.monotonically_increasing_id() >= 0, c)
