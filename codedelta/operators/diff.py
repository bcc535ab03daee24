"""Line diffs between the legacy and refactored text of each pair.

A pair is one row, so all of it happens in the row, without any shuffle.

* ``line_diff_multiset`` — line counts of both sides compared as multisets of line hashes.  Equals the aligned
  diff when no line moved, else a lower bound.
* ``line_diff_aligned`` — minimal edit script counts (n - LCS) from an exact
  bit-parallel LCS run in an Arrow pandas UDF over line hashes.
* ``patch_rows`` / ``unified_diff_col`` — unified-patch rows (changed lines plus 4
  context lines) from the same alignment; line text is looked up JVM-side.  Every row knows how many lines of each side
  lie before it; a hunk begins where these running sums leave a gap (gaps and islands).
* ``apply_patch`` — the inverse: old text and patch rows give the new text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import cloudpickle

import codedelta.functions.lcs as _lcs
from codedelta.functions.batches import bound_batches, rows_of
from codedelta.functions.lcs import align, lcs_length
from codedelta.functions.text import lines, pin
from codedelta.rules import PATCH_CONTEXT_LINES

# Ship the UDF and its helper by value: executors need no installed package.
cloudpickle.register_pickle_by_value(_lcs)
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))

ALIGN_TYPE = T.StructType([
    T.StructField("lcs", T.LongType()),
    T.StructField("marks", T.StringType()),
    T.StructField("a_idx", T.ArrayType(T.IntegerType())),
    T.StructField("b_idx", T.ArrayType(T.IntegerType())),
])


_ALIGN_ARROW = pa.struct([("lcs", pa.int64()), ("marks", pa.string()), ("a_idx", pa.list_(pa.int32())), ("b_idx", pa.list_(pa.int32()))])


@F.arrow_udf(ALIGN_TYPE)
def _align_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([align(x, y, PATCH_CONTEXT_LINES) for x, y in rows_of(a, b)], _ALIGN_ARROW)


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


def _hashes(arr):
    return F.transform(arr, lambda x: F.xxhash64(x))


def with_lines(df: DataFrame, legacy: str = "legacy", refactored: str = "refactored") -> DataFrame:
    bound_batches(df.sparkSession)
    return df.withColumn("_la", pin(lines(F.col(legacy)))).withColumn("_lb", pin(lines(F.col(refactored))))


def _unequal(legacy: str, refactored: str):
    return F.coalesce(F.col(legacy), F.lit("")) != F.coalesce(F.col(refactored), F.lit(""))


def with_alignment(df: DataFrame, legacy: str = "legacy", refactored: str = "refactored",
                   beside: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``_la``/``_lb`` (line arrays), ``_al`` (lcs, marks, a_idx, b_idx) and ``_patch`` (array<struct<mark, a, b, line>>).

    Equal texts send empty arrays to the UDF and have an empty patch.  ``beside``: further columns by Arrow UDFs, which Spark then
    evaluates in the same Python worker as the alignment instead of in one of their own."""
    d = with_lines(df, legacy, refactored)
    none = F.array().cast("array<bigint>")
    differ = _unequal(legacy, refactored)
    aligned = _align_udf(F.when(differ, _hashes(F.col("_la"))).otherwise(none), F.when(differ, _hashes(F.col("_lb"))).otherwise(none))
    d = d.withColumns({"_al": aligned, **(beside or {})})
    d = d.withColumn("_al", F.col("_al").withField("lcs", F.when(differ, F.col("_al.lcs")).otherwise(F.size("_la").cast("long"))))
    marks = F.when(F.length("_al.marks") > 0, F.split("_al.marks", "")).otherwise(F.array().cast("array<string>"))
    rows = F.transform(F.arrays_zip(marks.alias("mark"), F.col("_al.a_idx").alias("a"), F.col("_al.b_idx").alias("b")), lambda e: F.struct(
        e["mark"].alias("mark"), e["a"].alias("a"), e["b"].alias("b"),
        F.when(e["mark"] != "+", F.get("_la", e["a"])).otherwise(F.get("_lb", e["b"])).alias("line")))
    return d.withColumn("_patch", pin(rows))


def line_diff_aligned(pairs: DataFrame, key: str = "pair_id", legacy: str = "legacy",
                      refactored: str = "refactored") -> DataFrame:
    """(key, lines_added, lines_removed) — minimal edit script counts; no script is made for them."""
    d = with_lines(pairs.select(key, legacy, refactored), legacy, refactored)
    none = F.array().cast("array<bigint>")
    differ = _unequal(legacy, refactored)
    lcs = _lcs_udf(F.when(differ, _hashes(F.col("_la"))).otherwise(none), F.when(differ, _hashes(F.col("_lb"))).otherwise(none))
    d = d.select(key, F.size("_la").alias("n"), F.size("_lb").alias("m"), differ.alias("differ"), lcs.alias("lcs"))
    added, removed = F.col("m") - F.col("lcs"), F.col("n") - F.col("lcs")
    return d.select(key, F.when(F.col("differ"), added).otherwise(0).cast("long").alias("lines_added"),
                    F.when(F.col("differ"), removed).otherwise(0).cast("long").alias("lines_removed"))


def _added_removed(old, new) -> tuple[int, int]:
    old, new = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (old, new))
    _, at = np.unique(np.concatenate([old, new]), return_inverse=True)
    more = np.bincount(at[len(old):], minlength=len(at)) - np.bincount(at[:len(old)], minlength=len(at))
    return int(more[more > 0].sum()), int(-more[more < 0].sum())


@F.pandas_udf(T.StructType([T.StructField("lines_added", T.LongType()), T.StructField("lines_removed", T.LongType())]))
def _multiset_udf(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_added_removed(x, y) for x, y in zip(old, new)], columns=["lines_added", "lines_removed"]).astype("int64")


def line_diff_multiset(pairs: DataFrame, key: str = "pair_id", legacy: str = "legacy",
                       refactored: str = "refactored") -> DataFrame:
    """(key, lines_added, lines_removed) from per-line count differences."""
    bound_batches(pairs.sparkSession)
    none = F.array().cast("array<bigint>")
    differ = _unequal(legacy, refactored)

    def side(c):
        return F.when(differ, _hashes(lines(F.col(c)))).otherwise(none)
    return pairs.select(key, _multiset_udf(side(legacy), side(refactored)).alias("n")).select(key, "n.*")


def with_hunks(aligned: DataFrame) -> DataFrame:
    """Adds ``_hunks``: array<struct<start, rows>>, the patch rows in runs that follow each other on both sides.  A run begins where the
    lines before a row are not those behind the row above."""
    rows = F.col("_patch")

    def begins(x, i):
        above = F.get(rows, i - 1)
        follows = ((x["a"] == above["a"] + (above["mark"] != "+").cast("int")) & (x["b"] == above["b"] + (above["mark"] != "-").cast("int")))
        return F.when((i == 0) | ~follows, i)
    d = aligned.withColumn("_starts", pin(F.array_compact(F.transform(rows, begins))))
    starts = F.col("_starts")
    run = F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s).alias("rows")))
    return d.withColumn("_hunks", pin(run)).drop("_starts")


def patch_rows(pairs: DataFrame, key: str = "pair_id", legacy: str = "legacy",
               refactored: str = "refactored") -> DataFrame:
    """Unified patch rows: (key, seq, hunk, old_pos, new_pos, mark, line) with mark in ' ', '-', '+' and the number of lines before the
    row on each side."""
    d = with_hunks(with_alignment(pairs.select(key, legacy, refactored), legacy, refactored))
    # Only the changed lines and their context leave the row, not both files per patch row.
    flat = F.flatten(F.transform("_hunks", lambda h, k: F.transform(h["rows"], lambda x, j: F.struct(
        (h["start"] + j).cast("int").alias("seq"), k.cast("int").alias("hunk"), x["a"].alias("old_pos"), x["b"].alias("new_pos"),
        x["mark"].alias("mark"), x["line"].alias("line")))))
    return d.select(key, pin(flat).alias("patch")).select(key, F.inline("patch"))


def apply_patch(texts: DataFrame, patch: DataFrame, key: str = "pair_id", legacy: str = "legacy") -> DataFrame:
    """(key, text, conflict): the old texts with their patch rows applied.  ``conflict`` tells that a removed or context line of the patch
    does not stand at its place; the text is null then.  Texts without patch rows stay as they are; patch rows of unknown keys are left out.

    A text's patch rows come together by its key; they are at most as long as both its sides."""
    own = patch.groupBy(F.col(key).alias("_patch_key")).agg(F.sort_array(F.collect_list(F.struct("seq", "hunk", "old_pos", "mark", "line"))).alias("_rows"))
    d = texts.select(key, lines(F.col(legacy)).alias("_la")).join(own, F.col(key) == F.col("_patch_key"), "left")
    d = d.select(key, pin(F.col("_la")).alias("_la"), F.coalesce("_rows", F.array().cast("array<struct<seq:int,hunk:int,old_pos:int,mark:string,line:string>>")).alias("_rows"))
    rows, old = F.col("_rows"), F.col("_la")
    starts = F.array_compact(F.transform(rows, lambda x, i: F.when((i == 0) | (x["hunk"] != F.get(rows, i - 1)["hunk"]), i)))
    d = d.withColumn("_starts", pin(starts))

    def hunk(s, k):
        mine = F.slice(rows, s + 1, F.coalesce(F.get("_starts", k + 1), F.size(rows)) - s)
        kept = F.transform(F.filter(mine, lambda x: x["mark"] != "+"), lambda x: x["line"])
        return F.struct(F.get(rows, s)["old_pos"].alias("at"), kept.alias("was"),
                        F.transform(F.filter(mine, lambda x: x["mark"] != "-"), lambda x: x["line"]).alias("becomes"))
    d = d.withColumn("_hunks", pin(F.transform("_starts", hunk)))
    hunks = F.col("_hunks")

    def end_of(k):
        h = F.get(hunks, k)
        return F.coalesce(h["at"] + F.size(h["was"]), F.lit(0))
    pieces = F.transform(hunks, lambda h, k: F.concat(F.slice(old, end_of(k - 1) + 1, F.greatest(h["at"] - end_of(k - 1), F.lit(0))), h["becomes"]))
    last = end_of(F.size(hunks) - 1)
    tail = F.slice(old, last + 1, F.greatest(F.size(old) - last, F.lit(0)))
    misplaced = F.exists(F.transform(hunks, lambda h, k: (F.slice(old, h["at"] + 1, F.size(h["was"])) != h["was"]) | (h["at"] < end_of(k - 1))), lambda x: x)
    conflict = F.coalesce(misplaced, F.lit(True))
    return d.select(key, F.when(~conflict, F.array_join(F.concat(F.flatten(pieces), tail), "")).alias("text"), conflict.alias("conflict"))


def patch_text_col() -> F.Column:
    """Concatenated patch lines, without marks, of a frame from ``with_alignment``."""
    return F.array_join(F.transform("_patch", lambda x: x["line"]), "\n")


def marked_text_col(mark: str) -> F.Column:
    """The lines of one mark of a frame from ``with_alignment``."""
    return F.array_join(F.transform(F.filter("_patch", lambda x: x["mark"] == mark), lambda x: x["line"]), "\n")


def unified_diff_col(old_name: str = "legacy", new_name: str = "refactored") -> F.Column:
    """Unified diff text of a frame from ``with_hunks``: file header, a header per hunk, marked lines.  Empty for equal texts."""
    def side(xs, mark, pos):
        n = F.size(F.filter(xs, lambda x: x["mark"] != mark))
        return F.concat((F.get(xs, F.lit(0))[pos] + (n > 0).cast("int")).cast("string"), F.lit(","), n.cast("string"))

    def text(h):
        xs = h["rows"]
        body = F.array_join(F.transform(xs, lambda x: F.concat(x["mark"], F.when(x["line"].endswith("\n"), x["line"]).otherwise(
            F.concat(x["line"], F.lit("\n\\ No newline at end of file\n"))))), "")
        return F.concat(F.lit("@@ -"), side(xs, "+", "a"), F.lit(" +"), side(xs, "-", "b"), F.lit(" @@\n"), body)

    body = F.array_join(F.transform("_hunks", text), "")
    return F.when(F.size("_patch") > 0, F.concat(F.lit(f"--- {old_name}\n+++ {new_name}\n"), body)).otherwise(F.lit(""))
