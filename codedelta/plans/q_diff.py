"""Line-diff queries over all derived text pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codedelta.operators import diff
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import LINE_RE, with_views
from codedelta.sources.derived import diff_pairs

_MULTISET_SQL = with_views("""
SELECT d.pair_id, CAST(coalesce(p.a, 0) AS BIGINT) AS lines_added, CAST(coalesce(p.r, 0) AS BIGINT) AS lines_removed
FROM diff_pairs d LEFT JOIN p USING (pair_id)""", "diff_pairs", extra=[
    ("l", f"""SELECT pair_id, -1 AS w, unnest(regexp_extract_all(legacy, {LINE_RE})) AS line FROM diff_pairs
          UNION ALL
          SELECT pair_id, 1 AS w, unnest(regexp_extract_all(refactored, {LINE_RE})) AS line FROM diff_pairs"""),
    ("c", """SELECT pair_id, line, count(*) FILTER (WHERE w < 0) AS n_old, count(*) FILTER (WHERE w > 0) AS n_new
          FROM l GROUP BY pair_id, line"""),
    ("p", """SELECT pair_id, sum(greatest(n_new - n_old, 0)) AS a, sum(greatest(n_old - n_new, 0)) AS r
          FROM c GROUP BY pair_id"""),
])

# Row-wise LCS dynamic programme (recursive CTE), the independent oracle for
# the bit-parallel LCS.  ``src`` has (pair_id, legacy, refactored).


def lcs_ctes(src: str = "diff_pairs", t: str = "t", d: str = "d"):
    return [
        (t, f"""SELECT pair_id AS k, regexp_extract_all(legacy, {LINE_RE}) AS a,
          regexp_extract_all(refactored, {LINE_RE}) AS b FROM {src}"""),
        (f"{d}(k, i, row_)", f"""
  SELECT k, 0, list_transform(range(len(b) + 1), lambda z: 0::BIGINT) FROM {t}
  UNION ALL
  SELECT {d}.k, {d}.i + 1,
         list_reduce(list_transform(range(1, len({t}.b) + 1), lambda j: [j]),
           lambda acc, e: list_append(acc, CASE WHEN {t}.b[e[1]] = {t}.a[{d}.i + 1] THEN {d}.row_[e[1]] + 1
                                              ELSE greatest({d}.row_[e[1] + 1], acc[len(acc)]) END), [0::BIGINT])
  FROM {d} JOIN {t} ON {d}.k = {t}.k WHERE {d}.i < len({t}.a)"""),
    ]


LCS_DP_CTES = lcs_ctes()

_ALIGNED_SQL = with_views("""
SELECT t.k AS pair_id, CAST(len(t.b) - d.row_[len(d.row_)] AS BIGINT) AS lines_added,
       CAST(len(t.a) - d.row_[len(d.row_)] AS BIGINT) AS lines_removed
FROM d JOIN t ON d.k = t.k WHERE d.i = len(t.a)""", "diff_pairs", extra=LCS_DP_CTES, recursive=True)


@register("line_diff_multiset", _MULTISET_SQL)
def line_diff_multiset(spark, sf_dir):
    return diff.line_diff_multiset(diff_pairs(spark, sf_dir))


@register("line_diff_aligned", _ALIGNED_SQL)
def line_diff_aligned(spark, sf_dir):
    return diff.line_diff_aligned(diff_pairs(spark, sf_dir))


@register("patch_context")
def patch_context(spark, sf_dir):
    """Unified patch rows.  Which of several minimal scripts is shown is a matter of the engine, so the rows have no SQL of their own;
    ``patch_apply`` holds them to the new texts and ``patch_counts`` to the least number of changed lines."""
    return diff.patch_rows(diff_pairs(spark, sf_dir)).select("pair_id", "seq", "mark", "line")


@register("patch_apply", with_views("SELECT pair_id, md5(coalesce(refactored, '')) AS new_md5, false AS conflict FROM diff_pairs", "diff_pairs"))
def patch_apply(spark, sf_dir):
    """All patches applied to their old texts."""
    pairs = diff_pairs(spark, sf_dir)
    done = diff.apply_patch(pairs.select("pair_id", "legacy"), diff.patch_rows(pairs))
    return done.select("pair_id", F.md5("text").alias("new_md5"), "conflict")


@register("patch_counts", with_views("""
SELECT t.k AS pair_id, CAST(len(t.b) - d.row_[len(d.row_)] AS BIGINT) AS plus, CAST(len(t.a) - d.row_[len(d.row_)] AS BIGINT) AS minus
FROM d JOIN t ON d.k = t.k WHERE d.i = len(t.a) AND t.a <> t.b""", "diff_pairs", extra=LCS_DP_CTES, recursive=True))
def patch_counts(spark, sf_dir):
    """Added and removed rows per patch."""
    rows = diff.patch_rows(diff_pairs(spark, sf_dir))
    return rows.groupBy("pair_id").agg(F.count_if(F.col("mark") == "+").alias("plus"), F.count_if(F.col("mark") == "-").alias("minus"))
