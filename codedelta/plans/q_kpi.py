"""KPI queries over nation tool scores (tools = nations, groups = regions)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codedelta.operators import kpi
from codedelta.plans.registry import register
from codedelta.plans.sqlviews import with_views
from codedelta.sources.derived import nation_scores

# Org weight overrides used by the weighted-score query: a partial map for
# one group and a zero weight for another (other groups use the defaults).
WEIGHT_OVERRIDES = [("ASIA", "K1", 0.3), ("ASIA", "K3", 0.05), ("EUROPE", "K2", 0.0)]
_OVERRIDES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{g}', '{k}', {w})" for g, k, w in WEIGHT_OVERRIDES) + ") v(group_id, kpi, weight)"

_NORM_SQL = """
  SELECT t.group_id, t.tool, t.tool_idx, t.kpi,
         CASE WHEN t.score IS NULL THEN NULL WHEN s.mx = s.mn THEN 1.0
              ELSE (t.score - s.mn) / (s.mx - s.mn) END AS score
  FROM tool_scores t JOIN (SELECT group_id, kpi, min(score) mn, max(score) mx FROM tool_scores GROUP BY 1, 2) s
  USING (group_id, kpi)"""


def _overrides(spark):
    schema = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("kpi", T.StringType()),
                           T.StructField("weight", T.DoubleType())])
    return spark.createDataFrame(WEIGHT_OVERRIDES, schema)


@register("kpi_normalize", with_views(
    "SELECT group_id, tool, tool_idx, kpi, score FROM norm", "tool_scores", extra=[("norm", _NORM_SQL)]))
def kpi_normalize(spark, sf_dir):
    return kpi.normalize_scores(nation_scores(spark, sf_dir))


@register("kpi_weighted_score", with_views(
    """SELECT n.group_id, n.tool, n.tool_idx,
       CASE WHEN count(*) FILTER (WHERE n.score IS NULL) = 0
            THEN round(sum(coalesce(ov.weight, k.default_weight) * n.score) * 10, 2) END AS score
FROM norm n JOIN kpis k USING (kpi) LEFT JOIN ov USING (group_id, kpi)
GROUP BY n.group_id, n.tool, n.tool_idx""", "tool_scores", "kpis",
    extra=[("norm", _NORM_SQL), ("ov", _OVERRIDES_SQL)]))
def kpi_weighted_score(spark, sf_dir):
    norm = kpi.normalize_scores(nation_scores(spark, sf_dir))
    return kpi.weighted_score(spark, norm, _overrides(spark))


@register("kpi_rankings", with_views(
    """SELECT group_id, kpi, CAST(row_number() OVER (PARTITION BY group_id, kpi
                                  ORDER BY score DESC NULLS LAST, tool_idx) AS INTEGER) AS rank, tool, score
FROM norm""", "tool_scores", extra=[("norm", _NORM_SQL)]))
def kpi_rankings(spark, sf_dir):
    return kpi.kpi_rankings(kpi.normalize_scores(nation_scores(spark, sf_dir)))


@register("kpi_averages", with_views(
    "SELECT group_id, kpi, round(avg(score), 6) AS avg_score FROM tool_scores GROUP BY 1, 2", "tool_scores"))
def kpi_averages(spark, sf_dir):
    return kpi.kpi_averages(nation_scores(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))
