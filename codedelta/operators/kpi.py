"""KPI comparison of tools: min-max normalisation, weighted score, rankings, averages.

Input is the long form ``tool_scores(group_id, tool, tool_idx, kpi, score)``;
a group is one comparison request.  Per-(group, kpi) statistics are computed
with a grouped aggregation (partial aggregation before the shuffle) and joined
back, so a very large group is never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codedelta.rules import KPIS

KPI_SCHEMA = T.StructType([
    T.StructField("kpi", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("default_weight", T.DoubleType(), False),
])


def kpi_table(spark: SparkSession) -> DataFrame:
    """The seven KPI dimensions (fixed size: safe to broadcast)."""
    return spark.createDataFrame(KPIS, KPI_SCHEMA)


def wide_to_long(df: DataFrame, tool_col: str = "tool", scores_col: str = "scores",
                 group_col: str = "group_id", idx_col: str = "tool_idx") -> DataFrame:
    """``(group, tool, tool_idx, scores map<string,double>)`` -> long rows."""
    return df.select(group_col, tool_col, idx_col, F.explode(scores_col).alias("kpi", "score"))


def long_to_wide(df: DataFrame, value_col: str = "score") -> DataFrame:
    """Long rows -> ``scores`` map per (group, tool), keys in KPI order."""
    return (df.groupBy("group_id", "tool", "tool_idx")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kpi", value_col))))
                 .alias("scores")))


def normalize_scores(tool_scores: DataFrame) -> DataFrame:
    """Min-max normalise each KPI within its group; a constant KPI gives 1.

    A missing score stays null for that tool only."""
    stats = tool_scores.groupBy("group_id", "kpi").agg(F.min("score").alias("mn"), F.max("score").alias("mx"))
    j = tool_scores.join(stats, ["group_id", "kpi"])
    norm = F.when(F.col("score").isNull(), F.lit(None).cast("double")) \
        .when(F.col("mx") == F.col("mn"), F.lit(1.0)) \
        .otherwise((F.col("score") - F.col("mn")) / (F.col("mx") - F.col("mn")))
    return j.select("group_id", "tool", "tool_idx", "kpi", norm.alias("score"))


def default_weights(spark: SparkSession) -> DataFrame:
    """(kpi, default_weight) rows."""
    return kpi_table(spark).select("kpi", "default_weight")


def default_weights_map(spark: SparkSession) -> DataFrame:
    """One row holding ``map<kpi, default_weight>`` (settings default)."""
    return kpi_table(spark).agg(
        F.map_from_entries(F.collect_list(F.struct("kpi", "default_weight"))).alias("kpi_weights"))


def weighted_score(spark: SparkSession, normalized: DataFrame, overrides: DataFrame | None = None,
                   with_breakdown: bool = False) -> DataFrame:
    """Weighted sum over KPIs times 10, rounded to 2 decimals, per (group, tool).

    ``overrides`` has (group_id, kpi, weight); a partial override map falls
    back to the default weight per key.  A null normalised KPI makes the
    tool's score null."""
    j = normalized.join(F.broadcast(default_weights(spark)), "kpi")  # fixed 7-row table
    if overrides is not None:
        j = j.join(overrides.select("group_id", "kpi", "weight"), ["group_id", "kpi"], "left")
        weight = F.coalesce(F.col("weight"), F.col("default_weight"))
    else:
        weight = F.col("default_weight")
    aggs = [F.round(F.sum(weight * F.col("score")) * 10, 2).alias("score"),
            F.count_if(F.col("score").isNull()).alias("_n_null")]
    if with_breakdown:
        aggs.append(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kpi", "score"))))
                    .alias("kpi_breakdown"))
    out = j.groupBy("group_id", "tool", "tool_idx").agg(*aggs)
    return out.withColumn("score", F.when(F.col("_n_null") == 0, F.col("score"))).drop("_n_null")


def settings_to_overrides(settings: DataFrame, key_col: str = "org") -> DataFrame:
    """org_settings(org, kpi_weights map) -> (group_id, kpi, weight) rows."""
    return settings.select(F.col(key_col).alias("group_id"),
                           F.explode("kpi_weights").alias("kpi", "weight"))


def kpi_rankings(normalized: DataFrame) -> DataFrame:
    """Rank tools per (group, KPI) by score descending, ties in input order.

    A ranking is a sort of the group; ``row_number`` over a window streams the
    sorted rows (no buffering of the partition)."""
    w = Window.partitionBy("group_id", "kpi").orderBy(F.desc_nulls_last("score"), F.asc("tool_idx"))
    return normalized.select("group_id", "kpi", F.row_number().over(w).alias("rank"), "tool", "score")


def kpi_averages(tool_scores: DataFrame) -> DataFrame:
    """Average raw score per (group, KPI)."""
    return tool_scores.groupBy("group_id", "kpi").agg(F.avg("score").alias("avg_score"))
