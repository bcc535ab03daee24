"""Per-pair analysis report: diff, elements, classification, score, risks,
next steps and summary, assembled into one row per pair without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codedelta.operators import classify as C
from codedelta.operators import diff as Dff
from codedelta.operators import elements as E
from codedelta.operators import mapping as M
from codedelta.operators import risk as R
from codedelta.operators import score as S
from codedelta.functions.text import pin
from codedelta.rules import (HIGH_SECURITY_STEP, LEVEL_WORDS, LICENSE_STEP, NO_REFACTORING_SUMMARY,
                             OUTBOX_SUBJECT, PARSED_LANGUAGES, TYPE_NEXT_STEPS)


def next_steps(types: Column, flags: Column) -> Column:
    """Distinct next steps (first-seen order): two per listed type, then one per
    high-severity security flag and per license flag."""
    step_map = F.create_map(*[x for t, steps in TYPE_NEXT_STEPS
                              for x in (F.lit(t), F.array(*[F.lit(s) for s in steps]))])
    by_type = F.flatten(F.transform(types, lambda t: F.coalesce(step_map[t["type"]],
                                                                F.array().cast("array<string>"))))
    by_flag = F.transform(flags, lambda f: F.when((f["type"] == "security") & (f["severity"] == "high"),
                                                  F.lit(HIGH_SECURITY_STEP))
                          .when(f["type"] == "license", F.lit(LICENSE_STEP)))
    return F.array_distinct(F.array_compact(F.concat(by_type, by_flag)))


def summary(types: Column) -> Column:
    """``Major <level word> changes: a, b, c`` from the top three types."""
    top = F.slice(types, 1, 3)
    words = F.array(*[F.lit(w) for w in LEVEL_WORDS])
    word = F.coalesce(F.try_element_at(words, F.try_element_at(top, F.lit(1))["level"] + 1), F.lit("unknown"))
    names = F.array_join(F.transform(top, lambda t: F.lower(t["type"])), ", ")
    return F.when(F.size(types) == 0, F.lit(NO_REFACTORING_SUMMARY)) \
        .otherwise(F.concat(F.lit("Major "), word, F.lit(" changes: "), names))


def with_text_changes(aligned: DataFrame) -> DataFrame:
    """Adds line counts, the patch (marked rows with hunk headers), its lower-cased lines, added and removed text."""
    return (Dff.with_hunks(aligned).withColumn("lines_added", (F.size("_lb") - F.col("_al.lcs")).cast("long"))
            .withColumn("lines_removed", (F.size("_la") - F.col("_al.lcs")).cast("long"))
            .withColumn("patch_lower", pin(F.lower(Dff.patch_text_col())))
            .withColumn("text_diff", Dff.unified_diff_col())
            .withColumn("added_text", Dff.marked_text_col("+")).withColumn("removed_text", Dff.marked_text_col("-")))


def analyze(spark: SparkSession, pairs: DataFrame, level: str = "file", key: str = "pair_id",
            adjust_language: bool = False) -> DataFrame:
    """One report row per pair (status completed or failed).

    A pair's texts are one row, and every stage works in that row: alignment, elements with their mapping, token
    counts (three Arrow UDFs in one worker, over batches of bounded bytes), detections and their merge per type, metrics, score,
    risks, steps and summary.  Nothing is shuffled or persisted; columns that a query does not read are pruned with
    the stages that make them."""
    kept = [key, "language", "org", "user_id", "submitted_at"]
    ok = pairs.filter(F.col("language").isin(PARSED_LANGUAGES))
    failed = pairs.filter(~F.col("language").isin(PARSED_LANGUAGES) | F.col("language").isNull())

    j = ok.select(*kept, "legacy", "refactored", "include_security_scan", "map_hints")
    beside = {"_tok": E.token_changes(F.col("legacy"), F.col("refactored"))}
    if level == "node":
        j = M.with_changes(j)
    else:
        beside["_ch"] = M.changes_col()
    j = with_text_changes(Dff.with_alignment(j, beside=beside))
    a, r, m = (F.size(F.col("_ch")[c]).cast("long") for c in ("added", "removed", "modified"))
    j = (j.withColumn("nodes_added", a).withColumn("nodes_removed", r).withColumn("nodes_modified", m)
         .withColumn("tokens_added", F.col("_tok.tokens_added")).withColumn("tokens_removed", F.col("_tok.tokens_removed")))
    a, r, m = F.col("nodes_added"), F.col("nodes_removed"), F.col("nodes_modified")
    j = (j.withColumn("ast_diff_summary", M.diff_summary(a, r, m))
         .withColumn("file_impact_score", M.element_impact(a, r, m).cast("int")))
    dets = C.file_detections(F.col("patch_lower"), F.col("ast_diff_summary"))
    if level == "node":
        j = j.withColumn("_nodes", pin(node_detection_array()))
        dets = F.concat(C.as_plain(F.col("_nodes")), dets)
    j = j.withColumn("_dets", pin(dets)).withColumn("refactor_types", pin(C.merge_in_row(F.col("_dets"))))

    types = F.col("refactor_types")
    lines_changed = F.col("lines_added") + F.col("lines_removed")
    nodes_changed = a + r + m + F.col("tokens_added") + F.col("tokens_removed")
    infra = S.infrastructure_components(types)
    cx = S.complexity_delta(types)
    if adjust_language:
        cmul, iw = S.language_multipliers(F.col("language"))
        infra, cx = infra * iw, cx * cmul
    cov = S.coverage_delta(types)
    raw = S.raw_score(lines_changed, nodes_changed, infra, cov, cx)
    j = j.withColumn("_low", pin(F.lower(F.col("refactored"))))
    flags = pin(R.risk_flags_array(F.col("refactored"), F.col("include_security_scan"), low=F.col("_low")))
    j = j.select(
        *kept, "lines_added", "lines_removed", "text_diff", "nodes_added", "nodes_removed", "nodes_modified", "tokens_added", "tokens_removed",
        "ast_diff_summary", "file_impact_score", "refactor_types",
        lines_changed.alias("total_lines_changed"),
        F.lit(1).alias("files_modified"),
        nodes_changed.alias("ast_nodes_changed"),
        infra.alias("new_infrastructure_components"),
        S.architectural_changes(types).alias("architectural_changes"),
        cx.alias("cyclomatic_complexity_delta"),
        cov.alias("test_coverage_delta"),
        S.dependencies(F.col("added_text")).alias("new_dependencies"),
        S.dependencies(F.col("removed_text")).alias("removed_dependencies"),
        raw.alias("raw_score"),
        flags.alias("risk_flags"),
        summary(types).alias("summary"),
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error_message"))
    j = j.select("*", S.overall_score(F.col("raw_score")).alias("overall_score"),
                 next_steps(types, F.col("risk_flags")).alias("next_steps"))
    j = j.withColumn("level", S.level_of(F.col("overall_score")))
    fail = failed.select(*kept, F.lit("failed").alias("status"),
                         F.concat(F.lit("Unsupported language: "), F.coalesce(F.col("language"), F.lit("null")))
                         .alias("error_message"))
    return j.unionByName(fail, allowMissingColumns=True)


def node_detection_array() -> Column:
    """Node detections of a row with ``_le``, ``_re`` and ``_ch``."""
    return C.node_detections(M.at_positions(F.col("_re"), F.col("_ch.added")), M.at_positions(F.col("_le"), F.col("_ch.removed")), M.modified_array())


def results_struct(report: DataFrame) -> DataFrame:
    """Nested result column in the stored shape (one ``results`` struct per pair)."""
    metrics = F.struct("total_lines_changed", "files_modified", "new_dependencies", "removed_dependencies",
                       "cyclomatic_complexity_delta", "test_coverage_delta", "ast_nodes_changed",
                       "new_infrastructure_components", "architectural_changes")
    files = F.array(F.struct(F.lit("main").alias("file_path"), F.col("text_diff"), F.col("ast_diff_summary"),
                             F.col("file_impact_score").alias("impact_score"), F.col("lines_added"),
                             F.col("lines_removed"), F.col("nodes_modified").alias("lines_modified")))
    res = F.struct(F.col("overall_score"), F.col("level"), F.col("summary"), F.col("refactor_types"),
                   files.alias("files"), F.col("risk_flags"), F.col("next_steps").alias("suggested_next_steps"),
                   metrics.alias("metrics"))
    return report.select("pair_id", "language", "status", "org", "user_id", "submitted_at", "error_message",
                         F.when(F.col("status") == "completed", res).alias("results"))


def outbox(report: DataFrame, users: DataFrame) -> DataFrame:
    """Completion notices for completed analyses whose user has an email."""
    r = report.filter(F.col("status") == "completed").select("pair_id", "user_id", "summary", "overall_score")
    u = users.filter(F.col("email").isNotNull()).select("user_id", "email", "name")
    pre, post = OUTBOX_SUBJECT.split("{id}")
    return r.join(u, "user_id").select(
        "pair_id", F.col("email").alias("to"),
        F.concat(F.lit(pre), F.col("pair_id"), F.lit(post)).alias("subject"),
        F.concat(F.lit("Hi "), F.coalesce(F.col("name"), F.lit("there")), F.lit(", your code analysis ("),
                 F.col("pair_id"), F.lit(") is complete. Summary: "), F.col("summary"),
                 F.lit(". Overall Score: "), F.col("overall_score").cast("string")).alias("text"))
