"""Impact metrics and the 0-100 impact score with its level.

All per-pair: the merged refactoring types are an array in the row, so the
type-driven metrics are array aggregates, and the score is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codedelta.rules import (COMPLEX_TYPES, DEPENDENCY_PATTERNS, IMPACT_DESCRIPTIONS, INFRASTRUCTURE_TYPES,
                             LANGUAGE_ADJUSTMENTS, LEVEL_THRESHOLDS, SCORE_WEIGHTS, SIMPLIFYING_TYPES)


def _count(types: Column, pred) -> Column:
    return F.size(F.filter(types, pred))


def architectural_changes(types: Column) -> Column:
    return _count(types, lambda t: t["level"] >= 4)


def infrastructure_components(types: Column) -> Column:
    return _count(types, lambda t: t["type"].isin(INFRASTRUCTURE_TYPES))


def complexity_delta(types: Column) -> Column:
    """Sum of 2*level for complex types, level otherwise, minus level for
    simplifying types; floored at -10."""
    add = F.aggregate(types, F.lit(0), lambda acc, t: acc + F.when(t["type"].isin(COMPLEX_TYPES), t["level"] * 2)
                      .otherwise(t["level"]))
    sub = F.aggregate(types, F.lit(0), lambda acc, t: acc + F.when(t["type"].isin(SIMPLIFYING_TYPES), t["level"])
                      .otherwise(0))
    return F.greatest(add - sub, F.lit(-10))


def coverage_delta(types: Column) -> Column:
    """+10*level for Testing, -5 for any other type of level >= 3; clamped to +-50."""
    d = F.aggregate(types, F.lit(0), lambda acc, t: acc + F.when(t["type"] == "Testing", t["level"] * 10)
                    .when(t["level"] >= 3, -5).otherwise(0))
    return F.greatest(F.least(d, F.lit(50)), F.lit(-50))


def _sigmoid(x: Column, centre: float, scale: float) -> Column:
    v = F.least(F.lit(100.0) / (F.lit(1.0) + F.exp(-(x.cast("double") - centre) / scale)), F.lit(100.0))
    return F.when(x == 0, F.lit(0.0)).otherwise(v)


def norm_lines(x: Column) -> Column:
    return _sigmoid(x, 200.0, 100.0)


def norm_nodes(x: Column) -> Column:
    return _sigmoid(x, 50.0, 25.0)


def norm_infra(n: Column) -> Column:
    return F.least(n.cast("double") * 20, F.lit(100.0))


def norm_coverage(d: Column) -> Column:
    return F.least(F.greatest((d.cast("double") + 50) * 2, F.lit(0.0)), F.lit(100.0))


def norm_complexity(d: Column) -> Column:
    return F.least(F.greatest((F.lit(10.0) - d.cast("double")) * 5, F.lit(0.0)), F.lit(100.0))


def raw_score(lines_changed: Column, nodes_changed: Column, infra: Column, coverage: Column,
              complexity: Column, weights: dict | None = None) -> Column:
    w = dict(SCORE_WEIGHTS, **(weights or {}))
    return (norm_lines(lines_changed) * w["lines"] + norm_nodes(nodes_changed) * w["nodes"]
            + norm_infra(infra) * w["infra"] + norm_coverage(coverage) * w["coverage"]
            + norm_complexity(complexity) * w["complexity"])


def overall_score(raw: Column) -> Column:
    """Clamp to 0..100 and round half up."""
    return F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)) + 0.5).cast("int")


def level_of(score: Column, thresholds=LEVEL_THRESHOLDS) -> Column:
    expr = None
    for lv, th in thresholds:
        expr = F.when(score >= th, F.lit(lv)) if expr is None else expr.when(score >= th, F.lit(lv))
    return expr.otherwise(F.lit(0))


def dependencies(text: Column) -> Column:
    """Distinct dependency names named by import/require/from/using/include in ``text``."""
    parts = [F.regexp_extract_all(text, F.lit(p), 1) for p in DEPENDENCY_PATTERNS]
    return F.array_distinct(F.concat(*parts))


def language_multipliers(language: Column) -> tuple[Column, Column]:
    """(complexity multiplier, infrastructure weight) with 1.0 for other languages."""
    cm = F.create_map(*[x for k, (c, _i) in LANGUAGE_ADJUSTMENTS.items() for x in (F.lit(k), F.lit(c))])
    iw = F.create_map(*[x for k, (_c, i) in LANGUAGE_ADJUSTMENTS.items() for x in (F.lit(k), F.lit(i))])
    return F.coalesce(cm[language], F.lit(1.0)), F.coalesce(iw[language], F.lit(1.0))


def impact_description(level: Column, infra: Column, arch: Column) -> Column:
    base = F.element_at(F.array(*[F.lit(d) for d in IMPACT_DESCRIPTIONS]), level + 1)
    return F.concat(
        F.coalesce(base, F.lit(IMPACT_DESCRIPTIONS[0])),
        F.when(infra > 0, F.concat(F.lit(" ("), infra.cast("string"), F.lit(" new infrastructure components)")))
         .otherwise(F.lit("")),
        F.when(arch > 0, F.concat(F.lit(" ("), arch.cast("string"), F.lit(" architectural changes)")))
         .otherwise(F.lit("")))
