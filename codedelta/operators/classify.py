"""Refactoring classification and the merge of detections per type.

File level (the live behaviour): every text rule is a case-insensitive
substring test on the pair's patch (changed lines plus context).  The rule
table is a literal array, so matching is an in-row ``filter`` over it — no
join, no shuffle — and the merge per type is also done in-row.

Node level (optional): rules are tested on added / removed / modified
elements, which are arrays of the same row; detections from all sources are
concatenated in order and merged like those of the file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codedelta.rules import (FILE_RULE_CONFIDENCE, SUMMARY_RULE, node_rules,
                             text_rules)

DETECTION_TYPE = "struct<seq:int,type:string,level:int,evidence:string,confidence:double>"


def _rule_array() -> Column:
    return F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(t).alias("type"), F.lit(lv).alias("level"),
                              F.lit(txt).alias("text"))
                     for _o, t, lv, seq, txt in text_rules()])


def file_detections(patch_lower: Column, summary: Column | None = None) -> Column:
    """array<detection> of text rules found in the lower-cased patch, rule order,
    followed by the summary rule (import/dependency words in the diff summary)."""
    hits = F.filter(_rule_array(), lambda r: F.contains(patch_lower, r["text"]))
    dets = F.transform(hits, lambda r: F.struct(
        r["seq"].alias("seq"), r["type"].alias("type"), r["level"].alias("level"),
        F.concat(F.lit("Found "), r["text"], F.lit(" in file changes")).alias("evidence"),
        F.lit(FILE_RULE_CONFIDENCE).alias("confidence")))
    if summary is not None:
        stype, slevel, words, sevidence, sconf = SUMMARY_RULE
        cond = None
        for w in words:
            c = F.lower(summary).contains(w)
            cond = c if cond is None else (cond | c)
        extra = F.when(cond, F.array(F.struct(
            F.lit(len(node_rules()) + 1).alias("seq"), F.lit(stype).alias("type"), F.lit(slevel).alias("level"),
            F.lit(sevidence).alias("evidence"), F.lit(sconf).alias("confidence")))).otherwise(
            F.array().cast(f"array<{DETECTION_TYPE}>"))
        dets = F.concat(dets, extra)
    return dets


def fold_mean(confs: Column) -> Column:
    """Running pairwise mean ``acc = (acc + x) / 2`` starting from the first value."""
    return F.aggregate(F.slice(confs, 2, F.greatest(F.size(confs) - 1, F.lit(0))), F.try_element_at(confs, F.lit(1)),
                       lambda acc, x: (acc + x) / 2)


def merge_in_row(dets: Column) -> Column:
    """Merge an ordered detection array by type: max level, distinct evidence in
    first-seen order, folded confidence; sorted by level desc, then first seen."""
    def of_type(t):
        own = F.filter(dets, lambda d: d["type"] == t)
        return F.transform(F.array(own), lambda ds: F.struct(
            (-F.array_max(F.transform(ds, lambda d: d["level"]))).alias("neg_level"),
            F.array_position(F.transform(dets, lambda d: d["type"]), t).alias("first"),
            t.alias("type"),
            F.array_distinct(F.transform(ds, lambda d: d["evidence"])).alias("evidence"),
            fold_mean(F.transform(ds, lambda d: d["confidence"])).alias("confidence")))[0]

    merged = F.array_sort(F.transform(F.array_distinct(F.transform(dets, lambda d: d["type"])), of_type))
    return F.transform(merged, lambda m: F.struct(m["type"].alias("type"), (-m["neg_level"]).alias("level"),
                                                  m["evidence"].alias("evidence"), m["confidence"].alias("confidence")))


# --------------------------------------------------------------------------
# Node level
# --------------------------------------------------------------------------

def _node_evidence(rule_text: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws(" ",
                       F.when(rule_text.isNotNull(), F.concat(F.lit("Found "), rule_text, F.lit(" usage"))),
                       F.when(name.isNotNull() & (name != ""), F.concat(F.lit("in "), name)),
                       F.when(kind.isNotNull(), F.concat(F.lit("("), kind, F.lit(")"))))


def _node_confidence(text_hit: Column, type_hit: Column, name: Column, imports: Column) -> Column:
    c = (F.lit(0.5) + F.when(text_hit, 0.3).otherwise(0.0) + F.when(type_hit, 0.2).otherwise(0.0)
         + F.when(name.isNotNull() & (name != ""), 0.1).otherwise(0.0)
         + F.when(F.size(imports) > 0, 0.1).otherwise(0.0))
    return F.least(c, F.lit(1.0))


def _node_rules_array() -> Column:
    return F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(t).alias("type"), F.lit(lv).alias("level"),
                              F.lit(nt).cast("string").alias("node_type"), F.lit(txt).cast("string").alias("text"),
                              F.lit(cond).alias("condition"))
                     for _o, t, lv, seq, nt, txt, cond in node_rules()])


def node_detections(added: Column, removed: Column, modified: Column) -> Column:
    """array<struct<src, ord, seq, type, level, evidence, confidence>> of element changes, in the order of the sources
    added, removed, modified, then element, then rule.

    Added elements test type rules with condition isNew and all text rules;
    removed elements test the removed type rules; a mapped element whose name
    changed fires Rename Symbol (our reading of the name-change rule)."""
    rules = _node_rules_array()

    def from_nodes(nodes, condition, src):
        def of(e):
            low = F.lower(e["text"])
            hits = F.filter(rules, lambda r: (r["condition"] == condition)
                            & (r["node_type"].isNull() | (r["node_type"] == e["kind"]))
                            & (r["text"].isNull() | F.contains(low, F.lower(r["text"])))
                            & (r["node_type"].isNotNull() | r["text"].isNotNull()))
            return F.transform(hits, lambda r: F.struct(
                F.lit(src).alias("src"), e["ord"].alias("ord"), r["seq"].alias("seq"), r["type"].alias("type"), r["level"].alias("level"),
                _node_evidence(r["text"], e["name"], e["kind"]).alias("evidence"),
                _node_confidence(r["text"].isNotNull(), r["node_type"].isNotNull(), e["name"], e["imports"]).alias("confidence")))
        return F.flatten(F.transform(nodes, of))

    rename_seq, rename_type, rename_level = [(seq, t, lv) for _o, t, lv, seq, nt, txt, cond in node_rules()
                                             if cond == "nameChanged"][0]
    renamed = F.filter(modified, lambda m: m["l_name"].isNotNull() & m["r_name"].isNotNull() & (m["l_name"] != m["r_name"]))
    renames = F.transform(renamed, lambda m: F.struct(
        F.lit("modified").alias("src"), m["r_ord"].alias("ord"), F.lit(rename_seq).alias("seq"), F.lit(rename_type).alias("type"),
        F.lit(rename_level).alias("level"), _node_evidence(F.lit(None).cast("string"), m["r_name"], m["r_kind"]).alias("evidence"),
        _node_confidence(F.lit(False), F.lit(False), m["r_name"], m["r_imports"]).alias("confidence")))
    return F.concat(from_nodes(added, "isNew", "added"), from_nodes(removed, "removed", "removed"), renames)


def as_plain(dets: Column) -> Column:
    """Node detections in the form of file detections."""
    return F.transform(dets, lambda d: F.struct(d["seq"].alias("seq"), d["type"].alias("type"), d["level"].alias("level"),
                                                d["evidence"].alias("evidence"), d["confidence"].alias("confidence")))
