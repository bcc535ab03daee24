"""Packs of many rule texts, found in one pass over each text.

A pack is a DataFrame (seq, text).  Its texts go into an Aho-Corasick automaton, which a Python worker builds once and
keeps beside the broadcast rules for all its tasks; a text is then read once, whatever the number of rules.  Packs larger than ``PART_BYTES`` are
split by a hash of the rule text into parts with an automaton each, so what is broadcast at once stays bounded.
Null and empty rule texts are never found; equal rule texts are found together."""

from __future__ import annotations

import sys

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_BYTES = 32 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def automaton(rules):
    """Automaton over the rule texts; a text's value are the seqs of its rules."""
    seqs: dict = {}
    for seq, text in rules:
        seqs.setdefault(text, []).append(seq)
    out = ahocorasick.Automaton()
    for text, own in seqs.items():
        out.add_word(text, own)
    if seqs:
        out.make_automaton()
    return out


def found(machine, text: str | None) -> list[int] | None:
    """Sorted seqs of the rules whose text lies in ``text``; null for null."""
    if text is None:
        return None
    return sorted({s for _, own in machine.iter(text) for s in own}) if len(machine) else []


def pack_of(spark, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "seq long, text string")


def _seqs(held):
    @F.pandas_udf("array<long>")
    def seqs(texts: pd.Series) -> pd.Series:
        # A worker keeps a broadcast's value between tasks, and the automaton with it.
        box = held.value
        if "machine" not in box:
            box["machine"] = automaton(box["rules"])
        return pd.Series([found(box["machine"], t) for t in texts], dtype=object)
    return seqs


def pack_hits(pack: DataFrame, text: Column, part_bytes: int = PART_BYTES) -> Column:
    """array<long> of the seqs of the pack's rules whose text lies in ``text`` (case-sensitive; lower both first)."""
    spark = pack.sparkSession
    rules = pack.select("seq", "text").filter(F.octet_length("text") > 0)
    size = rules.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_parts = -(-size // part_bytes) or 1
    hits = []
    for part in range(n_parts):
        own = rules.filter(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part) if n_parts > 1 else rules
        held = spark.sparkContext.broadcast({"rules": [tuple(r) for r in own.collect()]})
        hits.append(_seqs(held)(text))
    return F.array_sort(F.concat(*hits)) if n_parts > 1 else hits[0]


def pack_counts(df: DataFrame, text_col: str, pack: DataFrame) -> DataFrame:
    """(seq, n_texts): the number of rows of ``df`` whose text holds each rule of the pack (rules found nowhere are left out)."""
    hits = df.select(F.explode(pack_hits(pack, F.col(text_col))).alias("seq"))
    return hits.groupBy("seq").agg(F.count(F.lit(1)).alias("n_texts"))
