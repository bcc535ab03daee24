"""Mapping legacy elements to refactored elements, and the element diff.

A pair's elements are two arrays of one row, so the mapping and the diff are made in the row, without any
shuffle, by a small helper (``functions.matching``) in an Arrow UDF:

* hints: explicit legacy-name -> refactored-name pairs, both resolved to the first element of that name;
* best match: for every other named legacy element, the refactored element with the highest similarity (ties: the
  earliest), kept if > 0.7.  Equal names score 1.0 and are found by look-up; the rest is pruned by what kind,
  parameters and name lengths still allow;
* added / removed / modified: by an equivalence key of type, text and metadata.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import cloudpickle

import codedelta.functions.matching as _matching
from codedelta.functions.batches import bound_batches, in_pieces, rows_of
from codedelta.functions.matching import changes
from codedelta.functions.text import pin
from codedelta.operators.elements import _ELEMENT, _ELEMENTS_ARROW, _element_rows
from codedelta.rules import FUZZY_MIN_SIMILARITY

# Ship the UDF and its helper by value: executors need no installed package.
cloudpickle.register_pickle_by_value(_matching)
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))

SOURCES = ["hint", "name", "fuzzy"]
_PARTS = ("l", "r", "s", "added", "removed", "modified")
_CHANGES = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in _PARTS])
_CHANGED = T.StructType([T.StructField("le", T.ArrayType(_ELEMENT)), T.StructField("re", T.ArrayType(_ELEMENT)), T.StructField("ch", _CHANGES)])
_CHANGES_ARROW = pa.struct([(n, pa.list_(pa.int32())) for n in _PARTS])
_CHANGED_ARROW = pa.struct([("le", _ELEMENTS_ARROW), ("re", _ELEMENTS_ARROW), ("ch", _CHANGES_ARROW)])


def _row_changes(left, right, hint_from, hint_to):
    """The changes between two element lists; elements of equal type, text and metadata are equivalent."""
    def named(es):
        return [(kind, name, params) for _, kind, _, name, params, _, _ in es]

    def keys(es):
        return [(kind, text, name, tuple(params), tuple(imports)) for _, kind, _, name, params, imports, text in es]
    hints = dict(zip(hint_from, hint_to)) if hint_from is not None else {}
    return changes(named(left), named(right), keys(left), keys(right), hints, FUZZY_MIN_SIMILARITY)


@F.arrow_udf(_CHANGES)
def _changes_udf(legacy: pa.Array, refactored: pa.Array, language: pa.Array, hint_from: pa.Array, hint_to: pa.Array) -> pa.Array:
    return pa.array([_row_changes(_element_rows(a, lang), _element_rows(b, lang), x, y)
                     for a, b, lang, x, y in rows_of(legacy, refactored, language, hint_from, hint_to)], _CHANGES_ARROW)


@F.arrow_udf(_CHANGED)
def _changed_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def make(*columns):
        out = []
        for a, b, lang, x, y in rows_of(*columns):
            left, right = _element_rows(a, lang), _element_rows(b, lang)
            out.append((left, right, _row_changes(left, right, x, y)))
        return pa.array(out, _CHANGED_ARROW)
    return in_pieces(batches, make, texts=2)


def _arguments(legacy, refactored, hints, lang):
    return [F.col(legacy), F.col(refactored), F.col(lang), F.map_keys(hints), F.map_values(hints)]


def changes_col(legacy: str = "legacy", refactored: str = "refactored", hints: str = "map_hints", lang: str = "language") -> Column:
    """struct<l, r, s, added, removed, modified>: mapping and differing positions of the texts' elements, which stay in the helper."""
    return _changes_udf(*_arguments(legacy, refactored, hints, lang))


def with_changes(df: DataFrame, legacy: str = "legacy", refactored: str = "refactored", hints: str = "map_hints",
                 lang: str = "language") -> DataFrame:
    """Adds ``_le`` / ``_re`` (element arrays of the texts) and ``_ch`` (mapping and differing positions)."""
    bound_batches(df.sparkSession)
    d = df.withColumn("_changed", _changed_udf(*_arguments(legacy, refactored, hints, lang)))
    return d.withColumns({"_le": pin(F.col("_changed.le")), "_re": pin(F.col("_changed.re")), "_ch": pin(F.col("_changed.ch"))}).drop("_changed")


def element_changes(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, _le, _re, _ch) of pairs with texts, language and hints."""
    return with_changes(pairs.select(key, "language", "map_hints", "legacy", "refactored")).select(key, "_le", "_re", "_ch")


def changed_positions(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, _ch) of the same pairs, where the elements themselves are not asked for."""
    bound_batches(pairs.sparkSession)
    return pairs.select(key, changes_col().alias("_ch"))


def mapping_rows(changed: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, l_ord, r_ord, source) — hints and best matches."""
    rows = changed.select(key, F.explode(F.arrays_zip(F.col("_ch.l").alias("l"), F.col("_ch.r").alias("r"), F.col("_ch.s").alias("s"))).alias("m"))
    return rows.select(key, F.col("m.l").alias("l_ord"), F.col("m.r").alias("r_ord"),
                       F.element_at(F.array(*[F.lit(x) for x in SOURCES]), F.col("m.s") + 1).alias("source"))


def at_positions(elements: Column, positions: Column) -> Column:
    """The elements at 0-based positions."""
    return F.transform(positions, lambda i: F.element_at(elements, i + 1))


def modified_array(changed_key: str = "_ch") -> Column:
    """array<struct> of mapped elements that are not equivalent, with change descriptions."""
    ch = F.col(changed_key)

    def of(i):
        l, r = F.element_at(F.col("_le"), F.element_at(ch["l"], i + 1) + 1), F.element_at(F.col("_re"), F.element_at(ch["r"], i + 1) + 1)
        same_meta = l["name"].eqNullSafe(r["name"]) & (l["parameters"] == r["parameters"]) & (l["imports"] == r["imports"])
        return F.struct(
            l["ord"].alias("l_ord"), r["ord"].alias("r_ord"), l["kind"].alias("l_kind"), r["kind"].alias("r_kind"),
            l["name"].alias("l_name"), r["name"].alias("r_name"), r["imports"].alias("r_imports"),
            F.array_compact(F.array(
                F.when(l["kind"] != r["kind"], F.concat(F.lit("Type changed: "), l["kind"], F.lit(" -> "), r["kind"])),
                F.when(l["text"] != r["text"], F.lit("Content modified")),
                F.when(~same_meta, F.lit("Metadata changed")))).alias("changes"))
    return F.transform(ch["modified"], of)


def diff_summary(added: Column, removed: Column, modified: Column) -> Column:
    """``n nodes added, m nodes removed, k nodes modified`` skipping zeros."""
    return F.concat_ws(", ",
                       F.when(added > 0, F.concat(added.cast("string"), F.lit(" nodes added"))),
                       F.when(removed > 0, F.concat(removed.cast("string"), F.lit(" nodes removed"))),
                       F.when(modified > 0, F.concat(modified.cast("string"), F.lit(" nodes modified"))))


def element_impact(added: Column, removed: Column, modified: Column) -> Column:
    """min(2*added + 3*removed + modified, 100)."""
    return F.least(added * 2 + removed * 3 + modified, F.lit(100))
