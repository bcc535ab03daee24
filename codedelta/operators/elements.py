"""Code elements (functions, methods, classes, imports), the bracket tree, and lexical tokens.

Elements come from one linear scan of the whole text (``functions.codescan``): strings and comments are skipped, brackets
paired, so an element's text ends at its own closing bracket, or for Python where the indentation ends; nested elements
lie inside the text of the outer one.  Everything stays inside the row, so extraction never shuffles.

The signatures are this package's own extractor (the analysed tool used full grammars).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import cloudpickle

import codedelta.functions.batches as _batches
import codedelta.functions.codescan as _codescan
import codedelta.functions.matching as _matching
from codedelta.functions.batches import bound_batches, in_pieces, rows_of
from codedelta.functions.matching import only_in_second
from codedelta.functions.text import pin

# Ship the UDF and its helper by value: executors need no installed package.
cloudpickle.register_pickle_by_value(_batches)
cloudpickle.register_pickle_by_value(_codescan)
cloudpickle.register_pickle_by_value(_matching)
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))

# Parsed languages.
LANGUAGES = list(_codescan.LANGUAGES)
FUNCTION_KINDS = ["function_declaration", "method_declaration", "function_definition"]
IMPORT_KINDS = _codescan.IMPORT_KINDS
STRIP = " \t\r\n"

# Lexical tokens for node counts: identifiers, numbers, any other non-space character.
TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\r\f\x0B]"


_ELEMENT = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("name", T.StringType()), T.StructField("parameters", T.ArrayType(T.StringType())),
    T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])
_NODE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType())])


def _element_rows(text, language):
    if not text or language not in LANGUAGES:
        return []
    out = []
    for i, (kind, start, end, line, name, params) in enumerate(_codescan.elements(text, language)):
        own = text[start:end].strip(STRIP)
        out.append((i, kind, line, name, params, [own] if kind in IMPORT_KINDS else [], own))
    return out


_ELEMENTS_ARROW = pa.list_(pa.struct([
    ("ord", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("parameters", pa.list_(pa.string())),
    ("imports", pa.list_(pa.string())), ("text", pa.string())]))


@F.arrow_udf(T.ArrayType(_ELEMENT))
def _elements_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def make(text, language):
        return pa.array([_element_rows(t, lang) for t, lang in rows_of(text, language)], _ELEMENTS_ARROW)
    return in_pieces(batches, make)


#: Kinds that ``subtree_counts`` counts, in the order of its columns.
COUNTED_KINDS = [_codescan.GROUP, _codescan.IDENTIFIER, _codescan.NUMBER, _codescan.STRING, _codescan.COMMENT, _codescan.PUNCTUATION]
_KIND_CODE = {kind: k for k, kind in enumerate(COUNTED_KINDS)}


def _lists(sizes, types, columns, names):
    """An Arrow column of lists of structs from flat columns; row i has ``sizes[i]`` of their entries."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names))


def _trees(text, language):
    for t, lang in rows_of(text, language):
        yield _codescan.nodes(t or "", lang) if lang in LANGUAGES else []


@F.arrow_udf(T.ArrayType(_NODE))
def _nodes_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def make(text, language):
        trees = list(_trees(text, language))
        columns = list(zip(*[n for tree in trees for n in tree])) or [()] * 7
        return _lists([len(t) for t in trees], [pa.string()] + [pa.int32()] * 6, columns, _NODE.names)
    return in_pieces(batches, make)


_SUBTREE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("pre", "post", "depth")]
                        + [T.StructField(f"n_{kind}", T.IntegerType()) for kind in COUNTED_KINDS])


@F.arrow_udf(T.ArrayType(_SUBTREE))
def _subtrees_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The inner nodes of each text with the nodes of their subtrees by kind: differences of running counts."""
    def make(text, language):
        sizes, parts = [], []
        for tree in _trees(text, language):
            inner = [n for n in tree if n[0] in (_codescan.ROOT, _codescan.GROUP)]
            kinds = np.array([_KIND_CODE.get(n[0], -1) for n in tree], np.int8)
            pre, post, depth = (np.array([n[k] for n in inner], np.int32) for k in (1, 2, 3))
            upto = [np.concatenate([[0], np.cumsum(kinds == k)]).astype(np.int32) for k in range(len(COUNTED_KINDS))]
            sizes.append(len(inner))
            parts.append([pre, post, depth, *[u[post + 1] - u[pre] for u in upto]])
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int32)] * len(_SUBTREE)
        return _lists(sizes, [pa.int32()] * len(_SUBTREE), columns, _SUBTREE.names)
    return in_pieces(batches, make)


def with_elements(df: DataFrame, text: str, out: str, lang: str = "language") -> DataFrame:
    """Adds ``out``: array<struct<ord, kind, line, name, parameters, imports, text, eq>> of the text, in
    source order (none for other languages); nothing leaves the row."""
    bound_batches(df.sparkSession)
    found = df.withColumn(out, _elements_udf(F.col(text), F.col(lang)))
    return found.withColumn(out, pin(F.transform(out, lambda e: e.withField("eq", equivalence_key(e)))))


def _sides(pairs: DataFrame, key: str, lang: str, legacy: str, refactored: str) -> DataFrame:
    return pairs.select(key, lang, F.explode(F.array(
        F.struct(F.lit("legacy").alias("side"), F.col(legacy).alias("source")),
        F.struct(F.lit("refactored").alias("side"), F.col(refactored).alias("source")),
    )).alias("s")).select(key, lang, "s.side", "s.source")


def elements(pairs: DataFrame, key: str = "pair_id", lang: str = "language",
             legacy: str = "legacy", refactored: str = "refactored") -> DataFrame:
    """Long element rows: (key, side, ord, kind, line, name, parameters, imports, text)."""
    out = with_elements(_sides(pairs, key, lang, legacy, refactored), "source", "_els", lang)
    return out.select(key, "side", F.explode("_els").alias("e")).select(key, "side", "e.*").drop("eq")


def node_rows(pairs: DataFrame, key: str = "pair_id", lang: str = "language",
              legacy: str = "legacy", refactored: str = "refactored") -> DataFrame:
    """All nodes of the bracket trees: (key, side, pre, post, depth, parent, kind, size, text), text null for inner nodes.

    A node's subtree holds the nodes from ``pre`` to ``post``, so it is a range of the array and ``size`` a difference."""
    bound_batches(pairs.sparkSession)
    # The UDF stands in ``explode`` itself: for a column of its own Catalyst would add a filter on its size and scan each text twice.
    rows = _sides(pairs, key, lang, legacy, refactored).select(key, "side", "source", F.explode(_nodes_udf(F.col("source"), F.col(lang))).alias("n"))
    leaf = ~F.col("n.kind").isin(_codescan.ROOT, _codescan.GROUP)
    return rows.select(key, "side", "n.pre", "n.post", "n.depth", "n.parent", "n.kind", (F.col("n.post") - F.col("n.pre") + 1).alias("size"),
                       F.when(leaf, F.substring("source", F.col("n.start") + 1, F.col("n.stop") - F.col("n.start"))).alias("text"))


def subtree_counts(pairs: DataFrame, key: str = "pair_id", lang: str = "language",
                   legacy: str = "legacy", refactored: str = "refactored") -> DataFrame:
    """Per inner node (key, side, pre, depth, size) the nodes of its subtree by kind, by interval: a node counts where its ``pre`` lies
    between ``pre`` and ``post``.  Running counts over the text's nodes turn that into two look-ups."""
    bound_batches(pairs.sparkSession)
    d = _sides(pairs, key, lang, legacy, refactored).select(key, "side", F.explode(_subtrees_udf(F.col("source"), F.col(lang))).alias("n"))
    return d.select(key, "side", "n.pre", "n.depth", (F.col("n.post") - F.col("n.pre") + 1).alias("size"),
                    *[F.col(f"n.n_{kind}").cast("long").alias(f"n_{kind}") for kind in COUNTED_KINDS])


def equivalence_key(e: Column) -> Column:
    """64-bit key of "same type, same text, same metadata", compared within one pair only."""
    return F.xxhash64(e["kind"], e["text"], F.coalesce(e["name"], F.lit("\u0000")), e["parameters"], e["imports"])


TOKEN_CHANGES = T.StructType([T.StructField("tokens_added", T.LongType()), T.StructField("tokens_removed", T.LongType())])


def token_hashes(text: Column) -> Column:
    """array<long>: hashes of the lexical tokens of a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0), lambda t: F.xxhash64(t))


def _numbers(column):
    """Each row of a column of lists of numbers as an array, without Python objects."""
    values, offsets = np.asarray(column.values), column.offsets.to_pylist()
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


@F.arrow_udf(TOKEN_CHANGES)
def _token_udf(old: pa.Array, new: pa.Array) -> pa.Array:
    rows = [(only_in_second(x, y), only_in_second(y, x)) for x, y in zip(_numbers(old), _numbers(new))]
    return pa.array(rows, pa.struct([("tokens_added", pa.int64()), ("tokens_removed", pa.int64())]))


def token_changes(legacy: Column, refactored: Column) -> Column:
    """struct<tokens_added, tokens_removed>: occurrences whose token does not occur at all on the other side.
    Both texts are in one row, so tokens are counted there from their hashes."""
    return _token_udf(token_hashes(legacy), token_hashes(refactored))
