"""Exact ranked lexical search over a length-stratified index.

Terms are maximal runs of ``[0-9A-Za-z]`` and non-ASCII characters, A-Z lower-cased.  N counts the documents with a
term, L all their terms, n one document's terms, df the documents that hold a term.  A term weighs
w = floor(1000 * ln((2N + 2) / (2 df + 1))); a document's normaliser is m = 75 + (25 n N) div L; its score for an item is the sum
of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, in whole numbers.  The steps:

1. One pass over the texts keeps, per document, n and the counts of terms that the items ask for.
2. Documents are dealt out by ranges of (m, doc_id) and cut into pieces: a stratum holds documents of equal m, a piece at most
   ``PIECE_DOCS`` of one stratum, so that a stratum with a third of all rows lies in many tasks.  A piece has, per term,
   its documents by tf, highest first.  Within a stratum a term's impact depends on tf only: it is computed once per (term, tf).
3. Search reads the pieces, a bounded number at a time.  The impacts of each term's highest tf bound what any document
   of a piece can score for an item; pieces are visited by falling bound, until the bound is below the item's k-th best score.
4. Each task gives its best k per item; a window ranks them.

Items are searched in blocks of about ``BLOCK_ENTRIES`` (item, term) entries, so what goes to the driver and to the
tasks is bounded, whatever the number of items; every block is searched against all documents.

Edge cases: a null, empty or termless text has no terms, does not count in N and is never found; repeated document rows are
documents of their own; a null doc_id comes after all others in a tie; rows that share an item_id (null included) are one item
with the terms of all; items without terms or without hits have no rows; an empty table gives no rows; other columns are not read.
Sums are exact below 2^63, that is for items of fewer than 10^8 terms.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codedelta.llm.common import ascii_lower, map_arrow, read_table, write_table

TOP = 20
PIECE_DOCS = 8192
PIECE_POSTINGS = 1 << 20
#: Postings of the pieces that a task holds at a time.
WINDOW_POSTINGS = 1 << 22
BLOCK_ENTRIES = 1 << 18
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8 bytes, after bytes.lower(), which changes A-Z only.
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20

SCANNED = "doc_id long, n long, terms array<int>, tfs array<int>"
PIECES = "m long, docs array<long>, g_term array<int>, g_tf array<int>, g_len array<int>, member array<int>"


def slices(data: bytes, size: int = SLICE):
    """The bytes in parts of about ``size``, cut where no term is cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            rest = TERM_BYTES.match(data, end)
            end = rest.end() if rest else end
        yield data[at:end]
        at = end


def count_terms(data: bytes, vocabulary: dict):
    """(n, ids, counts): all terms of a text, and the vocabulary's terms with their occurrences."""
    n, ids, counts = 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
    for part in slices(data):
        found = TERM_BYTES.findall(part.lower())
        n += len(found)
        got, c = np.unique(np.array([vocabulary[t] for t in found if t in vocabulary], np.int32), return_counts=True)
        if len(ids):
            got, inverse = np.unique(np.concatenate([ids, got]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([counts, c])).astype(np.int64)
        ids, counts = got, c
    return n, ids, counts


def _lists(parts, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def scan(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)      # bounded by BLOCK_ENTRIES

    def run(batches):
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i, text in zip(b.column(0), b.column(1)):
                n, t, c = count_terms(text.as_py(), shared.value)
                if n:
                    ids.append(i.as_py())
                    ns.append(n)
                    terms.append(t)
                    tfs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), _lists(terms, np.int32), _lists(tfs, np.int32)],
                                             names=["doc_id", "n", "terms", "tfs"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "utf-8").alias("text")).filter("text is not null")
    return map_arrow(texts, run, SCANNED)


def _piece(m: int, docs: list, lens: list, terms: np.ndarray, tfs: np.ndarray) -> tuple:
    member = np.repeat(np.arange(len(docs), dtype=np.int32), lens)
    order = np.lexsort((member, -tfs, terms))
    terms, tfs, member = terms[order], tfs[order], member[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])
    first = np.flatnonzero(new)
    return m, docs, terms[first], tfs[first], np.diff(np.append(first, len(terms))), member


def _piece_batch(p: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0]], pa.int64()), pa.array([p[1]], pa.list_(pa.int64())), *[_lists([x], np.int32) for x in p[2:]]],
        names=["m", "docs", "g_term", "g_tf", "g_len", "member"])


def build_pieces(batches):
    """Pieces from rows (m, doc_id, terms, tfs) in the order of m and doc_id."""
    m, docs, lens, terms, tfs, held = None, [], [], [], [], 0

    def flush():
        return _piece_batch(_piece(m, docs, lens, np.concatenate(terms), np.concatenate(tfs)))
    for b in batches:
        for row_m, doc, t, c in zip(*(b.column(k) for k in range(4))):
            row_m = row_m.as_py()
            if docs and (row_m != m or len(docs) >= PIECE_DOCS or held >= PIECE_POSTINGS):
                yield flush()
                docs, lens, terms, tfs, held = [], [], [], [], 0
            m = row_m
            t = t.values.to_numpy()
            docs.append(doc.as_py())
            lens.append(len(t))
            terms.append(t)
            tfs.append(c.values.to_numpy())
            held += len(t)
    if docs:
        yield flush()


def build_index(scanned: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The pieces, from a written table of ``scan``.  Documents without any of the items' terms have no place in it."""
    # Decimals: 25 n N may exceed 64 bits.
    m = F.expr(f"75 + cast((cast(25 as decimal(38,0)) * n * cast({n_docs} as decimal(12,0))) div cast({n_terms} as decimal(20,0)) as bigint)")
    rows = (scanned.filter(F.size("terms") > 0).withColumn("m", m).withColumn("row", F.monotonically_increasing_id())
            .repartitionByRange("m", F.col("doc_id").asc_nulls_last(), "row").sortWithinPartitions("m", F.col("doc_id").asc_nulls_last(), "row"))
    return map_arrow(rows.select("m", "doc_id", "terms", "tfs"), build_pieces, PIECES)


def impact(weight, tf, m):
    """w * ((10^9 tf) div (1000 tf + 12 m))."""
    return weight * ((1000000000 * tf) // (1000 * tf + 12 * m))


class Queries:
    """Items of one block: entries (term, repeats) by item, and the terms' weights."""

    def __init__(self, items: list, starts: np.ndarray, terms: np.ndarray, repeats: np.ndarray, weights: np.ndarray):
        self.items, self.starts, self.terms, self.repeats, self.weights = items, starts, terms, repeats, weights

    def entries(self, k: int):
        at = slice(self.starts[k], self.starts[k + 1])
        return self.terms[at], self.repeats[at]


class Piece:
    """One piece, opened: each term's postings with their impacts."""

    def __init__(self, q: Queries, m: int, docs: pa.Array, g_term, g_tf, g_len, member):
        self.docs, self.member = docs, member
        ends = np.cumsum(g_len)
        of_group = impact(q.weights[g_term], g_tf.astype(np.int64), m)
        self.impacts = np.repeat(of_group, g_len)
        top = np.ones(len(g_term), bool)                     # highest tf of each term
        top[1:] = g_term[1:] != g_term[:-1]
        first = np.flatnonzero(top)
        self.from_, self.to = np.zeros(len(q.weights), np.int64), np.zeros(len(q.weights), np.int64)
        self.from_[g_term[first]] = (ends - g_len)[first]
        self.to[g_term[first]] = ends[np.append(first[1:], len(g_term)) - 1]
        best = np.zeros(len(q.weights), np.int64)
        best[g_term[first]] = of_group[first]
        self.bounds = np.add.reduceat(q.repeats * best[q.terms], q.starts[:-1])

    def scores(self, terms, repeats) -> np.ndarray:
        out = np.zeros(len(self.docs), np.int64)
        for t, r in zip(terms, repeats):
            a, b = self.from_[t], self.to[t]
            if a < b:
                out[self.member[a:b]] += r * self.impacts[a:b]
        return out


#: Sorts after every doc_id.
_NO_ID = (1, 0)


def _key(doc):
    return _NO_ID if doc is None else (0, doc)


def visit(q: Queries, pieces: list, best: list, top: int) -> int:
    """Improves each item's list of (-score, key of the doc_id, doc_id) by the pieces; returns how many were opened."""
    bounds = np.stack([p.bounds for p in pieces])
    opened = 0
    for k in range(len(q.items)):
        terms, repeats = q.entries(k)
        for x in np.argsort(-bounds[:, k], kind="stable"):
            least = -best[k][-1][0] if len(best[k]) == top else 1
            if bounds[x, k] < least:
                break
            opened += 1
            s = pieces[x].scores(terms, repeats)
            if len(s) > top:
                least = max(least, int(np.partition(s, -top)[-top]))
            at = np.flatnonzero(s >= max(least, 1))
            if len(at) > top:                                # ties: documents lie in the order of their ids
                at = at[np.argsort(-s[at], kind="stable")[:top]]
            found = [(-int(s[i]), _key(d := pieces[x].docs[int(i)].as_py()), d) for i in at]
            best[k] = sorted(best[k] + found, key=lambda e: e[:2])[:top]
    return opened


def search(index: DataFrame, queries: Queries, item_type: pa.DataType, schema, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)        # bounded by BLOCK_ENTRIES

    def run(batches):
        q = shared.value
        best: list = [[] for _ in q.items]
        pieces, held = [], 0
        for b in batches:
            for row in zip(*b.columns):
                arrays = [x.values.to_numpy() for x in row[2:]]
                pieces.append(Piece(q, row[0].as_py(), row[1].values, *arrays))
                held += len(arrays[-1])
                if held >= WINDOW_POSTINGS:
                    visit(q, pieces, best, top)
                    pieces, held = [], 0
        if pieces:
            visit(q, pieces, best, top)
        rows = [(q.items[k], d, -s) for k, found in enumerate(best) for s, _, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], item_type), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "doc_id", "score"])
    # A row is a whole piece.
    return map_arrow(index, run, schema, rows=16)


def _block(docs: DataFrame, entries: DataFrame, item_type, schema, top: int) -> DataFrame:
    rows = entries.collect()
    vocabulary = {t: k for k, t in enumerate(sorted({r["term"].encode() for r in rows}))}
    scanned = write_table(scan(docs, vocabulary), "scanned")
    total = scanned.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    # One row per term of the block.
    for r in scanned.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items: dict = {}
    for r in rows:
        items.setdefault(r["item_id"], []).append((vocabulary[r["term"].encode()], r["repeats"]))
    flat = [e for es in items.values() for e in es]
    starts = np.concatenate([[0], np.cumsum([len(es) for es in items.values()])])
    queries = Queries(list(items), starts, np.array([t for t, _ in flat], np.int64), np.array([c for _, c in flat], np.int64), weights)
    index = write_table(build_index(scanned, total["docs"], max(total["terms"], 1)), "strata")
    return search(index, queries, item_type, schema, top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of highest score, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    term = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), 0))
    entries = write_table(items.select("item_id", term.alias("term")).groupBy("item_id", ascii_lower(F.col("term")).alias("term"))
                          .agg(F.count(F.lit(1)).alias("repeats")), "item_terms")
    id_field = entries.schema["item_id"]
    item_type = {"string": pa.string(), "int": pa.int32()}.get(id_field.dataType.simpleString(), pa.int64())
    schema = T.StructType([T.StructField("item_id", id_field.dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    blocks = math.ceil(entries.count() / block_entries)
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        mine = entries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = found.unionByName(_block(docs, mine, item_type, schema, top)) if k else _block(docs, mine, item_type, schema, top)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS ts
  FROM documents),
d AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM w WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term), g),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+')) AS term FROM benchmark),
m AS (SELECT r, doc_id, 75 + (25 * n * nn) // ll AS m FROM d, g),
s AS (SELECT q.item_id, m.r, m.doc_id, CAST(sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q.item_id, m.r, m.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
