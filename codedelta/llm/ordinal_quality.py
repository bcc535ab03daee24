"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 low quality, 2 good.  One weight vector w over hashed text features
and ordered thresholds t1 < t2 give P(grade >= k) = 1 / (1 + exp(t_k - w.x)); the expected grade is the sum of
these, and a document is kept when P(grade >= 2) reaches ``KEEP_FROM``.

Features: words and word beginnings (six and seven bytes), hashed to 2^22 cells, as presence or
as density, and shares of signs, capitals, bars, digits and immediate repeats.  A cell's presence or density enters
the model only if it is three times as frequent in a lower grade as in the best and depends on the grade
(chi-squared), so that rare words of long clean texts and common words weigh nothing.  Ratings are weighted by the inverse square root of their grade's frequency.  The fit uses at most ``FIT_ROWS`` labelled documents, those of the least id hash; the model
is at most 2 * ``MOST_CELLS`` weights and a few for the shares.  Scoring reads every whole text once.

Edge cases: null and empty texts have all features 0; ids that are labelled twice take the lower grade;
labels without document, or with a null, are ignored; without labels of two grades or more the
probabilities are those of the only grade, or 1 without any, and every document is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codedelta.llm import textnp
from codedelta.llm.common import map_texts, read_table, write_table

FIT_ROWS = 8000
CELL_BITS = 22
MOST_CELLS = 1024
LEAST_DOCS = 5
LEAST_CHI2 = 25.0
LEAST_LIFT = 3.0
KEEP_FROM = 0.3
BEGINNINGS = (6, 7)
SIGNS = b"#*$%&<>"
N_SHAPE = 6
GRADES = 3


def _shape_tables():
    def of(chars: bytes) -> np.ndarray:
        t = np.zeros(256, np.int32)
        t[list(chars)] = 1
        return t
    return [of(SIGNS), of(bytes(range(65, 91))), of(b"|"), of(b"!"), of(bytes(range(48, 58)))]


def features(data: np.ndarray, offsets: np.ndarray):
    """(cells, doc, n_words, shape): a hashed cell for every word and word beginning, and the shares of each text."""
    n = len(offsets) - 1
    part, starts, ends, doc = textnp.word_spans(data, offsets, textnp.alnum_table())
    hashes = textnp.SpanHashes(part)
    words = hashes.of(starts, ends)
    cells, docs = [words], [doc]
    for size in BEGINNINGS:
        longer = ends - starts > size
        cells.append(textnp.mix64(hashes.of(starts[longer], starts[longer] + size) + np.uint64(size)))
        docs.append(doc[longer])
    n_words = np.bincount(doc, minlength=n)
    rel = offsets - offsets[0]
    shape = np.zeros((n, N_SHAPE))
    size = np.maximum(np.diff(rel), 1)
    for k, table in enumerate(_shape_tables()):
        total = np.concatenate([[0], np.cumsum(table[part])])
        shape[:, k] = (total[rel[1:]] - total[rel[:-1]]) / size
    again = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    shape[:, N_SHAPE - 1] = np.bincount(doc[1:][again], minlength=n) / np.maximum(n_words, 1)
    shape = np.minimum(shape * 10, 1.0)
    return (np.concatenate(cells) >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.concatenate(docs), n_words, shape


def _examples(batches):
    """Features of the training rows: distinct cells with their counts, and the shape."""
    for batch in batches:
        ids, grade = batch.column("doc_id"), np.asarray(batch.column("grade"))
        data, offsets = textnp.column_bytes(batch.column("text"))
        for lo, hi in textnp.pieces(offsets):
            cells, doc, n_words, shape = features(data, offsets[lo:hi + 1])
            code, count = np.unique((doc << CELL_BITS) | cells, return_counts=True)
            cut = np.searchsorted(code >> CELL_BITS, np.arange(hi - lo + 1))
            low = (code & ((1 << CELL_BITS) - 1)).astype(np.uint32)
            count = count.astype(np.uint32)
            yield pa.record_batch([
                ids.slice(lo, hi - lo), pa.array(grade[lo:hi]), pa.array(n_words.astype(np.int64)),
                pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                pa.array([count[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                pa.array([r.tobytes() for r in shape], pa.binary())], names=["doc_id", "grade", "n_words", "cells", "counts", "shape"])


class Ordinal:
    """Cells of the model (sorted; those of presences, then those of densities plus 2^22), weights and thresholds."""

    def __init__(self, cells=None):
        self.cells = np.empty(0, np.int64) if cells is None else cells
        self.dense = self.cells >= 1 << CELL_BITS
        self.weights = np.zeros(len(self.cells) + N_SHAPE)
        self.thresholds = np.array([-30.0, -30.0])

    def lookup(self, cells, counts, doc):
        """Positions in ``self.cells`` with counts and documents, of all cells that the model knows."""
        found = []
        for shift in (0, 1 << CELL_BITS):
            at = np.searchsorted(self.cells, cells + shift)
            hit = at < len(self.cells)
            hit[hit] = self.cells[at[hit]] == cells[hit] + shift
            found.append((at[hit], counts[hit], doc[hit]))
        return [np.concatenate(x) for x in zip(*found)]

    def rows(self, cells, counts, doc, n_words, shape):
        """(row, column, value) of the design matrix; cells: positions in ``self.cells``."""
        m, n = len(self.cells), len(n_words)
        value = np.where(self.dense[cells], np.minimum(counts * 20.0 / (n_words[doc] + 200.0), 1.0), 1.0) if m else np.empty(0)
        rows = np.concatenate([doc, np.repeat(np.arange(n), N_SHAPE)])
        cols = np.concatenate([cells, np.tile(m + np.arange(N_SHAPE), n)])
        return rows, cols, np.concatenate([value, shape.ravel()])

    def score(self, rows, cols, vals, n):
        return np.bincount(rows, vals * self.weights[cols], minlength=n)

    def tails(self, score):
        """P(grade >= 1), P(grade >= 2)."""
        z = score[:, None] - self.thresholds[None, :]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows, cols, vals, grade, steps: int = 600, rate: float = 0.1, ridge: float = 2e-5):
        """Full-batch Adam on the weighted mean of the negative log-likelihood with a ridge; the second threshold is the first
        plus a positive gap."""
        n, m = len(grade), len(self.cells) + N_SHAPE
        weight = np.sqrt(1 / np.bincount(grade, minlength=GRADES)[grade])
        weight /= weight.sum()
        x = np.zeros(m + 2)
        x[m] = -1.0
        first, second = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, steps + 1):
            self.weights, gap = x[:m], np.exp(np.clip(x[m + 1], -10, 5))
            self.thresholds = np.array([x[m], x[m] + gap])
            p = self.tails(self.score(rows, cols, vals, n))
            prob = np.maximum(np.stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]], 1)[np.arange(n), grade], 1e-9)
            d = p * (1 - p)
            up1 = np.where(grade == 0, -d[:, 0], np.where(grade == 1, d[:, 0], 0.0)) / prob
            up2 = np.where(grade == 1, -d[:, 1], np.where(grade == 2, d[:, 1], 0.0)) / prob
            g_score = -(up1 + up2) * weight
            g = np.empty_like(x)
            g[:m] = np.bincount(cols, vals * g_score[rows], minlength=m) + ridge * x[:m]
            g[m], g[m + 1] = ((up1 + up2) * weight).sum(), (up2 * weight).sum() * gap
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            x = x - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        self.weights, gap = x[:m], np.exp(np.clip(x[m + 1], -10, 5))
        self.thresholds = np.array([x[m], x[m] + gap])
        return self


def _chosen_cells(cells, counts, doc, n_words, grade) -> np.ndarray:
    """Presences and densities that are much more frequent in a lower grade than in the best.  Counts are kept
    for all cells at once, so that memory does not depend on the rows."""
    keep: set = set()
    often = (counts >= 2) & (counts * 100.0 >= n_words[doc] + 100)
    best_grade = grade == GRADES - 1
    for shift, rows in ((0, None), (1 << CELL_BITS, often)):
        def present(use):
            chosen = use[doc] if rows is None else use[doc] & rows
            return np.bincount(cells[chosen], minlength=1 << CELL_BITS).astype(np.float32)
        n0, in0 = best_grade.sum(), present(best_grade)
        for low in range(GRADES - 1):
            lower = grade == low
            n1 = lower.sum()
            if not n1 or not n0:
                continue
            in1 = present(lower)
            n, seen = n1 + n0, in1 + in0
            at = np.flatnonzero((seen >= LEAST_DOCS) & (in1 * n0 >= LEAST_LIFT * in0 * n1))
            p, q, s = in1[at].astype(float), in0[at].astype(float), seen[at].astype(float)
            chi2 = n * (p * (n0 - q) - q * (n1 - p)) ** 2 / np.maximum(s * (n - s) * n1 * n0, 1e-9)
            top = np.argsort(-chi2, kind="stable")[:MOST_CELLS // 2]
            keep.update((at[top[chi2[top] >= LEAST_CHI2]] + shift).tolist())
    return np.array(sorted(keep), np.int64)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ordinal:
    """Fit on the ``fit_rows`` labelled documents with the least hash of their id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    order = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    sample = write_table(graded.orderBy(order, "doc_id").limit(fit_rows).select(F.col("doc_id").alias("_id"), "grade"), "graded")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "grade", "text")
    got = map_texts(texts, _examples, "doc_id long, grade int, n_words long, cells binary, counts binary, shape binary").toArrow()
    got = got.combine_chunks().sort_by("doc_id")       # the order of rows does not depend on the tasks that made them
    grade = np.asarray(got.column("grade")).astype(np.int64)
    present = np.unique(grade)
    if len(present) < 2:
        model = Ordinal()
        if len(present):
            model.thresholds = np.where(present[0] >= np.arange(1, GRADES), -30.0, 30.0)
        return model
    n_words = np.asarray(got.column("n_words")).astype(float)
    raw, offsets = textnp.column_bytes(got.column("cells"))
    cells = raw[offsets[0]:offsets[-1]].view(np.uint32)
    doc = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(offsets) // 4)
    raw, offsets = textnp.column_bytes(got.column("counts"))
    counts = raw[offsets[0]:offsets[-1]].view(np.uint32)
    shape = np.stack([np.frombuffer(b) for b in got.column("shape").to_pylist()])
    model = Ordinal(_chosen_cells(cells, counts, doc, n_words, grade))
    some = np.zeros(1 << CELL_BITS, bool)
    some[model.cells & ((1 << CELL_BITS) - 1)] = True
    some = some[cells]
    at, counts, doc = model.lookup(cells[some].astype(np.int64), counts[some].astype(float), doc[some].astype(np.int64))
    rows, cols, vals = model.rows(at, counts, doc, n_words, shape)
    return model.fit(rows, cols, vals, grade)


def _scored(model: Ordinal, keep_from: float, only_kept: bool):
    def run(batches):
        known = np.zeros(1 << CELL_BITS, bool)
        known[model.cells & ((1 << CELL_BITS) - 1)] = True
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column("text"))
            expected, keep = [], []
            for lo, hi in textnp.pieces(offsets):
                cells, doc, n_words, shape = features(data, offsets[lo:hi + 1])
                hit = known[cells]
                code, count = np.unique((doc[hit] << CELL_BITS) | cells[hit], return_counts=True)
                at, count, of = model.lookup(code & ((1 << CELL_BITS) - 1), count, code >> CELL_BITS)
                rows, cols, vals = model.rows(at, count, of, n_words.astype(float), shape)
                p = model.tails(model.score(rows, cols, vals, hi - lo))
                expected.append(p.sum(axis=1))
                keep.append(p[:, 1])
            p2 = np.concatenate(keep) if keep else np.empty(0)
            kept = p2 >= keep_from if np.any(model.weights) else np.ones(len(p2), bool)
            if only_kept:
                yield batch.filter(pa.array(kept))
                continue
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(expected) if expected else p2), pa.array(p2), pa.array(kept)],
                                  names=["doc_id", "expected_grade", "p_good", "kept"])
    return run


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, expected_grade, p_good (P(grade >= 2)) and kept of every document row."""
    model = train(docs, labels, fit_rows)
    return map_texts(docs.select("doc_id", "text"), _scored(model, keep_from, False), "doc_id long, expected_grade double, p_good double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return map_texts(docs, _scored(train(docs, labels, fit_rows), keep_from, True), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
