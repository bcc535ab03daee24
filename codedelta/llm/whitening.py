"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Each entry c becomes the whole number x = floor(scale * c) + offset.  The steps:

1. One pass gives, per dimension, the least and the greatest x and the exact sum of x.
2. Bit-sliced scatter: a task takes a block of rows, shifts each dimension by its least value and packs each bit plane of each
   dimension across the rows into 64-bit words.  The cross-product of two dimensions is the sum over their planes a, b of
   2^(a + b) times the ones in the AND of the two planes, without any rounding.  Tasks give whole numbers, Spark adds them up.
3. The scatter is centred as whole numbers, n * sum(x_i x_j) - S_i S_j, and only then divided by n^2 and passed to ``eigh``.
4. Every row is centred (n x - S is whole), projected on the components and divided by the root of the eigenvalue.
5. The covariance of the whitened rows is summed up over all rows; its largest distance from the identity is
   ``identity_error``.

What goes to the driver is quadratic in the number of dimensions, whatever the number of rows.

Edge cases: a null vector, and one with a null or non-finite entry, has no rows; so has one of another length than the most
common (ties: the longest), an empty one, and one with an entry beyond 2^46 / scale, since sums of products must fit 38 digits.  A component
without variance (eigenvalue at most dimensions * 2^-52 of the largest) has whitened null and explained 0 and no part in
identity_error; with no component at all identity_error is 0.  Repeated rows and null ids count as rows of their own.
``deviation`` is null where it exceeds a long.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.llm.common import map_arrow, read_table

SCALE = 64
OFFSET = 1000000
COMPONENTS = 32
#: Rows whose planes a task holds at a time; a multiple of 64.
BLOCK_ROWS = 1 << 14
LONGEST = 1 << 63
#: Largest whole number: products of two, added up over 2^30 rows, fit a decimal(38, 0).
LARGEST = 1 << 46


def fit_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """The rows that remain, as (vec_id, v array<double>), and their number of dimensions."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / scale)
    v = v.filter((F.size("v") > 0) & F.forall("v", usable))
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = top["d"] if top else 0
    return v.filter(F.size("v") == d), d


def whole(column: pa.Array, d: int, scale: int, offset: int) -> np.ndarray:
    """(rows, d): x of the vectors of an Arrow column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(scale * flat).astype(np.int64) + offset


def _number_rows(i, j, values) -> pa.RecordBatch:
    """(i, j, value) with whole numbers of any size as decimal strings."""
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in values], pa.string())], names=["i", "j", "value"])


def ranges(rows: DataFrame, d: int, scale: int = SCALE, offset: int = OFFSET):
    """(n, S, least, greatest): number of rows, and per dimension exact sum, least and greatest x, as Python integers."""
    def run(batches):
        n, total = 0, [0] * d
        low, high = np.full(d, 2**62), np.full(d, -2**62)
        for b in batches:
            if b.num_rows:
                x = whole(b.column(0), d, scale, offset)
                n += len(x)
                least = x.min(axis=0)
                # Distances from the least stay small; the rest is added up as Python integers.
                wide = int(x.max()) - int(x.min()) >= 2**40
                rest = (x.astype(object) - least if wide else x - least).sum(axis=0)
                total = [t + int(r) + len(x) * int(s) for t, r, s in zip(total, rest, least)]
                low, high = np.minimum(low, least), np.maximum(high, x.max(axis=0))
        if n:
            k = range(d)
            for kind, values in enumerate((total, low.tolist(), high.tolist())):
                yield _number_rows([kind] * d, k, values)
            yield _number_rows([3], [0], [n])
    part = map_arrow(rows.select("v"), run, "i int, j int, value string")
    number = F.col("value").cast("decimal(38,0)")
    got = {(r["i"], r["j"]): r for r in part.groupBy("i", "j").agg(
        F.sum(number).alias("sum"), F.min(number).alias("min"), F.max(number).alias("max")).collect()}
    return (int(got[3, 0]["sum"]), [int(got[0, k]["sum"]) for k in range(d)], [int(got[1, k]["min"]) for k in range(d)],
            [int(got[2, k]["max"]) for k in range(d)])


def planes(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, weight): the bit planes of each column of the whole numbers ``y`` >= 0, packed across rows into 64-bit words."""
    words, dims, weight = [], [], []
    pad = -len(y) % 64
    for k, n_bits in enumerate(bits):
        column = y[:, k]
        for a in range(n_bits):
            ones = np.packbits(((column >> a) & 1).astype(np.uint8))
            words.append(np.concatenate([ones, np.zeros((len(y) + pad) // 8 - len(ones), np.uint8)]).view(np.uint64))
            dims.append(k)
            weight.append(a)
    return (np.array(words, np.uint64).reshape(len(words), (len(y) + pad) // 64), np.array(dims, np.int64), np.array(weight, np.int64))


def plane_counts(words: np.ndarray) -> np.ndarray:
    """(planes, planes): rows in which both planes have a one; the upper triangle is filled."""
    p = len(words)
    out = np.zeros((p, p), np.int64)
    for a in range(p):
        out[a, a:] = np.bitwise_count(words[a] & words[a:]).sum(axis=1, dtype=np.int64)
    return out


def cross_products(counts: np.ndarray, dims: np.ndarray, weight: np.ndarray, d: int) -> list[list[int]]:
    """sum(y_i y_j) from the counts of planes, as Python integers."""
    counts = np.triu(counts) + np.triu(counts, 1).T
    out = [[0] * d for _ in range(d)]
    # By the sum of the two weights, each of which is a whole matrix of counts: no product overflows.
    for w in np.unique(weight[:, None] + weight[None, :]):
        chosen = np.where(weight[:, None] + weight[None, :] == w, counts, 0)
        by_row = np.zeros((d, len(dims)), np.int64)
        np.add.at(by_row, dims, chosen)
        pair = np.zeros((d, d), np.int64)
        np.add.at(pair.T, dims, by_row.T)
        for i in range(d):
            for j in range(i, d):
                if pair[i, j]:
                    out[i][j] += int(pair[i, j]) << int(w)
    return out


def scatter(rows: DataFrame, d: int, least: list[int], greatest: list[int], scale: int = SCALE, offset: int = OFFSET) -> dict:
    """{(i, j): sum of (x_i - least_i)(x_j - least_j)} for i <= j, exact."""
    bits = [(g - s).bit_length() for s, g in zip(least, greatest)]
    base = np.array(least, np.int64)

    def run(batches):
        total, held, n = None, [], 0

        def add():
            nonlocal total, held, n
            words, dims, weight = planes(np.concatenate(held), bits)
            counts = plane_counts(words)
            total = (counts if total is None else total[0] + counts), dims, weight
            held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(whole(b.column(0), d, scale, offset) - base)
                n += b.num_rows
                if n >= BLOCK_ROWS:
                    add()
        if n:
            add()
        if total is not None:
            products = cross_products(total[0], total[1], total[2], d)
            for i in range(d):
                yield _number_rows([i] * (d - i), range(i, d), products[i][i:])
    part = map_arrow(rows.select("v"), run, "i int, j int, value string")
    summed = part.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in summed.collect()}


class Model:
    """n, S and the components: ``axes`` (d, k) unit eigenvectors by falling eigenvalue, ``eigenvalues`` (k), ``explained`` (k)."""

    def __init__(self, n: int, sums: list[int], products: dict, least: list[int], k: int):
        d = len(sums)
        self.n, self.sums = n, sums
        shifted = [s - n * b for s, b in zip(sums, least)]
        v = np.zeros((d, d))
        for (i, j), p in products.items():
            # Centred as integers; a shift of a dimension has no part in a covariance.
            v[i, j] = v[j, i] = (n * p - shifted[i] * shifted[j]) / (n * n)
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:k]
        trace = float(np.trace(v))
        floor = d * 2.0**-52 * max(float(values.max()), 0.0)
        self.eigenvalues = np.where(values[order] > floor, values[order], 0.0)
        self.axes = axes[:, order]
        self.explained = self.eigenvalues / trace if trace > 0 else np.zeros(len(order))
        self.live = self.eigenvalues > 0
        self.roots = np.sqrt(np.where(self.live, self.eigenvalues, 1.0))

    def centred(self, x: np.ndarray):
        """n x - S, as int64 where that is safe, else as Python integers."""
        safe = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in self.sums) < 2**62
        return self.n * x - np.array(self.sums, np.int64) if safe else self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred) -> np.ndarray:
        return ((centred.astype(np.float64) / self.n) @ self.axes) / self.roots


def deviations(centred: np.ndarray) -> list:
    """Sums of squares, exact; None beyond a long."""
    if centred.dtype != object and max(abs(int(centred.max())), abs(int(centred.min()))) ** 2 * centred.shape[1] < LONGEST:
        return (centred * centred).sum(axis=1).tolist()
    wide = centred.astype(object)
    return [v if v < LONGEST else None for v in map(int, (wide * wide).sum(axis=1))]


def fit(rows: DataFrame, d: int, k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Model:
    n, sums, least, greatest = ranges(rows, d, scale, offset)
    return Model(n, sums, scatter(rows, d, least, greatest, scale, offset), least, k)


def identity_error(rows: DataFrame, d: int, model: Model, scale: int = SCALE, offset: int = OFFSET) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over the components with variance."""
    k = len(model.eigenvalues)

    def run(batches):
        total, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                w = model.whitened(model.centred(whole(b.column(0), d, scale, offset)))
                total += w.T @ w
                sums += w.sum(axis=0)
        full = np.vstack([total, sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()),
                                          pa.array(full.ravel(), pa.float64())], names=["i", "j", "value"])
    summed = map_arrow(rows.select("v"), run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    full = np.zeros((k + 1, k))
    for r in summed.collect():
        full[r["i"], r["j"]] = r["value"]
    mean = full[k] / model.n
    covariance = full[:k] / model.n - np.outer(mean, mean)
    off = np.abs(covariance - np.eye(k))[np.ix_(model.live, model.live)]
    return float(off.max()) if off.size else 0.0


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """One row per remaining vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    id_type = vectors.schema[id_col].dataType
    schema = f"vec_id {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = fit_rows(vectors, id_col, vector_col, scale)
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    model = fit(rows, d, components, scale, offset)
    error = identity_error(rows, d, model, scale, offset)
    k = len(model.eigenvalues)

    def run(batches):
        for b in batches:
            if b.num_rows:
                centred = model.centred(whole(b.column(1), d, scale, offset))
                w = model.whitened(centred)
                size, mask = len(w), np.tile(~model.live, len(w))
                at = np.repeat(np.arange(size), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, model.n), pa.int64()),
                     pa.array(deviations(centred), pa.int64()).take(pa.array(at)), pa.array(w.ravel(), pa.float64(), mask=mask),
                     pa.array(np.tile(model.explained, size), pa.float64()), pa.array(np.full(size * k, error), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return map_arrow(rows.select("vec_id", "v"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
