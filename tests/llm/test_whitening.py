"""Whitening against dense arithmetic on Python integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from codedelta.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component int, n int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8) for i, v in rows], SCHEMA).repartition(3)


def _brute(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[k] for _, x in kept) for k in range(d)]
    cov = [[float(Fraction(n * sum(x[i] * x[j] for _, x in kept) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)]
    return kept, n, s, np.array(cov)


def _check(spark, rows, components=32):
    got = W.whiten(_frame(spark, rows), components=components).collect()
    kept, n, s, cov = _brute(rows)
    k = min(components, len(s))
    assert len(got) == len(kept) * k and {r["n"] for r in got} == {n}
    deviation = sorted(sum((n * x - t) ** 2 for x, t in zip(v, s)) for _, v in kept for _ in range(k))
    assert sorted(r["deviation"] for r in got) == deviation
    values = np.linalg.eigvalsh(cov)[::-1]
    for r in got:
        assert abs(r["explained"] - max(values[r["component"] - 1], 0) / cov.trace()) < 1e-9
        assert r["identity_error"] < 1e-4
    return got, kept, n, s, cov, values


def test_whiten(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.1 + 0.02 * k) + (0.3 if i % 3 else 0) for k in range(40)]) for i in range(500)]
    rows += [(500, None), (501, [None] * 40), (502, [float("nan")] + [0.0] * 39), (503, [float("inf")] * 40), (504, [0.1] * 40), (504, [0.1] * 40), (None, [0.2] * 40)]
    got, kept, n, s, cov, values = _check(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["component"], r["whitened"]))
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :32]
    ids = [i for i, _ in kept if i not in (504, None)]
    ours = np.array([[w for _, w in sorted(by[i])] for i in ids])
    want = np.array([[(n * x - t) / n for x, t in zip(v, s)] for i, v in kept if i in set(ids)]) @ axes / np.sqrt(values[:32])
    assert np.abs(ours * np.sign((ours * want).sum(0)) - want).max() < 1e-6


def test_wide_values_and_no_variance(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1e4, 1e4), 0.5, rng.uniform(-1, 1) * 2**-8, float(i)]) for i in range(100)]
    got = _check(spark, rows)[0]
    assert all((r["whitened"] is None) == (r["component"] > 2 and r["explained"] == 0) for r in got)
    flat = W.whiten(_frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in flat)


def test_edges(spark):
    assert W.whiten(_frame(spark, [(1, None), (2, []), (3, [float("nan")])])).collect() == []
    assert W.whiten(_frame(spark, []).filter("false")).collect() == []
    # A sum of squares beyond a long has no value.
    assert all(r["deviation"] is None for r in W.whiten(_frame(spark, [(k, [1e10 * (k % 2)]) for k in range(100)])).collect())
    mixed = W.whiten(_frame(spark, [(1, [0.1, 0.2]), (2, [0.3, 0.1]), (3, [0.1])])).collect()
    assert {r["vec_id"] for r in mixed} == {1, 2}


@pytest.mark.parametrize("d, rows, top", [(3, 64, 5), (5, 130, 300), (2, 1, 9)])
def test_bit_sliced_products(d, rows, top):
    y = np.random.default_rng(d).integers(0, top, (rows, d))
    words, dims, weight = W.planes(y, [int(top - 1).bit_length()] * d)
    got = W.cross_products(W.plane_counts(words), dims, weight, d)
    want = y.T @ y
    assert all(got[i][j] == want[i, j] for i in range(d) for j in range(i, d))
