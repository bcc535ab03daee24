"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codedelta.llm import ranked_search as R

TERM = re.compile(R.TERM)
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def _brute(docs, items, top=R.TOP):
    terms = [(i, Counter(t.translate(LOWER) for t in TERM.findall(x or ""))) for i, x in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n_docs, total = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    asked = {}
    for i, x in items:
        asked.setdefault(i, Counter()).update(t.translate(LOWER) for t in TERM.findall(x or ""))
    out = []
    for item, q in asked.items():
        scores = []
        for i, c, n in terms:
            m = 75 + 25 * n * n_docs // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, e[3], -e[0]) for k, e in enumerate(sorted(scores)[:top])]
    return out


@pytest.fixture(scope="module")
def corpus(texts):
    rng = random.Random(4)
    rows = list(texts) + [(None, "lo lo lo"), (None, "w1 w2"), (404, "the quick brown fox"), (500, "ÀB àb ÉÉ"), (501, "a_b A-B")]
    rows += [(1000 + k, " ".join(f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.choice([5, 5, 5, 60])))) for k in range(400)]
    rows += [(2000 + k, "same words here") for k in range(30)]
    items = [(1, "t1 t2 t2 t39 t7"), (2, "same words"), (3, None), (4, "..."), (5, "nowhere"), (6, "LO à b àb w1 W1"), (7, " ".join(f"w{k}" for k in range(300))),
             (None, "quick"), (None, "t3"), (1, "t1 fox")]
    return rows, items


def _frames(spark, corpus):
    rows, items = corpus
    return (spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, m int, score int").repartition(6),
            spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string"))


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_ranked(spark, corpus):
    docs, items = _frames(spark, corpus)
    assert _sorted(R.ranked(docs, items).collect()) == _sorted(_brute(*corpus))


def test_ranked_in_blocks_and_small_pieces(spark, corpus, monkeypatch):
    docs, items = _frames(spark, corpus)
    monkeypatch.setattr(R, "PIECE_DOCS", 3)
    monkeypatch.setattr(R, "WINDOW_POSTINGS", 50)
    assert _sorted(R.ranked(docs, items, top=4, block_entries=100).collect()) == _sorted(_brute(*corpus, top=4))


def test_empty_tables(spark, corpus):
    docs, items = _frames(spark, corpus)
    assert R.ranked(docs.filter("false"), items).collect() == []
    assert R.ranked(docs, items.filter("false")).collect() == []
    assert R.ranked(docs.filter("doc_id in (0, 1, 2)"), items).collect() == []


def test_slices_cut_no_term():
    data = ("ab cd " * 50 + "x" * 700 + " é" * 40).encode()
    for size in (1, 7, 64, 10**6):
        assert b"".join(R.slices(data, size)) == data
        assert [t for p in R.slices(data, size) for t in R.TERM_BYTES.findall(p)] == R.TERM_BYTES.findall(data)


def test_bounds_leave_pieces_closed():
    """Pieces whose bound is below the k-th best score stay closed, and the result is that of opening all."""
    rng = np.random.default_rng(2)
    weights = np.array([5000, 3000, 100])
    q = R.Queries([1], np.array([0, 3]), np.array([0, 1, 2]), np.array([1, 1, 1]), weights)
    pieces = []
    for x in range(50):
        terms = np.array([0, 1, 2] if x < 2 else [2])
        docs = list(range(100 * x, 100 * x + 40))
        t, c = np.tile(terms, 40), rng.integers(1, 4, 40 * len(terms))
        m, ids, g_term, g_tf, g_len, member = R._piece(80 + x, docs, [len(terms)] * 40, t, c)
        pieces.append(R.Piece(q, m, R.pa.array(ids), g_term, g_tf, g_len, member))
    best = [[]]
    opened = R.visit(q, pieces, best, 20)
    everything = sorted((-int(s), p.docs[i].as_py()) for p in pieces for i, s in enumerate(p.scores(*q.entries(0))))
    assert opened <= 2 and [(e[0], e[2]) for e in best[0]] == everything[:20]
