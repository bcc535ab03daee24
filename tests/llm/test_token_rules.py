"""Re-Pair finds a pair's rule by its cell, also where rules share one."""

import numpy as np

from codedelta.llm import token_store as S


def test_rules_that_share_a_cell_are_all_applied():
    a, b = np.meshgrid(np.arange(3, 2003, dtype=np.uint32), np.arange(3, 2003, dtype=np.uint32))
    a, b = a.ravel(), b.ravel()
    cell = S._cells(a, b)
    order = np.argsort(cell, kind="stable")
    i, j = next((i, j) for i, j in zip(order[:-1], order[1:]) if cell[i] == cell[j] and len({a[i], b[i], a[j], b[j]}) == 4)
    seq = np.array([a[i], b[i], 2, a[j], b[j], 2] * 40, np.uint32)
    symbols, rules = S.repair(seq, 2003)
    assert sorted(map(tuple, rules.tolist())) == sorted([(a[i], b[i]), (a[j], b[j])])
    assert len(symbols) == 160 and (S.expand(symbols.astype(np.int64), rules, 2003)[0] == seq).all()
