"""Pure-Python helpers: LCS alignment against a brute-force DP."""
import random

from codedelta.functions.lcs import align, lcs_length
from codedelta.rules import KPIS, risk_pattern_rows, text_rules
from codedelta.operators.risk import PATTERN_GUARDS


def dp(a, b):
    n, m = len(a), len(b)
    L = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            L[i + 1][j + 1] = L[i][j] + 1 if a[i] == b[j] else max(L[i][j + 1], L[i + 1][j])
    return L[n][m]


def test_lcs_matches_dp():
    rnd = random.Random(7)
    for _ in range(1500):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        assert lcs_length(a, b) == dp(a, b)
        lcs, marks, ai, bi = align(a, b, context=100)
        assert lcs == dp(a, b)
        if a == b:
            assert marks == ""
            continue
        assert [a[x] for mk, x in zip(marks, ai) if mk != "+"] == a
        assert [b[y] for mk, y in zip(marks, bi) if mk != "-"] == b


def test_align_is_exact_where_rows_are_not_kept():
    """Splitting instead of stored rows gives scripts of the same, minimal length."""
    rnd = random.Random(11)
    for k in range(300):
        n = rnd.randint(0, 60)
        a = [rnd.randint(0, 6) for _ in range(n)]
        b = [rnd.randint(0, 6) for _ in range(rnd.randint(0, 60))]
        lcs, marks, ai, bi = align(a, b, context=1000, row_bits=k % 40)
        assert lcs == dp(a, b)
        if a != b:
            assert [a[x] for mk, x in zip(marks, ai) if mk != "+"] == a
            assert [b[y] for mk, y in zip(marks, bi) if mk != "-"] == b
    assert align([1, 2, 3, 9, 4], [5, 2, 9, 7, 4], row_bits=1)[0] == 3


def test_align_context_and_equal():
    assert align([1, 2, 3], [1, 2, 3])[1] == ""
    lcs, marks, ai, bi = align(list(range(20)), list(range(10)) + [99] + list(range(10, 20)), context=4)
    assert lcs == 20 and marks == "    +    "


def test_rule_tables():
    assert len(text_rules()) == 87
    assert len(risk_pattern_rows()) == 61 == len(PATTERN_GUARDS)
    assert abs(sum(w for *_x, w in KPIS) - 1.0) < 1e-9


def test_guards_are_required_literals():
    import re
    samples = ["password = 'x'", "API_KEY='y'", "eval(x)", "../../etc", "GPLv3", "new Date()",
               "for (var i = 0; i < .length; i++)", "// TODO"]
    for (_p, _c, o, rx, *_r), g in zip(risk_pattern_rows(), PATTERN_GUARDS):
        for s in samples:
            if re.search(rx, s):
                assert g in s.lower(), (rx, g, s)
