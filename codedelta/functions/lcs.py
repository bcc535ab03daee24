"""Exact line alignment of two hashed line sequences (a small per-row helper).

``align`` strips the common prefix and suffix, then runs a bit-parallel LCS (each row of the dynamic
programme is one big integer; ``V' = (V + U) | (V - U)`` with ``U = V & match_mask``), so the length is exact in
O(n*m/64) word steps.  The edit script is exact at every size: a part is split at the middle of one
side, where the ends of the two halves' rows tell the best place on the other side, until its rows are few enough
to keep for a traceback (``row_bits``).  Memory is linear in the lines.
"""

from __future__ import annotations

KEEP, DELETE, INSERT = " ", "-", "+"


def _lcs_rows(a, b, store: bool):
    """Bit-parallel LCS over positions of ``a`` while reading ``b``.

    Returns (lcs_length, rows) where rows[j] is V after j symbols of b (or None)."""
    n = len(a)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << n) - 1
    v = full
    rows = [v] if store else None
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
        if store:
            rows.append(v)
    return n - v.bit_count(), rows


def lcs_length(a, b) -> int:
    a, b = list(a) if a is not None else [], list(b) if b is not None else []
    n, m = len(a), len(b)
    p = 0
    while p < n and p < m and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and s < m - p and a[n - 1 - s] == b[m - 1 - s]:
        s += 1
    am, bm = a[p:n - s], b[p:m - s]
    if not am or not bm:
        return p + s
    if len(am) < len(bm):
        am, bm = bm, am  # keep the shorter sequence on the iterated side
    return p + s + _lcs_rows(am, bm, False)[0]


def _traceback(am, bm) -> list[str]:
    """Edit script from the stored rows."""
    n, m = len(am), len(bm)
    _, rows = _lcs_rows(am, bm, True)

    def L(i, j):  # LCS of am[:i], bm[:j]
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    ops = []
    i, j = n, m
    while i > 0 and j > 0:
        if am[i - 1] == bm[j - 1] and L(i, j) == L(i - 1, j - 1) + 1:
            ops.append(KEEP)
            i -= 1
            j -= 1
        elif L(i, j - 1) >= L(i - 1, j):
            ops.append(INSERT)  # walking backwards: deletions end up first
            j -= 1
        else:
            ops.append(DELETE)
            i -= 1
    ops.extend([INSERT] * j)
    ops.extend([DELETE] * i)
    ops.reverse()
    return ops


def _prefix_lengths(am, bm) -> list[int]:
    """LCS of am[:i] and bm, for i = 0..len(am)."""
    n = len(am)
    masks: dict = {}
    for i, x in enumerate(am):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << n) - 1
    v = full
    for y in bm:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for i, bit in enumerate(bin(v | (1 << n))[:2:-1]):
        out.append(out[-1] + (bit == "0"))
    return out


def _middle_script(am, bm, row_bits: int) -> list[str]:
    """Minimal edit script of two sequences: list of KEEP / DELETE / INSERT."""
    ops: list[str] = []
    todo = [(am, bm)]
    while todo:
        x, y = todo.pop()
        n, m = len(x), len(y)
        if n == 0 or m == 0:
            ops += [DELETE] * n + [INSERT] * m
        elif n * m <= row_bits or m == 1:
            ops += _traceback(x, y)
        else:
            half = m // 2
            head = _prefix_lengths(x, y[:half])
            tail = _prefix_lengths(x[::-1], y[half:][::-1])
            cut = max(range(n + 1), key=lambda i: head[i] + tail[n - i])
            todo += [(x[cut:], y[half:]), (x[:cut], y[:half])]
    return ops


def align(a, b, context: int = 4, row_bits: int = 1 << 24):
    """Return (lcs, marks, a_idx, b_idx) for the unified patch rows.

    ``marks`` is a string with one of ' ', '-', '+' per patch row; ``a_idx`` /
    ``b_idx`` are the lines of each side before the row, that is the row's 0-based line number where it has one.
    Patch rows are changed lines plus up to ``context`` unchanged lines on each
    side of a change (groups closer than 2*context merge, as in a unified diff).
    """
    a = list(a) if a is not None else []
    b = list(b) if b is not None else []
    n, m = len(a), len(b)
    p = 0
    while p < n and p < m and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and s < m - p and a[n - 1 - s] == b[m - 1 - s]:
        s += 1
    mid = _middle_script(a[p:n - s], b[p:m - s], row_bits)
    lcs = p + s + mid.count(KEEP)
    # Changed positions are all inside the middle; context reaches into the
    # prefix and suffix, so only walk the neighbourhood of the middle.
    lo = max(0, p - context)
    ops = [KEEP] * (p - lo) + mid + [KEEP] * min(s, context)
    ia, ib = lo, lo
    seq = []
    for op in ops:
        if op == KEEP:
            seq.append((op, ia, ib))
            ia += 1
            ib += 1
        elif op == DELETE:
            seq.append((op, ia, ib))
            ia += 1
        else:
            seq.append((op, ia, ib))
            ib += 1
    changed = [k for k, (op, _, _) in enumerate(seq) if op != KEEP]
    keep = [False] * len(seq)
    for k in changed:
        for t in range(max(0, k - context), min(len(seq), k + context + 1)):
            keep[t] = True
    marks, ai, bi = [], [], []
    for k, (op, x, y) in enumerate(seq):
        if keep[k]:
            marks.append(op)
            ai.append(x)
            bi.append(y)
    return lcs, "".join(marks), ai, bi
