"""Matching of two short lists of code elements and token-count differences (small per-row helpers).

The best match of a legacy element is the refactored element of highest similarity, the earliest in a tie, if it
exceeds a limit.  Equal names score 1 and are found by look-up.  The others are pruned: kind and parameters
give the name similarity that a candidate must still reach, the lengths of the names bound what it can reach, and
only candidates that can beat the best one so far get an edit distance."""

from __future__ import annotations

import numpy as np

NAME_WEIGHT, KIND_WEIGHT, PARAMETER_WEIGHT = 0.5, 0.3, 0.2
OTHER_KIND = 0.5
HINT, NAME, FUZZY = 0, 1, 2


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one big-integer step per character of ``b``."""
    if not a or not b:
        return len(a) or len(b)
    masks: dict = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(d0 | up) & full), up & d0
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = ((plus << 1) | 1) & full
        minus = (minus << 1) & full
        up, down = minus | (~(x | plus | d0) & full), plus & d0
    return score


def overlap_ratio(a, b) -> float:
    """Items of ``a`` found in ``b`` (duplicates kept) over the longer length; both empty 1, one empty 0."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return sum(x in b for x in a) / max(len(a), len(b))


def match(left, right, hints, limit: float, compared: list | None = None):
    """(l_ord, r_ord, source) of the mapped elements, in legacy order.

    ``left`` / ``right``: lists of (kind, name or None, parameters); hints: {legacy name: refactored name}.
    ``compared`` gets the number of edit distances."""
    first: dict = {}
    for j, (_, name, _) in enumerate(right):
        if name:
            first.setdefault(name, j)
    left_first: dict = {}
    for i, (_, name, _) in enumerate(left):
        if name:
            left_first.setdefault(name, i)
    hinted = {left_first[a]: first[b] for a, b in (hints or {}).items() if a in left_first and b in first}
    # Candidates with the same kind and parameters need the same name similarity.
    groups: dict = {}
    for j, (kind, name, params) in enumerate(right):
        if name:
            groups.setdefault((kind, tuple(params)), {}).setdefault(len(name), []).append((j, name))
    out, n = [], 0
    for i, (kind, name, params) in enumerate(left):
        if i in hinted:
            out.append((i, hinted[i], HINT))
            continue
        if not name:
            continue
        if name in first:
            out.append((i, first[name], NAME))
            continue
        best = None        # (similarity, -position)
        rest = sorted(((KIND_WEIGHT * (1.0 if kind == k else OTHER_KIND), PARAMETER_WEIGHT * overlap_ratio(params, p), by_size)
                       for (k, p), by_size in groups.items()), key=lambda g: -(g[0] + g[1]))
        for of_kind, of_params, by_size in rest:
            for size in sorted(by_size, key=lambda s: abs(s - len(name))):
                longest = max(size, len(name))
                reach = (1 - abs(size - len(name)) / longest) * NAME_WEIGHT + of_kind + of_params
                need = max(limit, best[0] if best else 0.0)
                if reach < need - 1e-9:
                    break     # names of other lengths reach even less
                for j, other in by_size[size]:
                    n += 1
                    score = (1 - edit_distance(name, other) / longest) * NAME_WEIGHT + of_kind + of_params
                    if score > limit and (best is None or (score, -j) > best):
                        best = (score, -j)
        if best:
            out.append((i, -best[1], FUZZY))
    if compared is not None:
        compared.append(n)
    return out


def changes(left, right, l_keys, r_keys, hints, limit: float):
    """(l_ord, r_ord, source, added, removed, modified): the mapping; positions of elements neither mapped nor
    equivalent to one on the other side; and indices of mapped pairs that are not equivalent."""
    m = match(left, right, hints, limit)
    mapped_l, mapped_r = {x[0] for x in m}, {x[1] for x in m}
    have_l, have_r = set(l_keys), set(r_keys)
    added = [j for j, k in enumerate(r_keys) if k not in have_l and j not in mapped_r]
    removed = [i for i, k in enumerate(l_keys) if k not in have_r and i not in mapped_l]
    modified = [x for x, (i, j, _) in enumerate(m) if l_keys[i] != r_keys[j]]
    return [x[0] for x in m], [x[1] for x in m], [x[2] for x in m], added, removed, modified


def only_in_second(first: np.ndarray, second: np.ndarray) -> int:
    """Occurrences in ``second`` whose value does not occur in ``first``."""
    return int(np.isin(second, first, invert=True).sum())
