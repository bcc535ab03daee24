"""Plain reference versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i:i + 5]) for i in range(len(words) - 4)])


def components(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[j:j + size]), set()).add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                got = windows.get(tuple(w[j:j + size]))
                if got:
                    found |= got
                    hit.update(range(j, j + size))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def text_counts(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
    covered = {x for j in range(len(w) - 2) if g[tuple(w[j:j + 3])] > 1 for x in (j, j + 1, j + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))
