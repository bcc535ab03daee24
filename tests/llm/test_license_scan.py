"""License scan against brute force."""

import math
from collections import Counter

import brute
import pytest

from codedelta.llm import license_scan as L

NOTICE = dict((n, t) for n, t, _ in reversed(L.TEMPLATES))


def _brute(rows, templates=L.TEMPLATES):
    ws = [brute.ALNUM.findall((t or "").translate(brute.LOWER)) for _, t in rows]
    df = Counter(w for x in ws for w in set(x))
    out = []
    for (doc, _), w in zip(rows, ws):
        places = sorted(i for p, _ in L.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        base = {label for p, label in L.BASE if any(w[i:i + len(p.split())] == p.split() for i in range(len(w)))}
        labels, best = set(base), 0.5 if base else 0.0
        for label, notice, keys in templates:
            t = brute.ALNUM.findall(notice.lower())
            weight = {x: math.floor(1000 * (1 + math.log((len(rows) + 1) / (df[x] + 1)))) for x in t}
            rare = sorted(weight, key=lambda x: (-weight[x], x))[:L.RARE]
            votes = {}
            for p, x in enumerate(w):
                for q, y in enumerate(t):
                    if x == y and x in rare:
                        for grid in (0, L.SLACK):
                            votes.setdefault((grid, (p - q + grid) // (2 * L.SLACK)), set()).add(x)
            got = max((sum(weight[x] for x in v) for v in votes.values()), default=0) / sum(weight[x] for x in rare)
            if got >= L.LEAST_COVERAGE and all(f" {k} " in f" {' '.join(w)} " for k in keys):
                labels.add(label)
                best = max(best, got)
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best))
    return out


@pytest.fixture(scope="module")
def rows(texts):
    mit = NOTICE["mit"]
    bsd = next(t for n, t, _ in L.TEMPLATES if n == "bsd")
    gpl = next(t for n, t, _ in L.TEMPLATES if n == "gpl")
    extra = [
        (900, "code code " + mit), (901, "GNU\nGeneral, Public - LICENSE and gnu general public license version 3"), (902, "licensed under CC BY (cc by-nc 4.0)"),
        (903, bsd.replace("forms, with or", "forms, either with or") + " tail"), (904, bsd.replace("binary forms", "binary shapes")),
        (905, "# " + "\n# ".join(gpl.split(" "))), (906, "licensed under the the the apache apache license license version"), (907, "license " * 3000),
        (908, " ".join(t for _, t, _ in L.TEMPLATES)), (909, "the MIT licensé"), (910, "mit license mit license"), (None, "Released under the MIT License."),
        (911, "Permission granted hereby is, free of charge software deal to any person obtaining copy"), (910, "mit license mit license")]
    return list(texts) + extra


def test_licenses(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, row_key int").repartition(4)
    got = [tuple(r)[:8] for r in L.licenses(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(_brute(rows), key=key)
    by = {r[0]: r[6] for r in got}
    assert by[903] == "bsd" and by[904] == "" and by[905] == "gpl" and by[902] == "cc-by,cc-by-nc-4.0" and by[907] == "" and by[911] == ""


def test_licenses_empty(no_docs):
    assert L.licenses(no_docs).collect() == []


def test_native(spark, docs):
    plan = L.licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
