"""Operator golden vectors and properties on small DataFrames."""
import random
import re

import pytest
from pyspark.sql import functions as F

from codedelta.functions import matching

from codedelta.operators import classify as C
from codedelta.operators import diff as D
from codedelta.operators import elements as E
from codedelta.operators import kpi as K
from codedelta.operators import report as REP
from codedelta.operators import risk as R
from codedelta.operators import score as S
from codedelta.operators import store as ST
from codedelta.sources.derived import code_pairs


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("lines,nodes,types,score,level", [
    (0, 0, [], 20, 1),
    (1, 1, [], 27, 1),
    (10, 20, [("Testing", 2)], 29, 1),
    (10, 20, [("Layering", 3)], 27, 1),
    (200, 50, [("Service Extraction", 4), ("Cloud Migration", 3), ("Testing", 2)], 51, 2),
    (1000, 500, [("Service Extraction", 4), ("Event-driven", 4), ("Containerization", 4),
                 ("Infrastructure as Code", 4), ("Cloud Migration", 3)], 82, 4),
    (1, 1, [("Event-driven", 4), ("Database Migration", 3)], 23, 1),
])
def test_score_golden(spark, lines, nodes, types, score, level):
    df = spark.createDataFrame([(lines, nodes, types)],
                               "lines long, nodes long, types array<struct<type:string,level:int>>")
    t = F.col("types")
    raw = S.raw_score(F.col("lines"), F.col("nodes"), S.infrastructure_components(t), S.coverage_delta(t),
                      S.complexity_delta(t))
    out = df.select(S.overall_score(raw).alias("s")).select("s", S.level_of(F.col("s")).alias("l")).first()
    assert (out.s, out.l) == (score, level)


def test_kpi_golden(spark):
    raw = {"A": [7, 8, 6, 5, 9, 4, 7], "B": [5, 8, 9, 7, 6, 6, 7], "C": [9, 8, 7, 6, 3, 5, 7]}
    rows = [("g", t, i, f"K{k + 1}", float(v)) for i, (t, vals) in enumerate(raw.items()) for k, v in enumerate(vals)]
    ts = spark.createDataFrame(rows, "group_id string, tool string, tool_idx int, kpi string, score double")
    norm = K.normalize_scores(ts)
    ws = {r.tool: r.score for r in K.weighted_score(spark, norm).collect()}
    assert ws == {"A": 4.5, "B": 8.25, "C": 5.67}
    ranks = K.kpi_rankings(norm).filter("kpi = 'K2'").orderBy("rank").collect()
    assert [r.tool for r in ranks] == ["A", "B", "C"]  # constant KPI: input order
    # partial override map falls back per key
    ov = spark.createDataFrame([("g", "K1", 0.0)], "group_id string, kpi string, weight double")
    # A: K1 normalised 0.5 at weight 0.1 contributed 0.5; weight 0 removes it, other keys keep defaults
    assert {r.tool: r.score for r in K.weighted_score(spark, norm, ov).collect()}["A"] == 4.0


def test_fold_and_similarity(spark):
    df = spark.createDataFrame([([0.5, 1.0, 0.8],)], "c array<double>")
    assert df.select(C.fold_mean(F.col("c"))).first()[0] == pytest.approx(0.775)
    assert matching.match([("f", "getUser", [])], [("f", "getUsers", [])], {}, 0.7) == [(0, 0, matching.FUZZY)]
    assert matching.match([("f", "foo", [])], [("f", "bar", [])], {}, 0.7) == []
    assert matching.overlap_ratio(["a", "a", "b"], ["a", "c"]) == pytest.approx(2 / 3)


def _plain_match(left, right, limit=0.7):
    """All pairs, without pruning."""
    out = []
    for i, (k, n, p) in enumerate(left):
        best = None
        for j, (k2, n2, p2) in enumerate(right):
            if not n or not n2:
                continue
            d = list(range(len(n2) + 1))
            for x, c in enumerate(n, 1):
                prev, d[0] = d[0], x
                for y, c2 in enumerate(n2, 1):
                    prev, d[y] = d[y], min(d[y] + 1, d[y - 1] + 1, prev + (c != c2))
            s = 1.0 if n == n2 else (1 - d[-1] / max(len(n), len(n2))) * 0.5 + (1.0 if k == k2 else 0.5) * 0.3 + matching.overlap_ratio(p, p2) * 0.2
            if s > limit and (best is None or s > best[0]):
                best = (s, j)
        if best:
            out.append((i, best[1]))
    return out


def test_matching_equals_all_pairs():
    rnd = random.Random(2)
    for _ in range(300):
        def side():
            return [(rnd.choice("fm"), rnd.choice([None, "", "".join(rnd.choice("abC") for _ in range(rnd.randint(1, 6)))]),
                     [rnd.choice("xyz") for _ in range(rnd.randint(0, 3))]) for _ in range(rnd.randint(0, 8))]
        left, right = side(), side()
        assert [m[:2] for m in matching.match(left, right, {}, 0.7)] == _plain_match(left, right)


def test_matching_is_not_all_pairs():
    left = [("f", f"compute{i}Value", ["int a"]) for i in range(300)]
    right = [("f" if i % 2 else "m", f"compute{(i * 7) % 300}Valu{'e' if i % 4 else 'es'}", ["int a"] if i % 3 else ["b"]) for i in range(300)]
    compared = []
    assert len(matching.match(left, right, {}, 0.7, compared)) == 300 and compared[0] < 300 * 300 / 10


def test_unified_diff_and_patch(spark):
    old, new = "".join(f"l{i}\n" for i in range(40)), "".join(f"l{i}\n" if i not in (3, 30) else "X\n" for i in range(40)) + "end"
    df = spark.createDataFrame([("a", old, new), ("b", old, old)], "pair_id string, legacy string, refactored string")
    texts = {r[0]: r[1] for r in D.with_hunks(D.with_alignment(df)).select("pair_id", D.unified_diff_col()).collect()}
    assert texts["b"] == "" and texts["a"].startswith("--- legacy\n+++ refactored\n@@ -1,8 +1,8 @@\n l0\n l1\n l2\n-l3\n+X\n l4")
    assert texts["a"].count("@@ -") == 3 and texts["a"].endswith("+end\n\\ No newline at end of file\n")


def test_patches_applied_give_the_new_text(spark):
    rnd = random.Random(3)
    rows = [("none", None, "a\n"), ("to_none", "a\nb", None), ("same", "a", "a"), ("end", "a\nb", "a\nb\n"), ("all", "a\n", "b\n")]
    for k in range(150):
        old = [rnd.choice("abcde") + rnd.choice(["\n", "\r\n"]) for _ in range(rnd.randint(0, 60))]
        new = list(old)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(new))
            new[at:at + rnd.randint(0, 3)] = [rnd.choice("abcxy") + "\n" for _ in range(rnd.randint(0, 3))]
        rows.append((f"r{k}", "".join(old), "".join(new) + rnd.choice(["", "tail"])))
    df = spark.createDataFrame(rows, "pair_id string, legacy string, refactored string").repartition(3)
    patch = D.patch_rows(df)
    got = {r.pair_id: (r.text, r.conflict) for r in D.apply_patch(df.select("pair_id", "legacy"), patch).collect()}
    assert got == {i: (new or "", False) for i, _, new in rows}
    other = D.apply_patch(df.select("pair_id", F.lit("z\n").alias("legacy")), patch.filter("pair_id in ('all', 'end')"))
    assert {r.pair_id: (r.text, r.conflict) for r in other.filter("pair_id in ('all', 'end', 'same')").collect()} == {
        "all": (None, True), "end": (None, True), "same": ("z\n", False)}


def test_long_patch_is_linear(spark):
    """Many changed places, each a hunk of its own."""
    old = "".join(f"{i}\n" for i in range(20000))
    new = "".join(f"{i}{'x' if i % 20 == 5 else ''}\n" for i in range(20000))
    df = spark.createDataFrame([("p", old, new)], "pair_id string, legacy string, refactored string")
    got = D.apply_patch(df.select("pair_id", "legacy"), D.patch_rows(df)).first()
    assert got.text == new and not got.conflict


def test_uploads_are_rejected_with_reasons(spark):
    rows = [("ok", f"f{i}.py", 10) for i in range(10)] + [("many", f"f{i}.JAVA", 10) for i in range(11)]
    rows += [("type", "a.py", 1), ("type", "a.exe", 1), ("large", "a.c", 11 * 1024 * 1024), ("large", "b.c", 1)]
    accepted, rejected = ST.accept_uploads(spark.createDataFrame(rows, "request_id string, path string, length long"))
    assert accepted.count() == 10 and {r.request_id for r in accepted.collect()} == {"ok"}
    why = {(r.request_id, tuple(r.reasons)) for r in rejected.collect()}
    assert why == {("many", ("Too many files",)), ("type", (ST.INVALID_TYPE_MESSAGE,)), ("large", ("File too large",))}
    assert accepted.count() + rejected.count() == len(rows)


def test_report_plan_has_no_shuffle(spark, sf):
    df = REP.analyze(spark, code_pairs(spark, sf))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "InMemoryTableScan" not in plan


def test_diff_edges(spark):
    pairs = spark.createDataFrame([
        ("empty", "", ""), ("equal", "a\nb\n", "a\nb\n"), ("final_nl", "a\nb", "a\nb\n"),
        ("crlf", "a\r\nb\r\n", "a\nb\n"), ("null", None, "x\n"), ("moved", "a\nb\nc\n", "c\nb\na\n")],
        "pair_id string, legacy string, refactored string")
    al = {r.pair_id: (r.lines_added, r.lines_removed) for r in D.line_diff_aligned(pairs).collect()}
    ms = {r.pair_id: (r.lines_added, r.lines_removed) for r in D.line_diff_multiset(pairs).collect()}
    assert al["empty"] == (0, 0) and al["equal"] == (0, 0)
    assert al["final_nl"] == (1, 1) and al["crlf"] == (2, 2) and al["null"] == (1, 0)
    assert al["moved"] == (2, 2) and ms["moved"] == (0, 0)
    for k in al:  # multiset is a lower bound of the aligned diff
        assert ms[k][0] <= al[k][0] and ms[k][1] <= al[k][1]


def test_risk_edges(spark):
    texts = [("t3", "new RegExp('a'); new RegExp('b'); new RegExp('c');"),
             ("t4", "new RegExp('a'); new RegExp('b'); new RegExp('c'); new RegExp('d');"),
             ("agpl", "Licensed AGPL-3"),
             ("nbsp", "password = 'x'")]
    df = spark.createDataFrame(texts, "id string, text string")
    perf = {r.id for r in R.scan(df, "text", ["id"], ("performance",)).collect()}
    assert perf == {"t4"}
    lic = R.scan(df.filter("id = 'agpl'"), "text", ["id"], ("license",)).collect()
    assert {r.category for r in lic} == {"gpl", "agpl"}
    # A no-break space is white space to the rules.
    sec = R.scan(df.filter("id = 'nbsp'"), "text", ["id"], ("security",)).collect()
    assert [r.pattern_ord for r in sec] == [1]
    assert not any(re.search(r"\[[^\]]*\\s", r[3]) for r in R.risk_pattern_rows())


def test_dedup_equal_and_unequal_counts(spark):
    df = spark.createDataFrame([("a", "md5(x) sha1(y)"), ("b", "md5(x) md5(z) sha1(y)")], "id string, text string")
    flags = {r.id: r.n for r in R.risk_flags(df, "text", ["id"]).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert flags == {"a": 1, "b": 2}


LAYOUTS = [
    ("javascript", "export default function h(a) {}\nconst f = async function g(q, r = [1, 2]) {\n}\nfunction one(x) {} function two(\n  y,\n  z = (1, 2)\n) {}\n"
                   "import {\n  a,\n  b\n} from 'm';\nexport default function (k) {}",
     [("function_declaration", "h", ["a"], 1), ("function", "g", ["q", "r = [1, 2]"], 2), ("function_declaration", "one", ["x"], 4),
      ("function_declaration", "two", ["y", "z = (1, 2)"], 4), ("import_statement", None, [], 8), ("function_declaration", None, ["k"], 12)]),
    ("java", "import java.util.*;\npublic class A { void a(Map<String, List<Integer>> m, int b) { } int c() throws E,\n F {\n if (x) { } }\n"
             "  public void run()\n  {\n  }\n}\n",
     [("import_declaration", None, [], 1), ("class_declaration", "A", [], 2), ("method_declaration", "a", ["Map<String, List<Integer>> m", "int b"], 2),
      ("method_declaration", "c", [], 2), ("method_declaration", "run", [], 5)]),
    ("python", "from a import (b,\n  c)\nimport os\nclass K:\n    async def f(\n        a,\n        b=(1, 2),\n        **k):\n        pass\n    def g(self): pass\n",
     [("import_from_statement", None, [], 1), ("import_statement", None, [], 3), ("function_definition", "f", ["a", "b=(1, 2)", "**k"], 5),
      ("function_definition", "g", ["self"], 10)]),
    ("c", "#include <stdio.h>\nint main(void)\n{\n  if (a) {\n  }\n}\nstatic char *\nname(int (*f)(int, int),\n     int n) {\n}\n",
     [("preproc_include", None, [], 1), ("function_definition", "main(void)", ["void"], 2),
      ("function_definition", "name(int (*f)(int, int),\n     int n)", ["int (*f)(int, int)", "int n"], 7)]),
]


@pytest.mark.parametrize("language,code,expected", LAYOUTS)
def test_element_layouts(spark, language, code, expected):
    df = spark.createDataFrame([("p", language, "Some prose; it is not code {at} all.\n" * 3 + code, None)], "pair_id string, language string, legacy string, refactored string")
    got = [(r.kind, r.name, r.parameters, r.line - 3) for r in E.elements(df).orderBy("ord").collect()]
    assert got == expected
