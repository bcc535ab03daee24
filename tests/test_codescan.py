"""Elements and bracket trees: golden texts, brute-force trees, linear time on hostile texts."""
import random
import time

import pytest
from pyspark.sql import functions as F

from codedelta.functions import codescan as C
from codedelta.operators import elements as E
from codedelta.operators import mapping as M


def _els(text, language):
    return [(k, line, name, params, text[a:b]) for k, a, b, line, name, params in C.elements(text, language)]


def test_text_ends_at_its_own_brace():
    text = """// function no(a) { }
function a(x, {y, z} = {}, f = (p, q) => p) {
  const s = "}"; /* } */ var t = `}${'{'}`;
  function inner(n) { return { n }; }
}
const tail = 1;
export default async function* b() { }
const c = function (q) { return q; };
import { x,
  y } from 'z'; import w from "w";
var none = "function quoted() { }";
"""
    got = _els(text, "javascript")
    assert [(k, line, n) for k, line, n, _, _ in got] == [
        ("function_declaration", 2, "a"), ("function_declaration", 4, "inner"), ("function_declaration", 7, "b"), ("function", 8, None),
        ("import_statement", 9, None), ("import_statement", 10, None)]
    assert got[0][3] == ["x", "{y, z} = {}", "f = (p, q) => p"] and got[0][4].endswith("}\n}") and "tail" not in got[0][4]
    assert got[1][4] == "function inner(n) { return { n }; }" and got[5][4] == 'import w from "w";'


def test_java_types_and_bodies():
    text = """import static a.b.C.*;
public class A<T> extends B<T> {
    public A(int x) { this.x = x; }
    @Override public <R> Map<String, List<R>> load(final int id, Map<String, R> m)
        throws IOException, SQLException {
        String s = \"\"\"
            } class No { \"\"\"; char c = '}';
        return new Loader(id) { };
    }
    abstract void later(int a);
    static class Inner { void f() { if (x) { } else if (y(1)) { } } }
}
class Open { void g() {
"""
    got = _els(text, "java")
    assert [(k, n) for k, _, n, _, _ in got] == [
        ("import_declaration", None), ("class_declaration", "A"), ("method_declaration", "load"), ("class_declaration", "Inner"),
        ("method_declaration", "f"), ("class_declaration", "Open"), ("method_declaration", "g")]
    assert got[2][3] == ["final int id", "Map<String, R> m"] and got[2][4].endswith("return new Loader(id) { };\n    }")
    assert got[1][4].rstrip().endswith("}\n}") and got[5][4].startswith("class Open") and got[5][4].endswith("{\n")


def test_python_bodies_end_by_indentation():
    text = '''from a import (b,
   c)
def f(x, y=(1, 2), *, z="a,b"):
    """doc
def not_one(): pass
    """
    # comment
  # outdented comment
    t = [
1, 2,
    ]
    def g():
        return 1

    return g
class K:
    async def h(self): return 1
    v = 2
x = 1
'''
    got = _els(text, "python")
    assert [(k, n) for k, _, n, _, _ in got] == [
        ("import_from_statement", None), ("function_definition", "f"), ("function_definition", "g"), ("function_definition", "h")]
    assert got[1][3] == ["x", "y=(1, 2)", "*", 'z="a,b"'] and got[1][4].endswith("return g\n") and got[2][4].strip().endswith("return 1")
    assert got[3][4].strip() == "async def h(self): return 1" and got[0][4] == "from a import (b,\n   c)"


def test_c_declarators():
    text = '#include <a.h>\nstatic int *\nrun(int (*cb)(int, void *), char *s)\n{\n  if (s) { puts("}"); }\n}\nint decl(int x);\nint K::get() const { return 1; }\n'
    got = _els(text, "cpp")
    assert [(n, p) for _, _, n, p, _ in got] == [(None, []), ("run(int (*cb)(int, void *), char *s)", ["int (*cb)(int, void *)", "char *s"]), ("K::get()", [])]
    assert got[1][4].endswith('puts("}"); }\n}')


def _brute_tree(tokens):
    """Nested lists by recursion over (kind, text) tokens, numbered afterwards."""
    def read(i, inside):
        out = []
        while i < len(tokens):
            kind, text = tokens[i]
            if kind == C.PUNCTUATION and text in "([{":
                inner, i = read(i + 1, True)
                out.append([C.GROUP, [[kind, None], *inner]])
                continue
            out.append([kind, None])
            i += 1
            if kind == C.PUNCTUATION and text in ")]}" and inside:
                return out, i
        return out, i
    rows = []

    def number(node, depth, parent):
        at = len(rows)
        rows.append([node[0], at, at, depth, parent])
        for child in node[1] or []:
            number(child, depth + 1, at)
        rows[at][2] = len(rows) - 1
    number([C.ROOT, read(0, False)[0]], 0, None)
    return [tuple(r) for r in rows]


def test_tree_against_recursion():
    rnd = random.Random(4)
    for _ in range(300):
        text = " ".join(rnd.choice(["a", "b1", "12", "(", ")", "[", "]", "{", "}", ";", "'x'", '"', "/*", "*/", "//c\n"]) for _ in range(rnd.randrange(40)))
        s = C.Structure(text, "javascript")
        tokens = [(k, text[a:b]) for k, a, b in C._tokens(text, s)]
        got = C.nodes(text, "javascript")
        assert [n[:5] for n in got] == _brute_tree(tokens)
        assert "".join(text[a:b] for k, _, _, _, _, a, b in got if k not in (C.ROOT, C.GROUP)).split() == "".join(t for _, t in tokens).split()


MB = 1 << 20
HOSTILE = {
    "javascript": ["import " + "a" * MB, "import {\n" * (MB // 9), "function f(" + "a," * (MB // 2) + "){}", "`" * MB, '"\\' * (MB // 2), "/*" * (MB // 2), "f(" * (MB // 2)],
    "java": ["class A\n" * (MB // 8), "int a b, c. " * (MB // 12), "@A(" * (MB // 3), " " * MB, "int f() throws " * (MB // 15), '"""\n' * (MB // 4)],
    "python": ["def f(:\n" * (MB // 8), "def f():\n" * (MB // 9), "from a import (" * (MB // 15), "'''\n" * (MB // 4), "a " * (MB // 2)],
    "c": ["int f(\n" * (MB // 7), "{" * MB, "a<" * (MB // 2), "a* " * (MB // 3), "int f(a) " * (MB // 9)],
}


@pytest.mark.parametrize("language", list(HOSTILE))
def test_hostile_megabytes(language):
    for text in HOSTILE[language]:
        begun = time.process_time()
        C.elements(text, language)
        assert time.process_time() - begun < 10, text[:20]


def test_operators_take_hostile_lines(spark):
    rows = [("a", "javascript", "import " + "x" * 200000, "function f(" + "a," * 50000 + ") {}"), ("b", "java", None, ""), ("c", "cobol", "x(", "y")]
    df = spark.createDataFrame(rows, "pair_id string, language string, legacy string, refactored string").withColumn("map_hints", F.lit(None).cast("map<string,string>"))
    got = {(r.pair_id, r.side): (r.kind, len(r.parameters)) for r in E.elements(df).collect()}
    assert got == {("a", "legacy"): ("import_statement", 0), ("a", "refactored"): ("function_declaration", 50000)}
    assert len(M.element_changes(df).collect()) == 3
    trees = {(r.pair_id, r.side): (r.size, r.n_group) for r in E.subtree_counts(df).filter("depth = 0").collect()}
    assert trees[("b", "legacy")] == (1, 0) and ("c", "legacy") not in trees
    whole = E.node_rows(df).filter("pair_id = 'a' and side = 'refactored'")
    assert whole.filter("kind = 'group'").count() == 2 and whole.filter("parent is null").count() == 1


def test_neighbours_change_is_not_a_change(spark):
    old = "function a() { return 1; }\nlet x = 1;\nfunction b() { return 2; }\n"
    df = spark.createDataFrame([("p", "javascript", old, old.replace("x = 1", "x = 5"))], "pair_id string, language string, legacy string, refactored string")
    ch = M.element_changes(df.withColumn("map_hints", F.lit(None).cast("map<string,string>"))).first()["_ch"]
    assert list(ch["modified"]) == [] and list(ch["added"]) == [] and list(ch["l"]) == [0, 1]
