"""Secret scans: a random forest that separates secrets from false positives.

Candidates are runs of at least ``LEAST_LENGTH`` letters, digits and ``+ / _ -`` in a text, with the ``=`` that pad their
end, and values of any length and characters that are assigned to a secret's name, in quotes or up to white space or
a separator, passwords of URLs (``scheme://user:password@host``) and PEM blocks of private keys, each one candidate.  What begins inside a
value without white space or a PEM block is part of it, so that candidates together are no longer than a few times their text.  Each candidate is described by its length, shares of character kinds, changes of kind, entropy, the part of its letters that words of
the dictionary cover, by its document's path, and by the words before it.  The dictionary is the corpus's
own: the most frequent words of 4 to 12 letters, counted over all texts.  The forest (Spark ML) is trained from
labelled findings (doc_id, first_char, label) on at most about ``FIT_ROWS`` of them; of half of these the neighbourhood is
hidden, so that the forest also learns from the characters alone.  Every candidate gets its probability.

The tables hold no labelled findings.  The query labels those whose neighbourhood leaves no doubt: a value in quotes assigned
to a secret's name is one if it has no white space, as are a URL's password and a PEM block; a candidate without digits, or of digits alone, that is assigned to nothing
and holds no secret's name is none.

Edge cases: null and empty texts have no candidates; equal candidates are separate findings; a null path has
no path words; without findings of both labels every candidate with a secret's name before it counts as a
secret, with probability 1 or 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codedelta.llm import textnp
from codedelta.llm.common import map_arrow, read_table, write_table

LEAST_LENGTH = 16
FIT_ROWS = 20000
TREES = 20
DEPTH = 6
DICTIONARY_WORDS = 50000
WORD_SIZES = range(4, 13)
#: Distinct words whose counts a task holds before it reports them.
HELD_WORDS = 1 << 20
BEFORE = 64
SECRET_FROM = 0.5
CHARACTER_FEATURES = ["length", "digits", "uppers", "lowers", "others", "changes", "entropy", "hex", "vowels", "longest_letters", "dictionary"]
CONTEXT_FEATURES = ["named", "assigned", "quoted", "sample_word", "word_before", "path_test", "path_config"]
_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])(?:[A-Za-z0-9+/_\-]{%d,}(?:=+(?![A-Za-z0-9+/=_\-]))?|[A-Za-z0-9+/_\-]+=+(?![A-Za-z0-9+/=_\-]))" % LEAST_LENGTH)
_NAMES = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
_NAME = re.compile(r"(?i)" + _NAMES + r"[\w.\-]*\W{0,6}$")
_HOLDS_NAME = re.compile(r"(?i)" + _NAMES)
_ASSIGNMENT = re.compile(r"(?:=>|:=|={1,3}|:(?!:|//))[^\S\n]*(?:(?i:bearer|basic)[^\S\n]+)?")
#: In quotes, or bare up to white space, a separator or the next parameter of a URL; a quote may stay open.
_VALUE = re.compile(r"""\"((?:[^"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`|["'`]?((?:[^\s"'`,;()\[\]{}<>&]|&(?![\w.\-]+=))+)""")
_URL_PASSWORD = re.compile(r"""://[^\s/?#@:"'<>]*:([^\s/?#@"'<>]+)@""")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s\\:,.()]|-(?!----))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_ASSIGNED = re.compile(r"(?:=|:|=>)\s*[\"'`]?$")
_SAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|xxxx|test")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"[^\W\d_]{2,}\W*$")
_TEST_PATH = re.compile(r"(?i)test|spec|fixture|example|sample|mock|docs?/")
_CONFIG_PATH = re.compile(r"(?i)\.env|config|settings|secret|credential|\.(?:ya?ml|ini|toml|properties|pem|key)$")
_FINDING = "doc_id long, first_char long, end_char long, digest string, {}, marked boolean, plain boolean"


def _schema() -> str:
    return _FINDING.format(", ".join(f"{n} double" for n in CHARACTER_FEATURES + CONTEXT_FEATURES))


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = True
    return t


def _word_counts(batches):
    """Letter runs of a task's texts with their counts, by hash; a run may come in several rows."""
    held: list = []
    counts = np.empty(0, np.int64)
    words = np.empty(0, np.uint64)

    def merged():
        keys, inverse = np.unique(np.concatenate([words, *[h[0] for h in held]]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([counts, *[h[1] for h in held]]), len(keys)).astype(np.int64)

    def rows():
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        data, offsets = textnp.column_bytes(batch.column("text"))
        for lo, hi in textnp.pieces(offsets):
            part, starts, ends, _ = textnp.word_spans(data, offsets[lo:hi + 1], _letters())
            size = ends - starts
            fit = (size >= WORD_SIZES.start) & (size < WORD_SIZES.stop)
            held.append(np.unique(textnp.span_hashes(part, starts[fit], ends[fit]), return_counts=True))
            if len(held) == 16:
                words, counts = merged()
                held = []
                if len(words) > HELD_WORDS:
                    yield rows()
                    words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    if held:
        words, counts = merged()
    yield rows()


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> np.ndarray:
    """Sorted hashes of the ``size`` most frequent words of all texts."""
    counts = map_arrow(docs.select("text"), _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    return np.sort(np.asarray(top.column("word").combine_chunks()).view(np.uint64))


def character_features(s: str) -> list[float]:
    n = len(s)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
    count = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    _, freq = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)
    p = freq / freq.sum()
    longest = max((len(r) for r in re.findall(r"[A-Za-z]+", s)), default=0)
    letters = sum(c.isalpha() for c in s)
    vowels = sum(c in "aeiouAEIOU" for c in s) / max(1, letters)
    hexed = all(c in "0123456789abcdefABCDEF" for c in s)
    return [float(n), *count, changes, float(-(p * np.log2(p)).sum()), float(hexed), vowels, float(longest)]


def _tail(before: str) -> str:
    return before[-BEFORE:].rsplit("\n", 1)[-1]


def _named(tail: str) -> bool:
    return bool(_NAME.search(tail.rstrip("\"'` ").rstrip("=:> ")))


def _certain(text: str) -> list[tuple[int, int]]:
    """(first, end) of the PEM blocks and passwords of URLs of a text, in order."""
    found = [m.span() for m in _PEM.finditer(text)] if "-----BEGIN " in text else []
    if "://" in text:
        found += [m.span(1) for m in _URL_PASSWORD.finditer(text)]
    return sorted(found)


def candidates(text: str, certain: list | None = None) -> list[tuple[int, int]]:
    """(first, end) of the candidates of a text, one for each first; ``certain``: those of ``_certain``, if at hand."""
    certain = _certain(text) if certain is None else certain
    found = dict(certain)
    solid = list(certain)
    at = far = 0
    for m in _ASSIGNMENT.finditer(text):
        while at < len(certain) and certain[at][0] < m.end():
            far = max(far, certain[at][1])
            at += 1
        if m.end() < far or not _named(_tail(text[max(0, m.end() - BEFORE):m.end()])):
            continue
        v = _VALUE.match(text, m.end())
        if v is None:
            continue
        a, b = v.span(v.lastindex)
        if v.lastindex == 4:       # the end of a sentence is none of the value
            b = a + len(text[a:b].rstrip(".:"))
        if a < b and a >= far:
            found[a] = max(found.get(a, 0), b)
            if not _SPACE.search(text, a, b):
                solid.append((a, b))
                far = max(far, b)
    solid.sort()
    at = far = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(solid) and solid[at][0] <= a:
            far = max(far, solid[at][1])
            at += 1
        if b - a >= LEAST_LENGTH and b > far:
            found[a] = max(found.get(a, 0), b)
    return sorted(found.items())


def context_features(before: str, after: str, path: str | None) -> list[float]:
    tail = _tail(before)
    assigned = bool(_ASSIGNED.search(tail))
    quoted = tail[-1:] in ("\"", "'", "`") and after[:1] == tail[-1:]
    path = path or ""
    return [float(_named(tail)), float(assigned), float(quoted), float(bool(_SAMPLE.search(tail))), float(bool(_WORD.search(tail))),
            float(bool(_TEST_PATH.search(path))), float(bool(_CONFIG_PATH.search(path)))]


def _coverage(texts: list[str], words: np.ndarray) -> np.ndarray:
    """Part of the letters of each text that lie in a word of the dictionary."""
    if not texts:
        return np.empty(0)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    hashes = textnp.SpanHashes(data)
    letters = _letters()[data]
    runs = np.concatenate([[0], np.cumsum(letters)])
    edge = np.zeros(len(data) + 1, np.int64)
    if len(words):
        for size in WORD_SIZES:
            if size > len(data):
                break
            at = np.flatnonzero(runs[size:] - runs[:-size] == size)
            h = hashes.of(at, at + size)
            hit = at[words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + size, -1)
    covered = (np.cumsum(edge[:-1]) > 0) & letters
    sizes = np.array([len(t) for t in raw])
    ends = np.cumsum(sizes) + np.arange(len(raw))
    starts = ends - sizes
    total = np.concatenate([[0], np.cumsum(covered)])
    return (total[ends] - total[starts]) / np.maximum(runs[ends] - runs[starts], 1)


def _findings(words: np.ndarray):
    import hashlib
    names = [x.split()[0] for x in _schema().split(", ")]

    def run(batches):
        for batch in batches:
            rows: list = []
            texts: list = []

            def made():
                for r, c in zip(rows, _coverage(texts, words).tolist()):
                    r.insert(4 + len(CHARACTER_FEATURES) - 1, c)
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.float64()] * (len(CHARACTER_FEATURES) + len(CONTEXT_FEATURES)) + [pa.bool_()] * 2
                return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

            for doc_id, text, path in zip(batch.column("doc_id"), batch.column("text"), batch.column("path")):
                text = text.as_py()
                if not text:
                    continue
                path = path.as_py()
                sure = _certain(text)
                firsts = {a for a, _ in sure}
                for a, b in candidates(text, sure):
                    s = text[a:b]
                    chars = character_features(s)
                    near = context_features(text[max(0, a - BEFORE):a], text[b:b + 1], path)
                    marked = a in firsts or (near[0] == 1 and near[1] == 1 and near[2] == 1 and not near[3] and not _SPACE.search(s))
                    plain = a not in firsts and not near[0] and not near[1] and (chars[1] == 0 or chars[1] == 1) and not _HOLDS_NAME.search(s)
                    rows.append([doc_id.as_py(), a, b, hashlib.sha256(s.encode()).hexdigest(), *chars, *near, marked, plain])
                    texts.append(s)
                if len(rows) >= 8192:
                    yield made()
                    rows, texts = [], []
            if rows:
                yield made()
    return run


def findings(docs: DataFrame, words: np.ndarray, path_column: str | None = "source") -> DataFrame:
    """All candidates of all texts with their features; marked and plain: what the neighbourhood alone tells."""
    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    return map_arrow(docs.select("doc_id", "text", path.alias("path")), _findings(words), _schema())


def score(found: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, secret_from: float = SECRET_FROM) -> DataFrame:
    """Adds p_secret and is_secret.  ``labelled``: (doc_id, first_char, label 0 / 1)."""
    names = CHARACTER_FEATURES + CONTEXT_FEATURES
    lab = labelled.select(F.col("doc_id").alias("_id"), F.col("first_char").alias("_at"), F.col("label").cast("int").alias("label")).dropDuplicates(["_id", "_at"])
    rows = found.join(lab, (F.col("doc_id") == F.col("_id")) & (F.col("first_char") == F.col("_at"))).select("doc_id", "first_char", "label", *names)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}    # two rows
    if not (n.get(0) and n.get(1)):
        sure = (F.col("named") == 1) & (F.col("assigned") == 1)
        return found.withColumn("p_secret", sure.cast("double")).withColumn("is_secret", sure)
    part = lambda k: int(min(1.0, fit_rows / 2 / n[k]) * (1 << 20))
    draw = F.pmod(F.xxhash64("doc_id", "first_char", F.lit("fit")), F.lit(1 << 20))
    hide = F.pmod(F.xxhash64("doc_id", "first_char", F.lit("hide")), F.lit(2)) == 0
    sample = rows.filter(draw < F.when(F.col("label") == 1, part(1)).otherwise(part(0)))
    sample = sample.select("doc_id", "first_char", "label", *CHARACTER_FEATURES, *[F.when(hide, 0.0).otherwise(F.col(c)).alias(c) for c in CONTEXT_FEATURES])
    sample = write_table(sample.repartitionByRange(4, "doc_id", "first_char").sortWithinPartitions("doc_id", "first_char"), "labelled")
    vector = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=2)
    model = forest.fit(vector.transform(sample))
    scored = model.transform(vector.transform(found))
    return scored.select(*found.columns, vector_to_array("probability")[1].alias("p_secret")).withColumn("is_secret", F.col("p_secret") >= secret_from)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path_column: str | None = "source") -> DataFrame:
    """Every candidate with its place, digest, features and verdict; the candidate itself is not returned."""
    found = write_table(findings(docs, dictionary(docs), path_column), "findings")
    if labelled is None:
        labelled = found.filter(F.col("marked") | F.col("plain")).select("doc_id", "first_char", F.col("marked").cast("int").alias("label"))
    return score(found, labelled)


def query(spark, sf_dir: str) -> DataFrame:
    s = scan(read_table(spark, sf_dir, "documents"))
    return s.select("doc_id", "first_char", "end_char", "digest", "p_secret", "is_secret")
