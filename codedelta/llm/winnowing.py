"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words; each word is hashed.  Of every seven
consecutive 4-grams of a text the smallest 4-gram hash is kept as a fingerprint, together with
the six words on either side.  A window is ten words, that is seven 4-grams: two equal windows
hold the same minimum, so every shared window is found through at least one shared fingerprint
(and every shared span of ten words or more through its windows).  Fingerprints of documents
and items are joined; each hit is extended over the kept neighbours to the windows that are
equal word by word.  Items of fewer than ten words are one window of their own length; all
spans of just those lengths are then compared as well.

Only fingerprint hashes of the items are offered for broadcast, through a table whose size
Catalyst reads and compares with its threshold; larger ones take a sort-merge join.

Edge cases: a null text or item has no words; an item without words is never found; repeated
document rows get equal results; items that share an id are taken as one item; items with a null id
count towards n_hit, windows and contaminated, and have no place in item_ids and n_items; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.llm.common import ascii_lower, fresh_name, let, non_empty, read_table, write_table

K = 4
WINDOW = 10
GRAMS = WINDOW - K + 1
#: Everything in ASCII but 0-9 and a-z separates words (A-Z is lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """array<long>: hashes of the words of a text, in order; empty for null."""
    words = non_empty(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS))
    return F.transform(words, lambda w: F.xxhash64(w))


def _range(first: Column, last: Column) -> Column:
    """first..last, empty where last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(hs: Column, k: int = K) -> Column:
    """Hash of the k-gram at each index (k a power of two); the last k - 1 values are of no use."""
    def joined(h: Column, shift: int) -> Column:
        return F.zip_with(h, F.slice(h, shift + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y))
    if k == 1:
        return hs
    return let(gram_hashes(hs, k // 2), lambda h: joined(h, k // 2))


def winnowed(texts: DataFrame, window: int = WINDOW, k: int = K, marker: bool = False) -> DataFrame:
    """Fingerprints of texts that have their word hashes in ``hs``: the other columns and
    n (words), span (= window), fp, at (first word of the gram), start, around (the word hashes from
    ``start`` on that windows over the gram can hold).  ``marker`` adds one row of span 0 for each text.

    Windows are exploded in generated code; a window gives a row only where its leftmost
    minimum is not that of the window before."""
    keep = [c for c in texts.columns if c != "hs"]
    grams = window - k + 1
    t = texts.select(*keep, "hs", gram_hashes(F.col("hs"), k).alias("g"))
    n = F.size("hs")
    e = t.select(*keep, "hs", "g", F.explode(F.concat(
        F.array(F.lit(-1)) if marker else F.array().cast("array<int>"), _range(F.lit(0), n - window))).alias("j"))
    j = F.col("j")
    here = F.slice("g", F.greatest(j, F.lit(0)) + 1, grams)
    before = F.slice("g", F.greatest(j, F.lit(1)), grams)
    low = F.array_min(here)
    moved = (j <= 0) | (low != F.array_min(before)) | (low == F.get("g", j - 1))
    at = F.greatest(j, F.lit(0)) + F.array_position(here, low).cast("int") - 1
    e = e.filter(moved).select(*keep, n.alias("n"), F.when(j < 0, 0).otherwise(window).alias("span"), low.alias("fp"), at.alias("at"), "hs")
    start = F.greatest(F.col("at") - (window - k), F.lit(0))
    return e.select(*keep, "n", "span", "fp", "at", start.alias("start"),
                    F.slice("hs", start + 1, F.greatest(F.col("at") + window - start, F.lit(0))).alias("around"))


def all_spans(texts: DataFrame, lengths) -> DataFrame:
    """A row in the form of ``winnowed`` for every run of words of each of the lengths."""
    keep = [c for c in texts.columns if c != "hs"]
    n = F.size("hs")
    e = texts.select(*keep, "hs", F.explode(F.array(*[F.lit(int(x)) for x in lengths])).alias("span"))
    e = e.select(*keep, "hs", "span", F.explode(_range(F.lit(0), n - F.col("span"))).alias("at"))
    part = F.slice("hs", F.col("at") + 1, F.col("span"))
    return e.select(*keep, n.alias("n"), "span", F.xxhash64(part).alias("fp"), "at", F.col("at").alias("start"), part.alias("around"))


def item_fingerprints(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(span, fp, item_id, i_at, i_start, i_around): of long items the winnowed ones, of a short item itself."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("hs"))
    n = F.size("hs")
    long = winnowed(items.filter(n >= window), window, k)
    short = items.filter((n > 0) & (n < window)).select(
        "item_id", n.alias("n"), n.alias("span"), F.xxhash64("hs").alias("fp"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.col("hs").alias("around"))
    both = long.unionByName(short)
    return both.select("span", "fp", "item_id", F.col("at").alias("i_at"), F.col("start").alias("i_start"), F.col("around").alias("i_around"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, row_key, n, span, item_id, first): a row for each shared window, found through any
    fingerprint, and for each document row one of span 0 without item."""
    items = write_table(item_fingerprints(benchmark, window, k), "item_prints")
    # At most window - 1 values.
    short = sorted(r[0] for r in items.filter(F.col("span") < window).select("span").distinct().collect())
    keys = write_table(items.select(F.col("span").alias("k_span"), F.col("fp").alias("k_fp")).distinct(), "item_keys")
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), word_hashes(F.col("text")).alias("hs"))
    d = winnowed(texts, window, k, marker=True)
    if short:
        d = d.unionByName(all_spans(texts, short))
    seen = (d.join(keys, (F.col("span") == F.col("k_span")) & (F.col("fp") == F.col("k_fp")), "left")
            .filter((F.col("span") == 0) | F.col("k_fp").isNotNull())
            .select("doc_id", "row_key", "n", "span", "fp", "at", "start", "around"))
    hits = seen.join(items, ["span", "fp"], "left")
    lead = F.when(F.col("span") == window, F.lit(window - k)).otherwise(F.lit(0))

    def equal_at(o: Column) -> Column:
        mine = F.slice("around", F.greatest(F.col("at") - o - F.col("start") + 1, F.lit(1)), F.col("span"))
        item = F.slice("i_around", F.greatest(F.col("i_at") - o - F.col("i_start") + 1, F.lit(1)), F.col("span"))
        return ((F.col("at") - o >= F.col("start")) & (F.col("i_at") - o >= F.col("i_start"))
                & (F.size(mine) == F.col("span")) & (mine == item))

    firsts = F.when(F.col("i_at").isNotNull(), F.transform(
        F.filter(F.sequence(F.lit(0), lead), equal_at), lambda o: F.col("at") - o))
    return (hits.select("doc_id", "row_key", "n", "span", "item_id", F.explode_outer(firsts).alias("first"))
            .filter((F.col("span") == 0) | F.col("first").isNotNull()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document row: doc_id, row_key (hash of id and text), n_words, n_hit, n_items, item_ids (sorted strings), windows
    ([first, end) word ranges in order), contaminated."""
    m = matches(docs, benchmark, window, k)
    span = F.when(F.col("first").isNotNull(), F.struct("first", (F.col("first") + F.col("span")).alias("end")))
    # At most one span per word and length, one id per item: bounded by the document and the benchmark.
    per = m.groupBy("row_key", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"), F.count_if(F.col("span") == 0).alias("rows"),
        F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.col("item_id").cast("string")))).alias("item_ids"),
        F.sort_array(F.collect_set(span)).alias("found"))
    hit = F.aggregate("found", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["end"] - F.greatest(acc["to"], x["first"]), F.lit(0))).alias("n"),
        F.greatest(acc["to"], x["end"]).alias("to")))["n"]
    per = per.withColumn("n_hit", hit.cast("long"))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return per.select("doc_id", "row_key", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                      F.col("found").alias("windows"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns.  Each row is judged by its own text, also
    where rows share an id or have none."""
    own, key = fresh_name(docs, "_own"), fresh_name(docs, "_key")
    bad = write_table(contamination(docs, benchmark, window, k).filter("contaminated")
                      .select(F.col("doc_id").alias(own), F.col("row_key").alias(key)).distinct(), "contaminated")
    here = F.xxhash64("doc_id", "text")
    return docs.join(bad, (here == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    c = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
