"""License scans by a positional index of rare words.

Templates are short licence notices, each with mandatory key phrases.  The steps:

1. Document frequencies of all template words are counted over all texts; a word's weight is
   floor(1000 * (1 + ln((N + 1) / (df + 1)))), N the number of rows.
2. The index holds each template's ``RARE`` words of highest weight (ties: by the word) with all their positions.
3. A file's index words are looked up, every occurrence of them.  Postings are intersected by relative position: an
   occurrence at word p of a word that stands at q in a template votes for the template at p - q.  Votes that lie at most
   ``SLACK`` words apart (a word put in or left out) count together: p - q is cut into bins of 2 * SLACK in two grids, one
   moved by half a bin.  Coverage is the weight of the distinct words that voted, over that of all the template's index words.
4. A template whose coverage reaches ``LEAST_COVERAGE`` and whose key phrases all stand in the file gives its label.

Base labels come from fixed phrases whose words stand consecutively.  ``score`` is the best coverage among the
templates that gave a label, at least 0.5 with a base label, else 0.

The texts are read twice (counts, then look-up); positions leave a row only where it holds enough index
words for some template.  The index is as large as the fixed templates, so it is broadcast.

Edge cases: a null, empty or wordless text has 0 words, no labels, score 0 and null places; repeated rows are scanned each
for itself and count each in the frequencies; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.llm.common import ascii_lower, let, non_empty, read_table, write_table

#: Everything in ASCII but 0-9 and a-z separates words (A-Z is lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 8
SLACK = 4
LEAST_COVERAGE = 0.75
BASE_SCORE = 0.5

# FIXED VALUES: phrases and labels of the base.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# FIXED VALUES: public licence notices as (label, notice, key phrases).
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted", "free of charge", "deal in the software"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", ["as is basis", "without warranties or conditions"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license version 2"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation", ["free software", "gnu general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
             "as published by the Free Software Foundation", ["free software", "gnu lesser general public license"]),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
             "Software Foundation", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify", "with or without fee"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]


def template_words(notice: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, notice.lower()) if w]


def words(text: Column) -> Column:
    """array<string>: the lower-cased words of a text; empty for null."""
    return non_empty(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def word_weights(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """{template word: weight} from the document frequencies over all texts; one entry per template word, whatever the corpus."""
    vocabulary = sorted({w for _, notice, _ in templates for w in template_words(notice)})
    # The empty word counts the rows.
    held = docs.select(F.explode(F.concat(_strings([""]), F.array_intersect(words(F.col("text")), _strings(vocabulary)))).alias("word"))
    df = {r["word"]: r["df"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    return {w: math.floor(1000 * (1 + math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)))) for w in vocabulary}


def rare_index(weights: dict[str, int], templates=TEMPLATES) -> list[tuple[int, str, int, int]]:
    """(template, word, position, weight): postings of each template's words of highest weight."""
    out = []
    for t, (_, notice, _) in enumerate(templates):
        ws = template_words(notice)
        rare = sorted(set(ws), key=lambda w: (-weights[w], w))[:RARE]
        out += [(t, w, q, weights[w]) for q, w in enumerate(ws) if w in rare]
    return out


def _literal_table(spark, columns: list[str], rows) -> DataFrame:
    """A small table of literals."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def phrase_starts(ws: Column, n: Column, phrase: str) -> Column:
    """array<int>: indices of a word array at which the words of a phrase stand consecutively."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.get(ws, i + k) == w for k, w in enumerate(parts)])
    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def profiles(docs: DataFrame, index, templates=TEMPLATES) -> DataFrame:
    """One row per document row: row_key, doc_id, n_words, places (starts of base phrases), base (their labels), phrases (key phrases
    found) and at (array<struct<word, p>> of the index words; null where too few stand in the text for any template)."""
    by_template: dict[int, dict[str, int]] = {}
    for t, w, _, weight in index:
        by_template.setdefault(t, {})[w] = weight
    rare = sorted({w for ws in by_template.values() for w in ws})
    keys = sorted({k for _, _, ks in templates for k in ks})

    n, ws = F.col("n"), F.col("ws")
    starts = [phrase_starts(ws, n, p) for p, _ in BASE]
    none = F.array().cast("array<int>")
    suspect = F.col("suspect")
    d = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    d = d.select("doc_id", non_empty(F.split("low", SEPARATORS)).alias("ws"),
                 F.col("low").rlike(f"license|cc{SEPARATORS}by").alias("suspect"))
    d = d.select("doc_id", "ws", "suspect", F.size("ws").alias("n"), F.array_intersect("ws", _strings(rare)).alias("has"))

    # Weight of a template's index words in the file, against what its coverage needs.
    def enough(t):
        own = by_template[t]
        weigh = F.create_map(*[x for w, v in own.items() for x in (F.lit(w), F.lit(v))])
        got = F.aggregate(F.array_intersect("has", _strings(own)), F.lit(0), lambda a, w: a + weigh[w])
        return got >= LEAST_COVERAGE * sum(own.values())
    could = (F.size("has") > 1) & reduce(lambda a, b: a | b, [enough(t) for t in by_template]) if by_template else F.lit(False)
    d = d.select("doc_id", "ws", "n", "has", could.alias("could"),
                 *[F.when(suspect, s).otherwise(none).alias(f"b{k}") for k, s in enumerate(starts)])
    joined = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
    found = let(joined, lambda text: F.array_compact(F.array(*[F.when(text.contains(f" {k} "), F.lit(k)) for k in keys])))
    at = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("word"), i.alias("p"))), lambda x: F.array_contains("has", x["word"]))
    # Ids are fixed by writing the table.
    return write_table(d.select(
        F.monotonically_increasing_id().alias("row_key"), "doc_id", n.cast("long").alias("n_words"),
        F.concat(*[F.col(f"b{k}") for k in range(len(BASE))]).alias("places"),
        F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])).alias("base"),
        F.when(F.col("could"), found).alias("phrases"), F.when(F.col("could"), at).alias("at")), "profiles")


def coverages(profiled: DataFrame, index) -> DataFrame:
    """(row_key, tid, coverage): the best coverage of each template by any relative position, where it reaches LEAST_COVERAGE."""
    spark = profiled.sparkSession
    total: dict[int, int] = {}
    for t, w, weight in {(t, w, weight) for t, w, _, weight in index}:
        total[t] = total.get(t, 0) + weight
    table = _literal_table(spark, ["tid", "word", "q", "weight", "total"], [(t, w, q, weight, total[t]) for t, w, q, weight in index])
    seen = profiled.filter("at is not null").select("row_key", F.inline("at")).join(F.broadcast(table), "word")
    shift = F.col("p") - F.col("q")
    bins = F.array(F.struct(F.lit(0).alias("grid"), F.floor(shift / (2 * SLACK)).alias("bin")),
                   F.struct(F.lit(1).alias("grid"), F.floor((shift + SLACK) / (2 * SLACK)).alias("bin")))
    votes = seen.select("row_key", "tid", "word", "weight", "total", F.inline(bins))
    distinct = votes.groupBy("row_key", "tid", "grid", "bin", "word").agg(F.first("weight").alias("weight"), F.first("total").alias("total"))
    per_bin = distinct.groupBy("row_key", "tid", "grid", "bin").agg((F.sum("weight") / F.first("total")).alias("coverage"))
    return per_bin.filter(F.col("coverage") >= LEAST_COVERAGE).groupBy("row_key", "tid").agg(F.max("coverage").alias("coverage"))


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches
    (array<struct<label, coverage>>, best first per label)."""
    spark = docs.sparkSession
    index = rare_index(word_weights(docs, templates), templates)
    profiled = profiles(docs, index, templates)
    facts = _literal_table(spark, ["f_tid", "label", "keys"], [(t, label, F.array(*[F.lit(k) for k in ks])) for t, (label, _, ks) in enumerate(templates)])
    phrases = profiled.filter("at is not null").select("row_key", "phrases")
    accepted = (coverages(profiled, index).join(F.broadcast(facts), F.col("tid") == F.col("f_tid")).join(phrases, "row_key")
                .filter(F.size(F.array_except("keys", "phrases")) == 0))
    # At most one row per template and file.
    per = (accepted.groupBy("row_key", "label").agg(F.max("coverage").alias("coverage"))
           .groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("label", "coverage"))).alias("matches")))
    d = profiled.drop("at", "phrases").join(per, "row_key", "left")
    found = F.coalesce("matches", F.array().cast("array<struct<label:string,coverage:double>>"))
    any_base = F.size("base") > 0
    return d.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform(found, lambda m: m["label"])))), ",").alias("labels"),
        F.greatest(F.when(any_base, BASE_SCORE).otherwise(0.0), F.coalesce(F.array_max(F.transform(found, lambda m: m["coverage"])), F.lit(0.0))).alias("score"),
        found.alias("matches"))


def query(spark, sf_dir: str) -> DataFrame:
    return licenses(read_table(spark, sf_dir, "documents")).drop("matches")


def oracle_sql(templates=TEMPLATES) -> str:
    """DuckDB SQL for ``query``."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    listed = lambda vs: "[" + ", ".join(map(quote, vs)) + "]"
    posts = ", ".join(f"({t}, {quote(w)}, {q})" for t, (_, notice, _) in enumerate(templates) for q, w in enumerate(template_words(notice)))
    facts = ", ".join(f"({t}, {quote(label)}, {listed(ks)})" for t, (label, _, ks) in enumerate(templates))
    base = ", ".join(f"({quote(label)}, {listed(p.split())})" for p, label in BASE)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH posts AS (SELECT * FROM (VALUES {posts}) v(tid, word, q)),
facts AS (SELECT * FROM (VALUES {facts}) v(tid, label, ks)),
base AS (SELECT * FROM (VALUES {base}) v(label, ws)),
f AS (SELECT row_number() OVER () AS r, doc_id,
        coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '(?:[0-9a-z]|[^\x00-\x7F])+'), []) AS ws FROM documents),
x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM f),
df AS (SELECT word, count(DISTINCT r) AS df FROM x GROUP BY word),
wt AS (SELECT d.tid, d.word, CAST(floor(1000 * (1 + ln(CAST((SELECT count(*) FROM f) + 1 AS DOUBLE) / (coalesce(df.df, 0) + 1)))) AS BIGINT) AS weight
       FROM (SELECT DISTINCT tid, word FROM posts) d LEFT JOIN df USING (word)),
rare AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY weight DESC, word) AS place FROM wt) WHERE place <= {RARE}),
total AS (SELECT tid, sum(weight) AS total FROM rare GROUP BY tid),
votes AS (SELECT DISTINCT r, tid, word, weight, grid, CAST(floor((p - q + grid * {SLACK}) / {2 * SLACK}.0) AS BIGINT) AS bin
          FROM x JOIN posts USING (word) JOIN rare USING (tid, word), (VALUES (0), (1)) g(grid)),
cov AS (SELECT r, tid, max(c) AS coverage FROM (SELECT r, tid, sum(weight) / CAST(any_value(total) AS DOUBLE) AS c
          FROM votes JOIN total USING (tid) GROUP BY r, tid, grid, bin) WHERE c >= {LEAST_COVERAGE} GROUP BY r, tid),
ok AS (SELECT cov.r, facts.label, cov.coverage FROM cov JOIN facts USING (tid) JOIN f USING (r)
       WHERE len(list_filter(ks, lambda k: NOT contains(' ' || array_to_string(f.ws, ' ') || ' ', ' ' || k || ' '))) = 0),
places AS (SELECT x.r, x.p, base.label FROM x JOIN base ON x.word = base.ws[1] JOIN f ON f.r = x.r WHERE f.ws[x.p + 1:x.p + len(base.ws)] = base.ws),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM ok UNION SELECT r, label FROM places) GROUP BY r),
m AS (SELECT r, max(coverage) AS coverage FROM ok GROUP BY r)
SELECT f.doc_id, CAST(len(f.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
       CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       greatest(CASE WHEN b.n_base > 0 THEN CAST({BASE_SCORE} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, coalesce(m.coverage, CAST(0 AS DOUBLE))) AS score
FROM f LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r)
"""


ORACLE = oracle_sql()
