"""Token counts by offset-mapped attribution.

A whole document is encoded once.  The byte-level vocabulary gives each token's length in bytes, so that the spans of all
tokens follow from running sums; they are turned into character spans and joined with the character intervals of the
document's sections (sorted, disjoint) by binary search.  A token inside one section counts there.  A
token that crosses a boundary goes by an explicit rule:

* ``start``: to the section that has its first character;
* ``largest``: to the section that has most of its characters, the earlier one in a tie;
* ``share``: to each section by its share of the token's characters.

Characters outside all sections belong to the section null.  A character cut by two tokens counts as part of both.

Edge cases: a null or empty text has no tokens and one row per section it states, or a single empty section;
null sections mean the lines of the text, each with its line feed; a section with a null bound, or one that ends before it starts,
has a row with 0 tokens; where sections overlap, the characters belong to the one that starts (then ends) first; repeated document rows are attributed separately; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codedelta.llm import textnp
from codedelta.llm.common import map_arrow, read_table
from codedelta.llm.encoding import encoder, tokenizer_path

RULES = ("start", "largest", "share")
_lengths: dict = {}


def token_bytes(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for: its token has one character per byte."""
    if path not in _lengths:
        vocabulary = encoder(path, "bytes").tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)
        _lengths[path] = out
    return _lengths[path]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str):
    """(counts, crossing): tokens [first, last) of one text by section [starts, ends), and in the last place of
    each those outside all of them.  Crossing: tokens that are not wholly inside one section or outside all."""
    n = len(starts)
    counts, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if not len(first):
        return counts, crossing
    if not n:
        counts[0] = len(first)
        return counts, crossing
    lo = np.searchsorted(ends, first, "right")               # first section that ends after the token's start
    hi = np.searchsorted(starts, last, "left") - 1           # last section that starts before its end
    inside = (lo == hi) & (first >= starts[np.minimum(lo, n - 1)]) & (last <= ends[np.minimum(lo, n - 1)])
    outside = lo > hi
    counts[:n] += np.bincount(lo[inside], minlength=n)
    counts[n] += outside.sum()
    for t in np.flatnonzero(~inside & ~outside):
        a, b = first[t], last[t]
        parts = [(min(b, ends[s]) - max(a, starts[s]), s) for s in range(lo[t], hi[t] + 1)]
        rest = (b - a) - sum(p for p, _ in parts)
        if rest > 0:
            parts.append((rest, n))
        if rule == "start":
            holds = next((s for _, s in parts if s < n and starts[s] <= a < ends[s]), n)
            shares = [(1.0, holds)]
        elif rule == "largest":
            shares = [(1.0, max(parts, key=lambda x: (x[0], -x[1]))[1])]
        else:
            shares = [(p / (b - a), s) for p, s in parts]
        for w, s in shares:
            counts[s] += w
            crossing[s] += 1
    return counts, crossing


def in_order(sections) -> tuple[list, list]:
    """((first_char, end_char, section) in order, those that hold no characters by a null bound or an end before the start)."""
    rows = [(s["first_char"], s["end_char"], s["section"]) for s in sections]
    good = [s for s in rows if s[0] is not None and s[1] is not None and s[0] <= s[1]]
    return sorted(good, key=lambda s: s[:2]), [s for s in rows if s not in good]


def disjoint(sections) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of sections in order; a section begins where the ones before it end."""
    if not sections:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.maximum.accumulate(np.array([s[1] for s in sections], np.int64))
    before = np.concatenate([[ends[0]], ends[:-1]])
    starts = np.array([s[0] for s in sections], np.int64)
    starts[1:] = np.maximum(starts[1:], before[1:])
    return starts, ends


def _attributed(path: str, rule: str, with_sections: bool):
    names = ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches):
        enc, size_of = encoder(path, "bytes"), token_bytes(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            given = batch.column("sections") if with_sections else None
            data, offsets = textnp.column_bytes(batch.column("text"))
            for lo, hi in textnp.pieces(offsets):
                ids, bounds = enc.encode(data, offsets[lo:hi + 1])
                part = data[offsets[lo]:offsets[hi]]
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])     # characters that begin before a byte
                rel = offsets[lo:hi + 1] - offsets[lo]
                sizes = size_of[ids]
                end_byte = np.cumsum(sizes)
                first = chars[end_byte - sizes + 1] - 1
                last = chars[end_byte]
                feeds = np.flatnonzero(part == 10)
                feed_of = np.searchsorted(feeds, rel)
                out: list = [[] for _ in names]
                for i in range(hi - lo):
                    base, total = chars[rel[i]], chars[rel[i + 1]] - chars[rel[i]]
                    sections = given[lo + i].as_py() if with_sections else None
                    if sections is None:
                        own = chars[feeds[feed_of[i]:feed_of[i + 1]] + 1] - base
                        ends = own if len(own) and own[-1] == total else np.concatenate([own, [total]])
                        starts = np.concatenate([[0], ends[:-1]])
                        numbers = list(range(len(ends)))
                    else:
                        held, empty = in_order(sections)
                        starts, ends = disjoint(held)
                        numbers = [s[2] for s in held]
                    a, b = bounds[i], bounds[i + 1]
                    counts, crossing = attribute(first[a:b] - base, last[a:b] - base, starts, ends, rule)
                    rows = len(numbers) + (1 if counts[-1] else 0)
                    if sections is None:
                        held, empty = list(zip(starts.tolist(), ends.tolist(), numbers)), []
                    listed = [*[*held, (None, None, None)][:rows], *empty]
                    out[0].append(np.full(len(listed), i))
                    for column, at in ((1, 2), (2, 0), (3, 1)):
                        out[column] += [s[at] for s in listed]
                    out[4].append(np.concatenate([counts[:rows], np.zeros(len(empty))]))
                    out[5].append(np.concatenate([crossing[:rows], np.zeros(len(empty), np.int64)]))
                which = np.concatenate(out[0])
                cols = [doc_ids.slice(lo, hi - lo).take(pa.array(which)), *out[1:4], np.concatenate(out[4]), np.concatenate(out[5])]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    return run


def count_tokens(docs: DataFrame, sections: DataFrame | None = None, vocabulary: str | None = None, rule: str = "largest") -> DataFrame:
    """(doc_id, section, first_char, end_char, n_tokens, n_crossing): tokens of each section of each document row.

    ``sections``: (doc_id, section long, first_char, end_char), disjoint within a document; without it, lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    d = docs.select("doc_id", "text")
    if sections is not None:
        # A document's own sections: bounded by its text.
        own = sections.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("section", "first_char", "end_char")).alias("sections"))
        d = d.join(own, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", F.coalesce(
            "sections", F.array().cast("array<struct<section:bigint,first_char:bigint,end_char:bigint>>")).alias("sections"))
    return map_arrow(d, _attributed(path, rule, sections is not None),
                     "doc_id long, section long, first_char long, end_char long, n_tokens double, n_crossing long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
