"""Token-id store with Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id, encoded, and written in shards of about
``SHARD_IDS`` ids, one Parquet row each.  Per shard the most frequent pairs of neighbouring symbols are replaced by
new symbols, in rounds: a round counts all pairs in hashed cells, counts those of the fullest cells
exactly, makes a rule for each of up to ``RULES_PER_ROUND`` most frequent pairs, and replaces its occurrences from left to
right without overlaps.  Rounds end when no pair occurs ``LEAST_COUNT`` times: a shard has fewer ids than any number of rounds
could need, since every rule shortens it.  A pair never holds the end id, so no rule spans two documents.

Format of a row (little-endian arrays): part, seq (order of the shard), base (first rule's symbol; smaller ones
are ids), width (bytes of a symbol), doc_ids int64, n_tokens uint32, first uint32 (index of each document's first
symbol), rules uint32 pairs, lengths uint32 (ids that each rule expands to), symbols.  A document is decoded
from its own symbols alone; with the lengths, so is any range of its ids.

Edge cases: a null or empty text is just the end id; rows with the same doc_id follow each other, ordered
by a hash of the text; null doc_ids come first; an empty table gives no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codedelta.llm import textnp
from codedelta.llm.common import BATCH_ROWS, map_texts, new_path, read_table, write_table
from codedelta.llm.encoding import encoder, tokenizer_path

END_ID = 2
SHARD_IDS = 1 << 20
RULES_PER_ROUND = 1024
LEAST_COUNT = 32
CELL_BITS = 18

_SHARD = ("part long, seq long, base long, width int, n_ids long, has_id binary, doc_ids binary, n_tokens binary, "
          "first binary, rules binary, lengths binary, symbols binary")


def _cells(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hashed cell of each pair of symbols (uint32)."""
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - CELL_BITS)


def _frequent_pairs(seq: np.ndarray, joinable: np.ndarray, cell: np.ndarray, most: int, least: int) -> np.ndarray:
    """The up to ``most`` most frequent neighbouring pairs, as left << 32 | right."""
    # The pairs that may not be joined are few (two for each end id): they are taken off the count of all.
    counts = np.bincount(cell, minlength=1 << CELL_BITS) - np.bincount(cell[np.flatnonzero(~joinable)], minlength=1 << CELL_BITS)
    every = counts >= least
    full = every
    if every.sum() > 2 * most:
        full = every & (counts >= np.partition(counts, -2 * most)[-2 * most])
    # Where the fullest cells hold no frequent pair, all cells that could are counted.
    for cells in (full, every):
        some = np.flatnonzero(joinable & cells[cell])
        code = (seq[some].astype(np.uint64) << np.uint64(32)) | seq[some + 1]
        pairs, n = np.unique(code, return_counts=True)
        pairs, n = pairs[n >= least], n[n >= least]
        if len(pairs) or cells is every:
            break
    if len(pairs) > most:
        best = np.sort(np.argsort(-n, kind="stable")[:most])
        pairs = pairs[best]
    return pairs


def repair(seq: np.ndarray, base: int, end: int = END_ID, most: int = RULES_PER_ROUND, least: int = LEAST_COUNT):
    """(symbols, rules): rule r makes symbol base + r of two earlier symbols."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(seq) > 1:
        joinable = seq != end
        joinable = joinable[:-1] & joinable[1:]
        cell = _cells(seq[:-1], seq[1:])
        pairs = _frequent_pairs(seq, joinable, cell, most, least)
        if not len(pairs):
            break
        # A pair's cell leads to its rule; only where rules share a cell the pair itself is looked up.
        own = _cells((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
        rule_of = np.full(1 << CELL_BITS, -1, np.int32)
        rule_of[own] = np.arange(len(pairs))
        shared = np.zeros(1 << CELL_BITS, bool)
        shared[own[rule_of[own] != np.arange(len(pairs))]] = True
        rule = rule_of[cell]
        at = np.flatnonzero((rule >= 0) & joinable)
        rule = rule[at].astype(np.int64)
        code = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        unsure = np.flatnonzero(shared[cell[at]])
        rule[unsure] = np.minimum(np.searchsorted(pairs, code[unsure]), len(pairs) - 1)
        hit = pairs[rule] == code
        at, rule = at[hit], rule[hit]
        # In a run of overlapping occurrences every second one is replaced.
        new_run = np.ones(len(at), bool)
        new_run[1:] = np.diff(at) > 1
        run_first = np.flatnonzero(new_run)
        offset = np.arange(len(at)) - run_first[np.cumsum(new_run) - 1]
        take = (offset & 1) == 0
        at, rule = at[take], rule[take]
        # Pairs whose every occurrence overlaps one that was replaced make no rule.
        used, rule = np.unique(rule, return_inverse=True)
        pairs = pairs[used]
        seq[at] = (base + n_rules + rule).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        n_rules += len(pairs)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansions(rules: np.ndarray, base: int):
    """(lengths, flat, starts): what each rule stands for in ids: flat[starts[r]:starts[r] + lengths[r]]."""
    lengths = np.zeros(len(rules), np.int64)
    texts: list = []
    for r, (a, b) in enumerate(rules.tolist()):
        both = [texts[x - base] if x >= base else np.array([x], np.uint32) for x in (a, b)]
        texts.append(np.concatenate(both))
        lengths[r] = len(texts[-1])
    flat = np.concatenate(texts) if texts else np.empty(0, np.uint32)
    return lengths, flat, np.cumsum(lengths) - lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int):
    """(ids, sizes): the ids that the symbols stand for, and how many each gives."""
    lengths, flat, starts = expansions(rules, base)
    table = np.concatenate([np.arange(base, dtype=np.uint32), flat])
    begin = np.concatenate([np.arange(base), base + starts])
    size = np.concatenate([np.ones(base, np.int64), lengths])
    sizes = size[symbols]
    total = np.cumsum(sizes)
    if not len(total):
        return np.empty(0, np.uint32), sizes
    at = np.repeat(begin[symbols] - (total - sizes), sizes)
    at += np.arange(int(total[-1]))
    return table[at], sizes


def _shards(path: str, kind: str, end: int):
    """Texts in their order, made into rows of the shard format."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(path, kind)
        base = max(enc.tokenizer.get_vocab_size(), end + 1)
        held: list = []
        n_held = seq_no = 0

        def shard():
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            symbols, rules = repair(ids, base, end)
            lengths, _, _ = expansions(rules, base)
            size = np.concatenate([np.ones(base, np.int64), lengths])[symbols]
            ends = np.cumsum(size)
            first = np.searchsorted(ends, np.cumsum(sizes) - sizes, "right")
            width = 2 if base + len(rules) <= 1 << 16 else 4
            cells = [part, seq_no, base, width, int(sizes.sum()), np.concatenate([h[3] for h in held]).tobytes(),
                     np.concatenate([h[2] for h in held]).tobytes(), sizes.astype(np.uint32).tobytes(), first.astype(np.uint32).tobytes(),
                     rules.tobytes(), lengths.astype(np.uint32).tobytes(), symbols.astype(f"u{width}").tobytes()]
            names = [x.split()[0] for x in _SHARD.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 7
            return pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

        for batch in batches:
            doc_ids = batch.column("doc_id")
            has_id = np.asarray(doc_ids.is_valid()).astype(np.uint8)
            doc_ids = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
            data, offsets = textnp.column_bytes(batch.column("text"))
            for lo, hi in textnp.pieces(offsets, 2 << 20):
                ids, bounds = enc.encode(data, offsets[lo:hi + 1])
                sizes = np.diff(bounds) + 1
                out = np.full(int(sizes.sum()), end, np.uint32)
                inside = np.ones(len(out), bool)
                inside[np.cumsum(sizes) - 1] = False
                out[inside] = ids
                held.append((out, sizes, doc_ids[lo:hi], has_id[lo:hi]))
                n_held += len(out)
                if n_held >= SHARD_IDS:
                    yield shard()
                    held, n_held, seq_no = [], 0, seq_no + 1
        if held:
            yield shard()
    return run


def write_store(docs: DataFrame, out: str, vocabulary: str, kind: str = "words", end: int = END_ID) -> None:
    """Write the documents' ids in ascending doc_id order at ``out``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select("doc_id", "text").repartitionByRange(n, "doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    map_texts(ordered, _shards(vocabulary, kind, end), _SHARD, 2 * BATCH_ROWS, encodes=True).write.parquet(out)


class Shard:
    """One row of the store; decodes single documents or all of them."""

    def __init__(self, row: dict):
        self.base = row["base"]
        as_array = lambda name, kind: np.frombuffer(row[name], kind)
        self.has_id = as_array("has_id", np.uint8).astype(bool)
        self.doc_ids, self.sizes = as_array("doc_ids", np.int64), as_array("n_tokens", np.uint32).astype(np.int64)
        self.first, self.lengths = as_array("first", np.uint32).astype(np.int64), as_array("lengths", np.uint32)
        self.rules = as_array("rules", np.uint32).reshape(-1, 2)
        self.symbols = as_array("symbols", f"u{row['width']}").astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, from its own symbols alone."""
        last = self.first[i + 1] if i + 1 < len(self.first) else len(self.symbols)
        return expand(self.symbols[self.first[i]:last], self.rules, self.base)[0]

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)[0]


def _documents(batches):
    """Facts of each document, from the decoded ids."""
    names = ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            s = Shard(row)
            ids = s.ids().astype("<u4")
            ends = np.cumsum(s.sizes)
            crcs = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), s.sizes.tolist())]
            n = len(ends)
            yield pa.record_batch([pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["seq"])), pa.array(s.doc_ids, mask=~s.has_id),
                                   pa.array(ends - s.sizes), pa.array(s.sizes), pa.array(np.array(crcs, np.int64))], names=names)


def read_store(spark, out: str) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32.

    start adds what lies before in the shard, in the part and in the parts before; only one row per part goes
    through an unpartitioned window."""
    store = spark.read.schema(_SHARD).parquet(out)
    shards = store.select("part", "seq", "n_ids")
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("parts_before"))
    base = (shards.withColumn("shards_before", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
            .join(parts, F.col("part") == F.col("p"))
            .select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("shards_before") + F.col("parts_before")).alias("ids_before")))
    base = write_table(base, "shard_starts")
    docs = map_texts(store, _documents, "part long, seq long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return (docs.join(base, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
            .select("doc_id", (F.col("before") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32"))


def store_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    out = new_path(docs.sparkSession, "token_store")
    write_store(docs, out, vocabulary or tokenizer_path("word_bpe_49k.json"))
    return read_store(docs.sparkSession, out)


def query(spark, sf_dir: str) -> DataFrame:
    return store_and_read(read_table(spark, sf_dir, "documents"))
