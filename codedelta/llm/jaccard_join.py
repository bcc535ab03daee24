"""Exact n-gram Jaccard join by a token-group matrix.

Documents are sets of distinct five-word shingles; two link at a Jaccard similarity of 0.75 or
more.  The steps:

1. One pass over the texts gives each document's set size, a 128-bit digest of its set and six
   minimum hashes.  Documents with equal sets are one class; its smallest id stands for it.
2. Grouping: classes that share two minimum hashes and a size band with the smallest class of those that
   do are compared with it; those that link form groups (connected components of the exact links so far).  A hot group of
   near copies so shrinks to one group with as many comparisons as it has members.
3. Token-group matrix: tokens get a fixed order, rare before frequent.  Of each class's set only its first
   tokens are kept: if J(x, y) >= t and |y| <= |x|, then x and y share at least m tokens among the first
   |x| - ceil(t|x|) + m of x and the first |y| - ceil(2t/(1+t)|y|) + m of y, for any m.  With m(n) = 1 + n / 20
   for a set of n, the least m of the two holds for the pair.  A group's row is the union of the first tokens
   of its members; a query that meets the row in fewer than m(t|x|) tokens cannot link with any
   member.  Tokens of one group only are dropped.
   The pair also shares a token with m = 1.  Near copies that do not link have many rare tokens of their own, so
   that they rarely do; tokens of many groups are therefore met only by pairs that share one with m = 1.
4. Only the remaining groups of a query are opened: the query's set is compared exactly with those of the
   members, in blocks of bounded size.
5. Links of 2 and 4 give the connected components.

The order of step 3 comes from the number of classes that hold a token, counted over all classes in hashed
cells whose number grows with the data: a limit that grew with the data instead would leave ever more
frequent tokens among the first ones, and their pairs grow with the square.  The order affects the
amount of work, never the result.  Tokens travel packed, as 32-bit values in hashed buckets whose number grows
with the data; frequent tokens, which a task could not hold, go through Spark's own aggregation and joins.

Edge cases: null or wordless texts have an empty set and are linked with nothing; a text of fewer
than five words is one shingle; rows that share a doc_id are one node of the link graph; a null
doc_id links with nothing and has itself (null) as component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codedelta.llm import textnp
from codedelta.llm.common import give_back, map_texts, read_table, without, write_table
from codedelta.llm.components import components

WIDTH = 5
N_KEYS = 6
#: Of the keys, as many must lead to the same least class.
LEAST_KEYS = 2
#: Extra first tokens: one for so many of a set.
EXTRA = 20
#: Bits of a cell within its bucket of the count table.
CELL_BITS = 24
#: A token is frequent from this many classes on, unless more than MOST_FREQUENT are; then the most frequent of them are.
FREQUENT = 16
MOST_FREQUENT = 1 << 20
#: Tokens of so many classes are not packed: a bucket could not hold them.
UNPACKED = 1 << 14
#: Members and queries of a block that one task compares.
BLOCK = 256
#: Tokens that a bucket of the matrix holds on average.
BUCKET_TOKENS = 1 << 20
#: Ids up to which the list of documents to open is broadcast (16 MB); beyond it is joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: A token that more groups than this index meets only the groups that a query can link with.
WIDE = 16
#: Where a token stands in its set: in the part indexed, in the first part of a query with m = 1, in the one indexed with m = 1.
INDEXED, QUERY_1, INDEXED_1 = 1, 2, 4
#: Tokens that a task packs at a time.
FLUSH = 1 << 21

_PROFILE = "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"k{i} long" for i in range(1, N_KEYS + 1))
_LINKS = "a long, b long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profile(batches):
    """Set size, digest and minimum hashes of each document."""
    salts = textnp.mix64(np.arange(11, 11 + N_KEYS, dtype=np.uint64))
    for batch in batches:
        ids = batch.column("doc_id")
        data, offsets = textnp.column_bytes(batch.column("text"))
        for lo, hi in textnp.pieces(offsets):
            tokens, bounds = textnp.shingle_sets(data, offsets[lo:hi + 1], WIDTH)
            cols = [textnp.sums_by(textnp.mix64(tokens), bounds), textnp.sums_by(textnp.mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)]
            cols += [textnp.minima_by(textnp.mix64(tokens ^ s), bounds) for s in salts]
            yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(np.diff(bounds)), *[pa.array(_signed(c)) for c in cols]], names=_names(_PROFILE))


def _cells(bucket_bits: int):
    """The cells (first bits of the token) of all sets, packed by bucket: three bytes each, then those met more than once with their counts."""
    def flush(tokens):
        cell = np.sort((tokens >> np.uint64(64 - bucket_bits - CELL_BITS)).astype(np.int64))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
        counts = np.diff(np.concatenate([starts, [len(cell)]])).astype(np.uint32)
        cell = cell[starts]
        bucket, cell = (cell >> CELL_BITS).astype(np.int32), (cell & ((1 << CELL_BITS) - 1)).astype("<u4")
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
        rows = []
        for s, e in zip(starts, [*starts[1:], len(bucket)]):
            more = np.flatnonzero(counts[s:e] > 1).astype(np.uint32)
            rows.append(np.int64(e - s).tobytes() + more.tobytes() + counts[s:e][more].tobytes()
                        + np.ascontiguousarray(cell[s:e].view(np.uint8).reshape(-1, 4)[:, :3]).tobytes())
        return pa.record_batch([pa.array(bucket[starts]), pa.array(rows, pa.binary())], names=["bucket", "packed"])

    def run(batches):
        held, n_held = [], 0
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column("text"))
            for lo, hi in textnp.pieces(offsets):
                tokens, _ = textnp.shingle_sets(data, offsets[lo:hi + 1], WIDTH)
                held.append(tokens)
                n_held += len(tokens)
                if n_held >= FLUSH:
                    yield flush(np.concatenate(held))
                    held, n_held = [], 0
        if n_held:
            yield flush(np.concatenate(held))
    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """0 below FREQUENT, then 1 to 63 in half powers of two."""
    return np.clip(1 + np.floor(2 * np.log2(np.maximum(counts, 1) / FREQUENT)), 0, 63).astype(np.int32)


def _frequent(table: pa.Table) -> pa.Table:
    """The cells of a bucket (with the bucket's number before their bits) whose level is above 0."""
    cells, counts = [], []
    for row in table.column("packed"):
        raw = np.frombuffer(row.as_buffer(), np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        more = raw[8:len(raw) - 3 * n].view(np.uint32)
        at, times = more[:len(more) // 2], more[len(more) // 2:]
        wide = np.zeros((n, 4), np.uint8)
        wide[:, :3] = raw[len(raw) - 3 * n:].reshape(n, 3)
        count = np.ones(n, np.int64)
        count[at] = times
        cells.append(wide.view("<u4").ravel())
        counts.append(count)
    cell, count = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    cell, count = cell[order], count[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
    count = np.add.reduceat(count, starts)
    keep = count >= FREQUENT
    first = np.int64(table.column("bucket")[0].as_py()) << CELL_BITS
    return pa.table([pa.array(cell[starts][keep].astype(np.int64) | first), pa.array(_level(count[keep]))], names=["cell", "level"])


def _tidy_frequent(table: pa.Table) -> pa.Table:
    out = _frequent(table)
    give_back()
    return out


def _levels(texts: DataFrame, total: int) -> np.ndarray:
    """The level of the tokens by their first bits: a table of some cells for each frequent token, the highest level counting."""
    bucket_bits = max(4, int(total / BUCKET_TOKENS).bit_length())
    cells = map_texts(texts.select("text"), _cells(bucket_bits), "bucket int, packed binary")
    found = write_table(cells.groupBy("bucket").applyInArrow(_tidy_frequent, "cell long, level int"), "frequent")
    least, n = 64, 0
    for level, count in sorted(found.groupBy("level").count().collect(), reverse=True):
        if n + count > MOST_FREQUENT:
            break
        least, n = level, n + count
    bits = max(8, (8 * n).bit_length())
    # At most 2^20 rows.
    at = F.shiftright("cell", bucket_bits + CELL_BITS - bits)
    top = found.filter(F.col("level") >= least).groupBy(at.cast("int").alias("at")).agg(F.max("level").cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    levels[top.column("at").to_numpy()] = top.column("level").to_numpy()
    return levels


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def _opened(limit_num: int, limit_den: int):
    """Exact comparison of the queries of a block with its members.  Rows of a block arrive together, queries
    (role 0) before members; members are handled as they come."""
    def run(batches):
        block, queries, q_ids = None, [], []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("grp", "q_part", "m_part")])
            role, ids = np.asarray(batch.column("role")), np.asarray(batch.column("id"))
            data, offsets = textnp.column_bytes(batch.column("text"))
            left, right = [], []
            for lo, hi in textnp.pieces(offsets):
                tokens, bounds = textnp.shingle_sets(data, offsets[lo:hi + 1], WIDTH)
                change = np.ones(hi - lo, bool)
                change[1:] = (np.diff(keys[:, lo:hi], axis=1) != 0).any(axis=0) | (np.diff(role[lo:hi]) != 0)
                edges = [*np.flatnonzero(change), hi - lo]
                for s, e in zip(edges[:-1], edges[1:]):
                    here = tuple(keys[:, lo + s])
                    if here != block:
                        block, queries, q_ids = here, [], []
                    if role[lo + s] == 0:
                        queries += [tokens[bounds[i]:bounds[i + 1]].copy() for i in range(s, e)]
                        q_ids += list(ids[lo + s:lo + e])
                        continue
                    part = tokens[bounds[s]:bounds[e]]
                    sizes = np.diff(bounds[s:e + 1])
                    owner = np.repeat(np.arange(e - s), sizes)
                    for q, q_id in zip(queries, q_ids):
                        if not len(q) or not len(part):
                            continue
                        at = np.minimum(np.searchsorted(q, part), len(q) - 1)
                        both = np.bincount(owner[q[at] == part], minlength=e - s)
                        ok = (limit_den * both >= limit_num * (len(q) + sizes - both)) & (sizes > 0) & (ids[lo + s:lo + e] != q_id)
                        found = ids[lo + s:lo + e][ok]
                        left.append(np.full(len(found), q_id))
                        right.append(found)
            if left:
                yield pa.record_batch([pa.array(np.concatenate(left).astype(np.int64)), pa.array(np.concatenate(right).astype(np.int64))], names=["a", "b"])
    return run


def _open(docs: DataFrame, members: DataFrame, queries: DataFrame, num: int, den: int) -> DataFrame:
    """Exact links (a, b) between the queries (grp, id) and the members (grp, id) of the same group.

    Both sides of a large group are cut into parts by a hash of the id, and each part of queries meets
    each part of members, so that a block stays small."""
    def parts(t, name):
        return t.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    counts = parts(members, "m_parts").join(parts(queries, "q_parts"), "grp")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (members.join(counts, "grp").select("grp", "id", F.lit(1).alias("role"), part("m_parts").alias("m_part"), every("q_parts").alias("q_part"))
            .unionByName(queries.join(counts, "grp").select(
                "grp", "id", F.lit(0).alias("role"), part("q_parts").alias("q_part"), every("m_parts").alias("m_part"))))
    rows = write_table(rows, "blocks")
    ids = rows.select(F.col("id").alias("need")).distinct()
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("need"), "left_semi")
    full = rows.join(texts, F.col("id") == F.col("doc_id")).select("grp", "q_part", "m_part", "role", "id", "text")
    dealt = full.repartition("grp", "q_part", "m_part").sortWithinPartitions("grp", "q_part", "m_part", "role")
    return map_texts(dealt, _opened(num, den), _LINKS)


def _prefixes(levels: np.ndarray, unpacked: int, n_buckets: int, num: int, den: int):
    """The first tokens of each set: packed by bucket, or a row each from the level ``unpacked`` on."""
    bits, shift = np.uint64(n_buckets - 1), np.uint64(64 - (len(levels) - 1).bit_length())
    names = ["bucket", "packed", "token", "doc_id", "flags"]

    def flush(tokens, docs, flags):
        bucket = (tokens & bits).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, docs, flags = bucket[order], (tokens[order] >> np.uint64(32)).astype(np.uint32), docs[order], flags[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
        rows = []
        for s, e in zip(starts, ends):
            step = np.diff(docs[s:e])
            kind = np.int64
            for small in (np.int16, np.int32):
                if len(step) and np.abs(step).max() <= np.iinfo(small).max:
                    kind = small
                    break
            head = np.array([np.dtype(kind).itemsize, e - s, docs[s]], np.int64)
            rows.append(head.tobytes() + tokens[s:e].tobytes() + flags[s:e].tobytes() + step.astype(kind).tobytes())
        n = len(rows)
        return pa.record_batch([pa.array(bucket[starts]), pa.array(rows, pa.binary()), pa.nulls(n, pa.int64()),
                                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int8())], names=names)

    def run(batches):
        held, docs, flags, n_held = [], [], [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            keep = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0))
            data, offsets = textnp.column_bytes(batch.column("text"))
            for lo, hi in textnp.pieces(offsets):
                tokens, bounds = textnp.shingle_sets(data, offsets[lo:hi + 1], WIDTH)
                level = levels[(tokens >> shift).astype(np.int64)]
                # Rare before frequent, then by hash.  The order of two tokens is the same in every text.
                key = (level.astype(np.uint64) << np.uint64(58)) | (textnp.mix64(tokens) >> np.uint64(6))
                hot_t, hot_d, hot_f = [], [], []
                for i in range(hi - lo):
                    s, e = bounds[i], bounds[i + 1]
                    n = int(e - s)
                    if not n or not keep[lo + i]:
                        continue
                    more = 1 + n // EXTRA
                    query_1, index_1 = n + (-num * n // den) + 1, n + (-2 * num * n // (num + den)) + 1
                    query, index = min(n, query_1 - 1 + more), index_1 - 1 + more
                    first = np.argpartition(key[s:e], query - 1)[:query] if query < n else np.arange(n)
                    first = first[np.argsort(key[s:e][first])]
                    chosen = tokens[s:e][first]
                    at = np.arange(len(first))
                    flag = (INDEXED * (at < index) + QUERY_1 * (at < query_1) + INDEXED_1 * (at < index_1)).astype(np.int8)
                    hot = level[s:e][first] >= unpacked
                    doc = int(ids[lo + i])
                    if hot.any():
                        hot_t.append(chosen[hot])
                        hot_d.append(np.full(int(hot.sum()), doc))
                        hot_f.append(flag[hot])
                        chosen, flag = chosen[~hot], flag[~hot]
                    held.append(chosen)
                    docs.append(np.full(len(chosen), doc, np.int64))
                    flags.append(flag)
                    n_held += len(chosen)
                if hot_t:
                    t = np.concatenate(hot_t)
                    yield pa.record_batch([pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.binary()), pa.array(_signed(t)),
                                           pa.array(np.concatenate(hot_d).astype(np.int64)), pa.array(np.concatenate(hot_f))], names=names)
                if n_held >= FLUSH:
                    yield flush(np.concatenate(held), np.concatenate(docs), np.concatenate(flags))
                    held, docs, flags, n_held = [], [], [], 0
        if n_held:
            yield flush(np.concatenate(held), np.concatenate(docs), np.concatenate(flags))
    return run


def _shared(table: pa.Table) -> pa.Table:
    """The tokens of a bucket that two or more documents hold, one of them in its indexed part.  Tokens with
    the same documents are one row each, with their number as weight."""
    bucket = table.column("bucket")[0].as_py()
    tokens, docs, flags = [], [], []
    for row in table.column("packed"):
        raw = row.as_buffer()
        width, n, start = np.frombuffer(raw, np.int64, 3)
        tokens.append(np.frombuffer(raw, np.uint32, n, 24))
        flags.append(np.frombuffer(raw, np.int8, n, 24 + 4 * n))
        step = np.frombuffer(raw, f"i{width}", n - 1, 24 + 5 * n).astype(np.int64)
        docs.append(np.cumsum(np.concatenate([[start], step])))
    token, doc, flag = np.concatenate(tokens), np.concatenate(docs), np.concatenate(flags)
    order = np.lexsort((flag, doc, token))
    token, doc, flag = token[order], doc[order], flag[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(token)]]))
    several = np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts)
    indexed = np.maximum.reduceat(flag & INDEXED, starts) > 0
    same = textnp.sums_by(textnp.mix64(textnp.mix64(doc.astype(np.uint64)) + flag.astype(np.uint64)), np.concatenate([starts, [len(token)]]))
    good = np.flatnonzero(several & indexed)
    _, once, weight = np.unique(same[good], return_index=True, return_counts=True)
    good = good[once]
    weight = np.repeat(weight, sizes[good])
    rows = np.repeat(starts[good], sizes[good]) + (np.arange(sizes[good].sum()) - np.repeat(np.cumsum(sizes[good]) - sizes[good], sizes[good]))
    key = (token[rows].astype(np.int64) << 31) | bucket
    return pa.table([pa.array(key), pa.array(doc[rows]), pa.array(flag[rows]), pa.array(weight)], names=["token", "doc_id", "flags", "weight"])


def _tidy_shared(table: pa.Table) -> pa.Table:
    out = _shared(table)
    give_back()
    return out


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, wide: int = WIDE) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    docs = docs.select("doc_id", "text")
    sets = write_table(map_texts(docs, _profile, _PROFILE), "profile")
    classes = write_table(sets.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("id"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(1, N_KEYS + 1)]), "classes")

    # Groups of similar documents, by exact links to the least of those with the same minimum hash and size band.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int")
    keyed = classes.select("id", "n", F.posexplode(F.array(*[f"k{i}" for i in range(1, N_KEYS + 1)])).alias("which", "key"))
    keyed = keyed.withColumn("band", band)
    least = keyed.groupBy("which", "key", "band").agg(F.min("id").alias("grp"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    pairs = write_table(keyed.join(least, ["which", "key", "band"]).filter("id != grp").groupBy("grp", "id").agg(
        F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LEAST_KEYS).select("grp", "id"), "pairs")
    heads = pairs.select("grp", F.col("grp").alias("id")).distinct()
    links = write_table(_open(docs, pairs, heads, num, den), "links")
    groups = write_table(components(links), "groups")
    member = write_table(classes.join(groups, F.col("id") == F.col("node"), "left").select(
        "id", "n", F.coalesce("component", "id").alias("grp")), "member")

    # Token-group matrix.
    # Only the rows of the classes' ids have a part in it, wherever their copies lie.
    ids = classes.select(F.col("id").alias("need")).distinct()
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("need"), "left_semi")
    total = classes.agg(F.sum("n")).first()[0] or 0
    n_buckets = 1 << max(4, int(total / 4 / BUCKET_TOKENS).bit_length())
    unpacked = max(1, int(_level(np.array(UNPACKED))))
    firsts = write_table(map_texts(chosen, _prefixes(_levels(chosen, total), unpacked, n_buckets, num, den),
                                   "bucket int, packed binary, token long, doc_id long, flags byte"), "firsts")
    rare = firsts.filter("packed is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(
        _tidy_shared, "token long, doc_id long, flags byte, weight long")
    often = firsts.filter("packed is null").select("token", "doc_id", "flags", F.lit(1).cast("long").alias("weight"))
    entries = (rare.withColumn("hot", F.lit(0)).unionByName(often.withColumn("hot", F.lit(1)))
               .join(member, F.col("doc_id") == F.col("id")).select("hot", "token", "id", "n", "grp", "flags", "weight"))
    entries = write_table(entries, "entries")
    has = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    matrix = entries.groupBy("hot", "token", "grp").agg(
        F.min(F.when(has(INDEXED), F.col("n"))).alias("least"), F.max(F.when(has(INDEXED), F.col("n"))).alias("most"), F.max(has(INDEXED_1)).alias("indexed_1"))
    several = write_table(matrix.groupBy("hot", "token").agg(
        F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.count("least").alias("c")).filter("g1 < g2 and c > 0").select(
            "hot", "token", (F.col("c") > wide).alias("wide")), "several")
    matrix = write_table(matrix.filter("least is not null").withColumnRenamed("grp", "other").join(several, ["hot", "token"]), "matrix")
    queries = write_table(entries.select("hot", "token", "id", "n", "grp", "weight", has(QUERY_1).alias("query_1")).join(several, ["hot", "token"]), "queries")
    fits = (F.col("grp") != F.col("other")) & (F.col("least") <= F.col("n")) & (den * F.col("most") >= num * F.col("n"))

    def met(rows):
        return rows.groupBy("other", "id").agg(F.sum("weight").alias("met"), F.min("n").alias("n"), F.min("least").alias("least"),
                                               F.max(F.col("query_1") & F.col("indexed_1")).alias("met_1"))
    keys = ["hot", "token"]
    narrow = write_table(met(queries.filter("not wide").drop("wide").join(matrix.filter("not wide").drop("wide"), keys).filter(fits)), "narrow")
    wide_q, wide_m = queries.filter("wide").drop("wide"), matrix.filter("wide").drop("wide")
    # What links meets with m = 1 too; only such pairs of a query and a group meet in the tokens of many groups.
    first = wide_q.filter("query_1").join(wide_m.filter("indexed_1"), keys).filter(fits).select("other", "id")
    pairs_1 = write_table(narrow.filter("met_1").select("other", "id").union(first).distinct(), "pairs_1")
    broad = met(wide_q.join(pairs_1, "id").join(wide_m, [*keys, "other"]).filter(fits))
    # A member that links has at least num / den of the query's size, and is no smaller than the least met.
    needed = 1 + F.floor(F.greatest(F.ceil(F.col("n") * num / den), "least") / EXTRA)
    hits = (narrow.unionByName(broad).groupBy(F.col("other").alias("grp"), "id").agg(
        F.sum("met").alias("met"), F.min("n").alias("n"), F.min("least").alias("least"), F.max("met_1").alias("met_1"))
            .filter(F.col("met_1") & (F.col("met") >= needed)).select("grp", "id"))
    hits = write_table(hits, "hits")
    opened = member.select("grp", "id").join(hits.select("grp").distinct(), "grp", "left_semi")
    more = write_table(_open(docs, opened, hits, num, den), "links")

    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = write_table(components(stars.unionByName(more)), "components")
    named = classes.join(final, F.col("id") == F.col("node"), "left").select(
        "n", "d1", "d2", F.coalesce("component", "id").alias("component_id"))
    s = sets.alias("s")
    joined = s.join(named.alias("c"), (F.col("s.n") == F.col("c.n")) & (F.col("s.d1") == F.col("c.d1")) & (F.col("s.d2") == F.col("c.d2"))
                    & F.col("s.doc_id").isNotNull(), "left")
    return joined.select("s.doc_id", F.col("s.n").alias("n_shingles"), F.coalesce("c.component_id", "s.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay when only the least doc_id of each component does, with their own columns."""
    out = write_table(jaccard_components(docs).filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    return without(docs, out)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
