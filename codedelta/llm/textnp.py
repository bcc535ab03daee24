"""Vectorised hashing of words and shingles: numpy over the buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict = {}   # byte codes by fold, powers by base


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _tables.get(("powers", int(base)))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        out = np.ones(size, np.uint64)
        done, step = 1, int(base)
        while done < size:
            out[done:2 * done] = out[:done] * np.uint64(step)
            step = step * step % (1 << 64)
            done *= 2
        _tables["powers", int(base)] = have = out
    return have[:n]


def _byte_codes(fold: bool) -> np.ndarray:
    """A fixed random 64-bit code for each byte; with ``fold`` A-Z share the codes of a-z."""
    if fold not in _tables:
        codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        if fold:
            codes[65:91] = codes[97:123]
        _tables[fold] = codes
    return _tables[fold]


class SpanHashes:
    """Hashes of any part[start:end] of a byte array, from prefix sums of a polynomial in the byte positions."""

    def __init__(self, part: np.ndarray, fold: bool = True):
        self.total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_codes(fold)[part] * _powers(_BASE, len(part)), out=self.total[1:])
        self.inverse = _powers(_INV, len(part))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        h = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mix64(h + (ends - starts).astype(np.uint64))


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    return SpanHashes(part, fold).of(starts, ends)


def space_table() -> np.ndarray:
    """True for the bytes that are not ASCII white space (0x20, 0x09-0x0D)."""
    t = np.ones(256, bool)
    t[9:14] = False
    t[32] = False
    return t


def alnum_table() -> np.ndarray:
    """True for 0-9, A-Z, a-z and all bytes of non-ASCII characters."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        if np.any((offsets[1:] - offsets[:-1])[~keep] > 0):
            column = column.fill_null("" if pa.types.is_string(column.type) else b"")
            return column_bytes(column)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = 1 << 18):
    """Row ranges of about ``most`` bytes; a longer text is a range by itself."""
    first = 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """(starts, ends, doc) of the words in ``data[offsets[0]:offsets[-1]]``, as positions in that slice."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    rel = offsets - lo
    inside = np.zeros(len(part) + 2, np.int8)
    inside[1:-1] = in_word[part]
    step = np.diff(inside)
    start = step[:-1] == 1
    end = step[1:] == -1          # at the last byte of a word
    edges = rel[1:-1]
    edges = edges[(edges > 0) & (edges < len(part))]
    if len(edges):                # words do not run over from one text into the next
        both = (inside[edges] == 1) & (inside[edges + 1] == 1)
        start[edges[both]] = True
        end[edges[both] - 1] = True
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    doc = np.searchsorted(rel, starts, "right") - 1
    return part, starts, ends, doc


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """(hashes, doc, starts, ends) of the words of a range of texts, with A-Z taken as a-z."""
    part, starts, ends, doc = word_spans(data, offsets, in_word)
    if not len(starts):
        return np.empty(0, np.uint64), doc, starts, ends
    return span_hashes(part, starts, ends), doc, starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """(tokens, bounds): sorted distinct shingle hashes of each text, text i in tokens[bounds[i]:bounds[i+1]].

    A text of fewer words than ``width`` has its whole word sequence as its only shingle; one without
    words has none."""
    n = len(offsets) - 1
    h, doc, _, _ = word_hashes(data, offsets, space_table())
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    parts = np.zeros(len(h), np.uint64)
    for i in range(width):
        shifted = h[i:]
        parts[:len(shifted)] = parts[:len(shifted)] * np.uint64(0xC2B2AE3D27D4EB4F) + shifted
    full = np.zeros(len(h), bool)
    for i in np.flatnonzero(counts >= width):
        full[first[i]:first[i + 1] - width + 1] = True
    tokens = mix64(parts[full])
    owner = doc[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for k, i in enumerate(short):
            acc = 0
            for x in h[first[i]:first[i + 1]]:
                acc = (acc * 0x165667B19E3779F9 + int(x)) & 0xFFFFFFFFFFFFFFFF
            own[k] = acc ^ int(counts[i])
        tokens = np.concatenate([tokens, mix64(own)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order], owner[order]
    sizes = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n):
        tokens[bounds[i]:bounds[i + 1]].sort()
    keep = np.ones(len(tokens), bool)
    if len(tokens):
        keep[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[keep], minlength=n) if len(owner) else sizes
    return tokens[keep], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of each range values[bounds[i]:bounds[i+1]]."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def minima_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least value of each range; the largest 64-bit value for an empty one."""
    out = np.full(len(bounds) - 1, np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.minimum.reduceat(values, bounds[some])
    return out
