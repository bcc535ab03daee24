"""Encoding of whole texts with the tokenizers library, one call per distinct piece of text.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so the ids of the text are those of its
pieces in a row.  Pieces repeat very often; each worker keeps the ids of the pieces it has met, looked up by
64-bit hash, and encodes only new ones.  The vocabulary file's path is a parameter and must exist on every
executor."""

from __future__ import annotations

import os

import numpy as np

from codedelta.llm import textnp

#: Pieces that a worker remembers; beyond, it starts again.
REMEMBERED = 1 << 20
_SEPARATOR = "\x01"
_encoders: dict = {}


def forget() -> None:
    """Drop all encoders with the pieces that they remember."""
    _encoders.clear()


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """0 white space, 1 letters A-Z a-z, 2 other ASCII, 3 apostrophe and bar, 4 bytes of non-ASCII characters."""
    t = np.full(256, 2, np.int8)
    t[65:91] = t[97:123] = 1
    t[[39, 124]] = 3
    t[9:14] = t[32] = 0
    t[128:] = 4
    return t


def word_pieces(part: np.ndarray, edges: np.ndarray):
    """(starts, ends) for a tokenizer that drops white space and splits letters, digits and other signs.

    Cuts at ASCII white space and between an ASCII letter and an ASCII sign that is neither an apostrophe
    (contractions) nor a bar (special tokens)."""
    cls = _classes()[part]
    before = np.concatenate([[0], cls[:-1]]).astype(np.int8)
    first = (cls != 0) & ((before == 0) | ((before == 1) & (cls == 2)) | ((before == 2) & (cls == 1)))
    edges = edges[edges < len(part)]
    first[edges] |= cls[edges] != 0
    starts = np.flatnonzero(first)
    after = np.concatenate([cls[1:], [0]]).astype(np.int8)
    last = (cls != 0) & ((after == 0) | ((after == 1) & (cls == 2)) | ((after == 2) & (cls == 1)))
    ahead = edges[edges > 0] - 1
    last[ahead] |= cls[ahead] != 0
    return starts, np.flatnonzero(last) + 1


def spaced_pieces(part: np.ndarray, edges: np.ndarray):
    """(starts, ends) for a byte-level tokenizer that keeps white space with the word after it.

    Cuts before white space that follows an ASCII sign, and before a single space between a
    non-ASCII character and an ASCII sign; every byte belongs to a piece."""
    cls = _classes()[part]
    n = len(part)
    before = np.concatenate([[0], cls[:-1]]).astype(np.int8)
    after = np.concatenate([cls[1:], [0]]).astype(np.int8)
    signs = (before >= 1) & (before <= 3)
    first = (cls == 0) & (signs | ((before == 4) & (part == 32) & (after >= 1) & (after <= 3)))
    first[edges[edges < n]] = True
    starts = np.flatnonzero(first)
    return starts, np.concatenate([starts[1:], [n]]).astype(np.int64)


class PieceEncoder:
    """Ids of pieces of text, remembered by hash.  ``fold``: A-Z and a-z have the same ids."""

    def __init__(self, path: str, pieces, fold: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # Strings of special tokens in a text are ordinary text where every byte counts.
        self.tokenizer.encode_special_tokens = not fold
        self.pieces, self.fold = pieces, fold
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        mark = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and fold else None

    def _encode(self, texts: list[str]) -> list:
        """Ids of each text.  Where white space is dropped, many go in one call with a sign between them that
        none of them holds."""
        if self.mark is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list = []
        groups = [texts[i:i + 256] for i in range(0, len(texts), 256)]
        joined = [f" {_SEPARATOR} ".join(g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(g) - 1:
                out += [x.ids for x in self.tokenizer.encode_batch_fast(g, add_special_tokens=False)]
                continue
            ends = np.concatenate([cut, [len(ids)]])
            begins = np.concatenate([[0], cut + 1])
            out += [ids[b:e] for b, e in zip(begins, ends)]
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.known) + len(hashes) > REMEMBERED:
            self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
            self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        ids = self._encode(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if len(ids) else np.empty(0, np.uint32)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        place = len(self.starts) + np.arange(len(ids))
        self.flat = np.concatenate([self.flat, flat])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        known, place = np.concatenate([self.known, hashes]), np.concatenate([self.place, place])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, bounds): ids of text i in ids[bounds[i]:bounds[i+1]]."""
        n = len(offsets) - 1
        lo, hi = int(offsets[0]), int(offsets[-1])
        part, rel = data[lo:hi], offsets - lo
        if hi == lo:
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        starts, ends = self.pieces(part, rel[:-1])
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        hashes = textnp.span_hashes(part, starts, ends, self.fold)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
            new = np.ones(len(distinct), bool) if not len(self.known) else self.known[at] != distinct
            if not new.any():
                break
            rows = first[new]
            if len(rows) > REMEMBERED or (len(self.known) + len(rows) > REMEMBERED):
                rows, new = first, np.ones(len(distinct), bool)
            blob = part.tobytes()
            self._learn(distinct[new], [blob[s:e].decode("utf-8", "replace") for s, e in zip(starts[rows].tolist(), ends[rows].tolist())])
        place = self.place[np.searchsorted(self.known, distinct)][which]
        sizes, begin = self.sizes[place], self.starts[place]
        total = np.cumsum(sizes)
        ids = self.flat[np.repeat(begin - (total - sizes), sizes) + np.arange(int(total[-1]))]
        of_text = np.searchsorted(starts, rel)     # first piece of each text
        return ids, np.concatenate([[0], total])[of_text]


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; kind: ``words`` (white space dropped, lower case) or ``bytes``."""
    key = (path, kind)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, word_pieces if kind == "words" else spaced_pieces, kind == "words")
    return _encoders[key]
