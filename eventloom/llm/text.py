"""Vectorised word and line helpers over batches of texts.

Texts are handled as UTF-8 bytes in one buffer per slice; the memory a slice needs is a fixed multiple of its bytes
(slices hold ``SLICE_BYTES``, or a single longer text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = U64(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), _STEP)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Gives freed memory back, as an idle Python worker stays beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


class Lookup:
    """Positions of 64-bit hashes in an ascending array of them, by a table over their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(U64)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = U64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 for what is not there."""
        h = h.view(U64)
        out = np.full(len(h), -1, np.int64)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):
            hit = self.keys[at] == h
            out[left[hit]] = at[hit]
            at += 1
            go = ~hit & (at < end)
            left, at, end, h = left[go], at[go], end[go], h[go]
        return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text of a column.

    ``start``, ``length``: byte spans in ``data``; ``doc``: the text each word is in; ``bounds``: n_docs + 1 positions in
    the word arrays; ``hash``: 64-bit hash of each word, of its ASCII-lower-cased form if ``lower``.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = data, offsets = buffers(column)
        n = len(offsets) - 1
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        first[cuts] |= word[cuts]
        self.start = np.flatnonzero(first)
        inside = np.flatnonzero(word)
        order = np.searchsorted(inside, self.start)
        self.length = np.diff(np.append(order, len(inside)))
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.bounds))
        if len(self.start):
            pos = np.arange(len(inside)) - np.repeat(order, self.length)
            v = (_BYTE_LOWER if lower else _BYTE)[data[inside]]
            v *= powers(int(self.length.max()))[pos]
            self.hash = mix(np.add.reduceat(v, order) ^ (self.length.astype(np.uint64) * _STEP))
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text, and the index of each one's first word."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += words.hash[at + j] * _SHINGLE[j]
    return mix(h), at


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, ascending within a text, and n_docs + 1 bounds.

    A text with 1 to k-1 words has one shingle, its whole word sequence.
    """
    w = Words(column, lower=True)
    h, at = windows(w, k)
    doc = w.doc[at]
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            s[has] += w.hash[w.bounds[short[has]] + j] * _SHINGLE[j]
        s = mix(s ^ mix(counts[short].astype(np.uint64)))
        h, doc = np.concatenate([h, s]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points between offsets of UTF-8 bytes."""
    c = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return c[offsets[1:]] - c[offsets[:-1]]
