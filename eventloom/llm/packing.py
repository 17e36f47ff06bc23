"""Packing of token sequences into windows by non-negative least squares.

Each document's ids (its text's, then an end id) are cut into full windows and a rest. For the rests, combinations of two
or three lengths that fill a window exactly are the columns of a least-squares problem whose right-hand side is the
histogram of rest lengths; its non-negative solution, rounded down, says how often each combination is packed. What remains
is packed greedily, longest first, and cut at window borders, so that only the last window of a group is padded.

Everything happens in one pass over the input partition without a shuffle: rests are packed in groups of at most
``group_tokens`` tokens, which bounds a task's memory. Sequence ids hold the partition number and a counter, so that a
repeated task gives the same rows.

Null text: one piece, the end id. Empty table: empty result. Repeated rows are packed each, as are rows with equal or null
ids. Very long texts are encoded whole and cut. Further columns are ignored, whatever their names. Lengths that occur
equally often are taken in ascending order.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .text import slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_encoders: dict[str, object] = {}


def bpe_encoder(name: str = "byte_bpe_50k", end: str = "<|endoftext|>") -> Callable[[str], np.ndarray]:
    """text -> ids of the public byte-level BPE ``name``: the ids of its .json file by the tokenizers library, from the ranks file."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})
        _encoders[name] = enc
    enc = _encoders[name]
    return lambda text: np.asarray(enc.encode_to_numpy(text, allowed_special="all"), np.uint32)


def combinations(hist: np.ndarray, window: int, most: int = 6000, frequent_lengths: int = 160) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths in the histogram that fill the window.

    Of the triples at most about ``most``, those of frequent lengths first, two of their lengths among the ``frequent_lengths``
    most frequent; this bounds the columns of the least-squares problem, what they leave is packed greedily.
    """
    have = np.flatnonzero(hist)
    out: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in have if 2 * a <= window and hist[window - a]]
    frequent = have[np.argsort(-hist[have], kind="stable")][:frequent_lengths]
    triples: set[tuple[int, ...]] = set()
    for i, a in enumerate(frequent):
        for b in frequent[i:]:
            c = window - a - b
            if c > 0 and hist[c]:
                triples.add(tuple(sorted((int(a), int(b), int(c)))))
        if len(triples) >= most:
            break
    return out + sorted(triples)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """x >= 0 with least |A x - target|, by cyclic coordinate descent; column j has the lengths columns[j]."""
    rest, x = target.astype(float).tolist(), [0.0] * len(columns)
    parts = []
    for c in columns:
        count: dict[int, int] = {}
        for v in c:
            count[v] = count.get(v, 0) + 1
        parts.append((list(count.items()), sum(k * k for k in count.values())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (items, norm) in enumerate(parts):
            step = sum(k * rest[v] for v, k in items) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for v, k in items:
                    rest[v] -= k * step
        if moved < 0.01 * max(1.0, float(target.sum())) / 100:
            break
    return np.array(x)


def plan(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Items (indices into ``lengths``, all below ``window``) of each exactly filled window, and the items left over, longest first."""
    hist = np.bincount(lengths, minlength=window + 1)
    combos = combinations(hist, window)
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(window + 2))
    stock = {int(v): order[bounds[v] : bounds[v + 1]].tolist() for v in np.flatnonzero(hist)}
    filled: list[list[int]] = []
    if combos:
        x = np.floor(nnls(combos, hist) + 1e-9).astype(int)
        for j in np.argsort(-x, kind="stable"):
            need = combos[j]
            for _ in range(int(x[j])):
                taken: list[int] = []
                for v in need:
                    if not stock[v]:
                        break
                    taken.append(stock[v].pop())
                if len(taken) < len(need):
                    for i in taken:
                        stock[int(lengths[i])].append(i)
                    break
                filled.append(taken)
    left = [i for v in sorted(stock, reverse=True) for i in stock[v]]
    return filled, left


def _packer(encode: Callable[[str], np.ndarray], first_id: int, window: int, end_id: int, group_tokens: int):
    """A function (doc_id, text or None) -> rows, and one that gives the last rows."""
    at = [first_id]
    held: list[tuple] = []  # doc_id, start, ids, doc_tokens
    size = [0]

    def piece(doc_id, start, ids, total, seq, offset):
        return (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, offset)

    def flush() -> list[tuple]:
        rows: list[tuple] = []
        if held:
            filled, left = plan(np.array([len(h[2]) for h in held]), window)
            for items in filled:
                offset = 0
                for i in items:
                    d, s, ids, t = held[i]
                    rows.append(piece(d, s, ids, t, at[0], offset))
                    offset += len(ids)
                at[0] += 1
            offset = 0
            for i in left:
                d, s, ids, t = held[i]
                while len(ids):
                    part = ids[: window - offset]
                    rows.append(piece(d, s, part, t, at[0], offset))
                    s, ids, offset = s + len(part), ids[len(part) :], offset + len(part)
                    if offset == window:
                        at[0], offset = at[0] + 1, 0
            if offset:
                at[0] += 1
        held.clear()
        size[0] = 0
        return rows

    def add(doc_id, text) -> list[tuple]:
        ids = np.append(encode(text), np.uint32(end_id)) if text else np.array([end_id], np.uint32)
        full = len(ids) // window * window
        rows = []
        for s in range(0, full, window):
            rows.append(piece(doc_id, s, ids[s : s + window], len(ids), at[0], 0))
            at[0] += 1
        if full < len(ids):
            held.append((doc_id, full, ids[full:].copy(), len(ids)))
            size[0] += len(ids) - full
            if size[0] >= group_tokens:
                rows += flush()
        return rows

    return add, flush


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = 1024, end_id: int = 0, group_tokens: int = 8_000_000) -> DataFrame:
    """The pieces of every text of ``docs`` (doc_id, text), see ``SCHEMA``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = _packer(bpe_encoder(tokenizer), TaskContext.get().partitionId() << 36, window, end_id, group_tokens)
        schema = pa.schema([(c, pa.int64()) for c in COLUMNS])
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows += add(doc_id, text)
            if rows:
                yield out(rows)
        if rows := flush():
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
