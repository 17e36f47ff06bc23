"""Reversible line deduplication.

State: an exact reference table (one row for each distinct key a document holds: shard, key, doc_id), from which counts
follow, and one cuckoo filter a shard with the keys whose count reaches ``min_docs``. Inserting documents adds their
references, deleting documents takes them away, and the filters gain or lose the keys whose count crosses the bound, so
that any sequence of changes leaves what building from the remaining documents would give.

A document's references first meet the filter of their shard (dealt by shard and a salt, so that a frequent key does not
gather in one task); only those that may be hits are joined with the exact counts, which removes false positives. There
are as many shards as keep a filter at about ``KEYS`` keys, so that the task that fills one holds no more.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys under ``min_chars`` code
points are never dropped. Null text: one empty line. Repeated rows (same doc_id) count as one document, that of their id,
and are treated alike; null doc_id: its lines are kept and not counted. Empty table: empty result. Very long texts are
split whole, of a line that occurs twice in a text both go. Of the input's columns those in ``keep`` stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .text import slices

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, KEYS, SALTS = 40, 5, 100_000, 16
U64 = np.uint64


class CuckooFilter:
    """A cuckoo filter of 16-bit fingerprints in buckets of four; keys are 64-bit hashes.

    What finds no place waits in a stash, so no key is ever lost; ``full`` says that it is time to build a larger filter.
    """

    SLOTS = 4

    def __init__(self, capacity: int = 1024, table: np.ndarray | None = None, stash: list[int] | None = None):
        n = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.84))))
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table
        self.stash = stash or []  # (bucket << 16 | fingerprint) of what found no place

    @staticmethod
    def _spread(f):
        return (f.astype(U64) * U64(0x5BD1E9955BD1E995)) >> U64(20)

    def _places(self, keys: np.ndarray):
        keys = keys.astype(U64)
        mask = U64(len(self.table) - 1)
        f = ((keys >> U64(48)) % U64(65535) + U64(1)).astype(np.uint16)
        a = (keys & mask).astype(np.int64)
        b = ((keys ^ self._spread(f)) & mask).astype(np.int64)
        return f, a, b

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(np.asarray(keys))
        hit = (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)
        if self.stash:
            s = np.array(self.stash)
            hit |= np.isin((a << 16) | f, s) | np.isin((b << 16) | f, s)
        return hit

    def insert(self, keys: np.ndarray) -> None:
        for f, a, b in zip(*(x.tolist() for x in self._places(np.asarray(keys))), strict=True):
            at, mask = a, len(self.table) - 1
            for turn in range(200):
                for place in (at, b) if turn == 0 else (at,):
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = f
                        break
                else:
                    slot = (turn * 7 + f) % self.SLOTS
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at ^= int(self._spread(np.array([f], np.uint16))[0]) & mask
                    continue
                break
            else:
                self.stash.append((at << 16) | f)

    @property
    def full(self) -> bool:
        return len(self.stash) > 8 or int((self.table != 0).sum()) > 0.95 * self.table.size

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for f, a, b in zip(*(x.tolist() for x in self._places(np.asarray(keys))), strict=True):
            for place in (a, b):
                own = np.flatnonzero(self.table[place] == f)
                if len(own):
                    self.table[place, own[0]] = 0
                    break
                if (place << 16) | f in self.stash:
                    self.stash.remove((place << 16) | f)
                    break

    def to_bytes(self) -> bytes:
        return np.array([len(self.table), len(self.stash), *self.stash], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n, s = np.frombuffer(raw, np.int64, 2).tolist()
        stash = np.frombuffer(raw, np.int64, s, 16).tolist()
        return cls(table=np.frombuffer(raw, np.uint16, n * cls.SLOTS, 16 + 8 * s).reshape(n, cls.SLOTS).copy(), stash=stash)


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """The lines of a text as bytes, and each one's key as two 64-bit integers (None if too short to count)."""
    raw = (text or "").encode()
    lines = raw.split(b"\n")
    keys: list[tuple[int, int] | None] = []
    for line in lines:
        k = line.strip(BLANK)
        if len(k) < min_chars or (not k.isascii() and len(k.decode()) < min_chars):
            keys.append(None)
        else:
            d = hashlib.blake2b(k.lower(), digest_size=16).digest()
            keys.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return lines, keys


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key, key2 (a 128-bit hash), doc_id: one row for each distinct key of each row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k in dict.fromkeys(x for x in line_keys(text, min_chars)[1] if x):
                    out[0].append(k[0])
                    out[1].append(k[1])
                    out[2].append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "key2", "doc_id"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a repeated doc_id is one document
    return rows.mapInArrow(run, "key long, key2 long, doc_id long").distinct()


def live_keys(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, key2, last (the largest doc_id holding it) of the keys that at least min_docs documents hold."""
    rows = refs.groupBy("key", "key2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    return rows.where(F.col("n") >= min_docs).select("key", "key2", "last")


def shards_for(live: DataFrame, keys: int = KEYS) -> int:
    """As many shards as give each about ``keys`` of the live keys."""
    return max(1, -(-live.count() // keys))


def filters(live: DataFrame, shards: int) -> DataFrame:
    """shard, filter: a serialised cuckoo filter of each shard's live keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys = None, []
        for b in batches:
            s, k = b.column("shard").to_numpy(), b.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if s[a] != now and keys:
                    yield made(now, keys)
                    keys = []
                now = int(s[a])
                keys.append(k[a:z])
        if keys:
            yield made(now, keys)

    def made(shard: int, keys: list) -> pa.RecordBatch:
        keys = np.concatenate(keys).view(U64)
        f = CuckooFilter(len(keys))
        f.insert(keys)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.to_bytes()], pa.binary())], names=["shard", "filter"])

    by_shard = live.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key")
    return by_shard.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, filter binary")


def hits(refs: DataFrame, shard_filters: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """The references whose key the filter of its shard may hold."""
    probe = refs.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "key", "key2", "doc_id")
    put = shard_filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "filter", *(F.lit(None).cast("long").alias(c) for c in ("key", "key2", "doc_id")))
    both = probe.unionByName(put).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, table = None, None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            group = shard.astype(np.int64) << 20 | b.column("salt").to_numpy()
            keep = np.zeros(len(shard), bool)
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1])) + 1
            cuts = [0, *cuts.tolist(), len(shard)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if kind[a] == 0:
                    have, table = group[a], CuckooFilter.from_bytes(b.column("filter")[a].as_py())
                elif have == group[a]:
                    keep[a:z] = table.contains(b.column("key")[a:z].to_numpy().view(U64))
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("key", "key2", "doc_id")], names=["key", "key2", "doc_id"])

    return both.mapInArrow(run, "key long, key2 long, doc_id long")


def drops(refs: DataFrame, live: DataFrame, shard_filters: DataFrame, shards: int) -> DataFrame:
    """doc_id, keys: what each document loses (all live keys but those whose largest doc_id it is)."""
    exact = hits(refs, shard_filters, shards).hint("merge").join(live, ["key", "key2"]).where(F.col("doc_id") != F.col("last"))
    return exact.groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set("key2").alias("keys2"))


def apply_drops(docs: DataFrame, dropped: DataFrame, keep: tuple[str, ...], min_chars: int = MIN_CHARS) -> DataFrame:
    """The ``keep`` columns of every row, then n_lines, n_dropped and kept_text."""
    own = docs.select(*keep, F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    # always a merge join: the plan, and so its growth, is the same at every size
    both = own.hint("merge").join(dropped.withColumnRenamed("doc_id", "_drop_id"), F.col("_id") == F.col("_drop_id"), "left").drop("_id", "_drop_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            n, gone, kept = [], [], []
            for text, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("_text", "keys", "keys2")), strict=True):
                if not k1:
                    n.append((text or "").count("\n") + 1)
                    gone.append(0)
                    kept.append(text or "")
                    continue
                k1, k2 = set(k1), set(k2)
                lines, keys = line_keys(text, min_chars)
                left = [line for line, k in zip(lines, keys, strict=True) if not (k and k[0] in k1 and k[1] in k2)]
                n.append(len(lines))
                gone.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*keep, "n_lines", "n_dropped", "kept_text"])

    return both.mapInArrow(run, f"{fields}, n_lines long, n_dropped long, kept_text string")


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = KEYS) -> DataFrame:
    """Builds the state over ``docs`` and applies it to them."""
    return LineIndex.build(docs, min_chars, min_docs, shard_keys).apply(docs, keep)


class LineIndex:
    """References, live keys and filters of a corpus, as tables; ``insert`` and ``delete`` return a new index."""

    def __init__(self, refs: DataFrame, live: DataFrame, shard_filters: DataFrame, min_chars: int, min_docs: int, shards: int, shard_keys: int):
        self.refs, self.live, self.filters = refs, live, shard_filters
        self.min_chars, self.min_docs, self.shards, self.shard_keys = min_chars, min_docs, shards, shard_keys

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = KEYS) -> LineIndex:
        refs = materialise(references(docs, min_chars))
        return cls._of(refs, materialise(live_keys(refs, min_docs)), min_chars, min_docs, shard_keys)

    @classmethod
    def _of(cls, refs: DataFrame, live: DataFrame, min_chars: int, min_docs: int, shard_keys: int) -> LineIndex:
        shards = shards_for(live, shard_keys)
        return cls(refs, live, materialise(filters(live, shards)), min_chars, min_docs, shards, shard_keys)

    def _changed(self, refs: DataFrame) -> LineIndex:
        """Exact counts anew; each shard's filter loses and gains only the keys that crossed the bound. Filters that have become full are built anew, with more shards if need be."""
        live = materialise(live_keys(refs, self.min_docs))
        keys = ["key", "key2"]
        gone = self.live.select(*keys).exceptAll(live.select(*keys)).withColumn("sign", F.lit(-1))
        new = live.select(*keys).exceptAll(self.live.select(*keys)).withColumn("sign", F.lit(1))
        moves = gone.union(new).select(F.pmod("key", F.lit(self.shards)).cast("int").alias("shard"), "sign", "key")

        def run(key, state, change):
            import pandas as pd

            table = CuckooFilter.from_bytes(state["filter"].iloc[0]) if len(state) else CuckooFilter(len(change))
            if len(change):
                table.delete(change.loc[change["sign"] < 0, "key"].to_numpy().view(U64))
                table.insert(change.loc[change["sign"] > 0, "key"].to_numpy().view(U64))
            return pd.DataFrame({"shard": [int(key[0])], "filter": [table.to_bytes()], "full": [table.full]})

        made = materialise(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(run, "shard int, filter binary, full boolean"))
        if not made.where("full").isEmpty():
            return LineIndex._of(refs, live, self.min_chars, self.min_docs, self.shard_keys)
        return LineIndex(refs, live, made.drop("full"), self.min_chars, self.min_docs, self.shards, self.shard_keys)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Documents that the index holds already (by their id) gain the lines they didn't have."""
        return self._changed(materialise(self.refs.unionByName(references(docs, self.min_chars)).distinct()))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: a table with a doc_id column."""
        return self._changed(materialise(self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")))

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """n_lines, n_dropped and kept_text of rows whose references the index holds."""
        gone = materialise(drops(self.refs, self.live, self.filters, self.shards))
        return apply_drops(docs, gone, keep, self.min_chars)
