"""Document fingerprints by content-defined chunking.

A gear hash over the last 8 bytes cuts a text where it matches a mask: a strict one before the normal chunk size, a loose
one after it (normalised chunking), so that chunk sizes gather around the normal one and cuts follow the content when text
shifts. A fingerprint is the set of chunk digests with the bytes each stands for, in hexadecimal: 12 digits of digest and 8 of
weight for each distinct chunk, ascending. Containment is the weight two fingerprints share over the smaller total.

Chunks of NORMAL bytes let texts of a sentence be compared; a whole fingerprint then has about 0.7 characters a byte of text. Where
that is too much, ``sketch`` keeps those ``most`` chunks whose digests are smallest, which any two texts choose alike.

Null text is empty; an empty text has an empty fingerprint, which is like another empty one (1) and unlike all others (0).
Very long texts are fingerprinted whole. Rows with equal ids are ordered by their texts, null ids come first, repeated rows
each get a row. Empty table: empty result. Of the input's columns those in ``keep`` stay (``compare``: the id), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .text import buffers, code_points, mix, powers, slices

U32, U64 = np.uint32, np.uint64
MIN, NORMAL, MAX = 8, 24, 96
_rng = np.random.Generator(np.random.PCG64(911))
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
STRICT, LOOSE = U32(0x3F << 6), U32(0x07 << 6)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 8 gear values, each shifted left by its age: by doubling, three passes."""
    h = _GEAR[data]
    for k in (1, 2, 4):
        h[k:] += h[:-k] << U32(k)
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The start of each chunk of each text; the shortest chunk is as long as the hash window, so texts don't touch each other."""
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = np.flatnonzero((h & STRICT) == 0)
    # next cut at or after each place, as look-ups
    ends = offsets.tolist()
    n = len(data)
    nxt = np.full(n + 1, n, np.int64)
    nxt[loose] = loose
    loose_at = np.minimum.accumulate(nxt[::-1])[::-1]
    nxt[:] = n
    nxt[strict] = strict
    strict_at = np.minimum.accumulate(nxt[::-1])[::-1]
    cut = _cuts(strict_at, loose_at, n)
    starts: list[int] = []
    for a, z in zip(ends, ends[1:], strict=False):
        while a < z:
            starts.append(a)
            a = cut[a]
    return np.array(starts, np.int64)


def _cuts(strict_at: np.ndarray, loose_at: np.ndarray, n: int) -> list[int]:
    """Where a chunk that starts at each place would end."""
    i = np.arange(n)
    early = strict_at[np.minimum(i + MIN - 1, n)] + 1
    late = loose_at[np.minimum(i + NORMAL - 1, n)] + 1
    return np.where(early < i + NORMAL, early, np.minimum(late, i + MAX)).tolist()


class Prints:
    """Fingerprints of the texts of a column: parallel arrays doc, digest, weight, sorted by both."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = data, offsets = buffers(column)
        self.n = len(offsets) - 1
        start = chunk_starts(data, offsets)
        doc = np.searchsorted(offsets, start, "right") - 1
        if len(start):
            size = np.minimum(np.append(start[1:], len(data)), offsets[doc + 1]) - start
            pos = np.arange(len(data)) - np.repeat(start, size)
            v = _BYTE[data]
            v *= powers(int(size.max()))[pos]
            digest = mix(np.add.reduceat(v, start) ^ mix(size.astype(U64))) >> U64(16)
            order = np.lexsort((digest, doc))
            doc, digest, size = doc[order], digest[order], size[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])))
            self.doc, self.digest, self.weight = doc[first], digest[first], np.add.reduceat(size, first)
        else:
            self.doc, self.digest, self.weight = (np.zeros(0, t) for t in (np.int64, U64, np.int64))
        self.bounds = np.searchsorted(self.doc, np.arange(self.n + 1))

    def strings(self) -> list[str]:
        raw = np.empty((len(self.doc), 10), np.uint8)
        raw[:, :6] = self.digest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        raw[:, 6:] = self.weight.astype(">u4").view(np.uint8).reshape(-1, 4)
        text, b = raw.tobytes().hex(), (self.bounds * 20).tolist()
        return [text[x:y] for x, y in zip(b, b[1:], strict=False)]


def likeness(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> np.ndarray:
    """Containment of text i[k] of ``a`` and j[k] of ``b``, for each k; i and j ascend."""
    out = np.zeros(len(i))
    pa_, pb_ = _rows(a.bounds, i), _rows(b.bounds, j)
    k = np.concatenate([np.repeat(np.arange(len(i)), a.bounds[i + 1] - a.bounds[i]), np.repeat(np.arange(len(j)), b.bounds[j + 1] - b.bounds[j])])
    digest, weight = np.concatenate([a.digest[pa_], b.digest[pb_]]), np.concatenate([a.weight[pa_], b.weight[pb_]])
    order = np.lexsort((digest, k))
    k, digest, weight = k[order], digest[order], weight[order]
    both = np.flatnonzero((k[1:] == k[:-1]) & (digest[1:] == digest[:-1]))
    np.add.at(out, k[both], np.minimum(weight[both], weight[both + 1]))
    least = np.minimum(a.offsets[i + 1] - a.offsets[i], b.offsets[j + 1] - b.offsets[j])
    empty = (a.offsets[i + 1] == a.offsets[i]) & (b.offsets[j + 1] == b.offsets[j])
    return np.where(empty, 1.0, np.clip(out / np.maximum(least, 1), 0, 1))


def _rows(bounds: np.ndarray, i: np.ndarray) -> np.ndarray:
    n = bounds[i + 1] - bounds[i]
    return np.arange(n.sum()) + np.repeat(bounds[i] - (np.cumsum(n) - n), n)


def contains(one: str, other: str) -> float:
    """Containment of two fingerprint strings."""
    read = lambda s: {s[i : i + 12]: int(s[i + 12 : i + 20], 16) for i in range(0, len(s), 20)}
    a, b = read(one), read(other)
    if not a or not b:
        return float(not a and not b)
    return min(1.0, sum(min(w, b[d]) for d, w in a.items() if d in b) / min(sum(a.values()), sum(b.values())))


def sketch(whole: str, most: int) -> str:
    """The chunks with the ``most`` smallest digests of a fingerprint."""
    return whole[: 20 * most]


def sketches_contain(one: str, other: str, most: int) -> float:
    """An estimate of the containment of two texts by their sketches of ``most`` chunks: over the digests up to which both are complete."""
    ends = [s[20 * most - 20 : 20 * most - 8] for s in (one, other) if len(s) >= 20 * most]
    if not ends:
        return contains(one, other)
    bound = min(ends)
    cut = lambda s: "".join(s[i : i + 20] for i in range(0, len(s), 20) if s[i : i + 12] <= bound)
    return contains(cut(one), cut(other))


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int | None = None) -> DataFrame:
    """The ``keep`` columns and the fingerprint of every text, or its sketch of ``most`` chunks."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([s if most is None else sketch(s, most) for s in Prints(b.column("_text")).strings()], pa.string())], names=[*keep, "fingerprint"])

    return rows.mapInArrow(run, f"{fields}, fingerprint string")


# ---- a document against its edited text and its successor ----


def edited(text: str, other: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + other[:q]


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, most_ranges: int = 50_000) -> DataFrame:
    """doc_id, text, bucket, last: all rows, dealt by ranges of doc_id and sorted, and after each range a copy of the next range's first row (last = 1).

    So a row's successor (ascending doc_id, then text; null doc_id first; after the last row the first one) always follows
    it in its partition, without a window over all rows. Only range borders and first ids come to the driver, one a range, of at most ``most_ranges``; beyond that
    the ranges get longer (they are sorted with spilling and streamed).
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = ids.count()
    n = min(most_ranges, max(1, -(-total // rows_per_bucket)))
    cut = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 and total else []
    cuts = np.unique(np.array([c for c in cut or [] if c is not None], np.int64))

    @F.pandas_udf("int")
    def range_of(s: pd.Series) -> pd.Series:
        # a null id goes before all others
        return pd.Series(np.where(s.isna(), 0, np.searchsorted(cuts, s.fillna(0).astype("int64"), "right")).astype("int32"))

    firsts = ids.select("doc_id", range_of("doc_id").alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("at")).orderBy("bucket").collect()
    dealt = rows.withColumn("bucket", range_of("doc_id")).withColumn("last", F.lit(0))
    if not firsts:
        return dealt
    spark = docs.sparkSession
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    wanted = spark.createDataFrame([(r["at"]["doc_id"], before[r["bucket"]]) for r in firsts], "_id long, bucket int")  # one row a range
    first = rows.join(F.broadcast(wanted), rows["doc_id"].eqNullSafe(wanted["_id"])).groupBy("doc_id", "bucket").agg(F.min("text").alias("text")).select("doc_id", "text", "bucket", F.lit(1).alias("last"))
    return dealt.unionByName(first).repartition("bucket").sortWithinPartitions("bucket", "last", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, its edited text's (the last quarter replaced by the next row's start), and their likeness; see ``SCHEMA``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the slice before, whose successor may be in this one
        for b in slices(batches):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            bucket, last = b.column("bucket").to_pylist(), b.column("last").to_pylist()
            if held:
                ids, texts, bucket, last = [held[0], *ids], [held[1], *texts], [held[2], *bucket], [held[3], *last]
            held = (ids[-1], texts[-1], bucket[-1], last[-1])
            i = np.array([k for k in range(len(ids) - 1) if not last[k]], np.int64)
            if not len(i):
                continue
            changed = [edited(texts[k], texts[k + 1]) for k in i]
            own, new = Prints(pa.array(texts, pa.string())), Prints(pa.array(changed, pa.string()))
            prints, j = own.strings(), np.arange(len(i))
            chars = code_points(own.data, own.offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in i], pa.int64()), pa.array(chars[i], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([prints[k] for k in i]), pa.array(new.strings(), pa.string()),
                    pa.array(likeness(own, i, new, j)), pa.array(likeness(own, i, own, i + 1)),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return with_next(docs).mapInArrow(run, SCHEMA)
