"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A text is the set of its distinct k-word shingles (64-bit hashes); texts with the same set are one class (a 64-bit digest of
the set). Under one order of all shingles, rarest first, two sets with Jaccard similarity t or more share at least l of the
first n - ceil(t n) + l shingles of each. Each class chooses the l (1 to ``longest``) whose prefix is cheapest, by the
postings it adds and the candidates it is expected to meet, and a pair needs the smaller l of the two in common.

Nothing enumerates the pairs of a large group:

1. Classes that share a prefix shingle are first compared with a leader of its bucket; verified links contract to components.
2. Only components, not members, then meet in the buckets, and only in buckets that hold several: first each with the
   largest one of the bucket, which gathers what is left of large groups. What then still shares a bucket with few others
   meets pair by pair; the buckets that many components share are dealt into blocks, which meet block by block.

Wherever two blocks meet, their members are compared by counting over an inverted index, and what comes out is at most one
link for each component that joins another there: no table of pairs is made of a crowded bucket. Step 2 compares every
pair of classes that can link (by size and by the number of shared prefix shingles) and that nothing has joined yet, so
that no link between components is lost.

Frequencies only order the shingles and steer the choice of l; any values give the same result. They are counted in
all texts, within each task first, where single occurrences are left out.

Text null or without words: an empty set, linked with nothing. Fewer than k words: the whole sequence is one shingle.
Repeated rows are classmates. Null doc_id: takes part, and the component takes its smallest non-null id (null if it has none).
Very long texts are read whole. Equally frequent shingles are ordered by their hashes. Empty table: empty result. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, ship
from .graph import components, merged
from .text import Lookup, mix, shingle_sets, slices

U64 = np.uint64
LONGEST, LEADERS, SALTED, BLOCK_TOKENS, FREQUENT, CROWD, COUNTED = 6, 2, 2000, 200_000, 2_000_000, 40, 4096


def set_digest(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A digest of each set of hashes; 0 for an empty one."""
    n = np.diff(bounds)
    c = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x6A09E667F3BCC909)), dtype=U64)])
    d = mix((c[bounds[1:]] - c[bounds[:-1]]) ^ mix(n.astype(U64)))
    return np.where(n > 0, d, U64(0)).view(np.int64)


def _required(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def scan(docs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, digest and the ``keep`` columns of every row (kind 0), and shingle, count of shingles seen twice in a task (kind 1: digest, n)."""
    # what is kept of the two columns that are read anyway is not sent to Python twice
    own = docs.select("doc_id", "text", *(F.col(c).alias(f"keep_{c}") for c in keep if c not in ("doc_id", "text")))
    source = {f"keep_{c}": c if c in ("doc_id", "text") else f"keep_{c}" for c in keep}
    fields = [(f, own.schema[c].dataType.simpleString()) for f, c in source.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        types: list = []

        def made(kind: int, doc: pa.Array, digest: np.ndarray, n: np.ndarray, kept: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(digest), kind, np.int32)), doc, pa.array(digest), pa.array(n, pa.int64()), *kept], names=["kind", "doc_id", "digest", "n", *(f for f, _ in fields)])

        def counted() -> tuple[np.ndarray, np.ndarray]:
            u, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return u, np.bincount(back, np.concatenate([x[1] for x in held])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            u, n = counted()
            often = n > 1
            if often.any():
                m = int(often.sum())
                yield made(1, pa.nulls(m, pa.int64()), u[often].view(np.int64), n[often], [pa.nulls(m, t) for t in types])

        for b in slices(batches):
            h, bounds = shingle_sets(b.column("text"), k)
            d = set_digest(h, bounds)
            types = [b.column(source[f]).type for f, _ in fields]
            yield made(0, b.column("doc_id"), d, np.diff(bounds), [b.column(source[f]) for f, _ in fields])
            _, first = np.unique(d, return_index=True)  # copies count once a slice
            new = np.zeros(len(d), bool)
            new[first] = True
            u, n = np.unique(h[np.repeat(new, np.diff(bounds))], return_counts=True)
            held.append((u, n))
            size += len(u)
            if size > 2 * kept + 1_000_000:
                held = [counted()]
                size = kept = len(held[0][0])
                if size > 4_000_000:  # bounds a task's memory
                    yield from flush()
                    held, size, kept = [], 0, 0
        if held:
            yield from flush()

    return own.mapInArrow(run, ", ".join(["kind int, doc_id long, digest long, n long", *(f"`{f}` {t}" for f, t in fields)]))


def frequent(scanned: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (at most ``most``), ascending, and their counts."""
    counts = materialise(scanned.where("kind = 1").groupBy("digest").agg(F.sum("n").alias("n")).where("n >= 3"))
    scale = F.least(F.col("n"), F.lit(500) + F.floor(20 * F.log2("n"))).cast("long")
    steps = counts.groupBy(scale.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("s")).collect()
    total, least = 0, None
    for r in steps:
        total += r["c"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        discard(counts)
        return np.zeros(0, U64), np.zeros(0, np.int64)
    top = counts.where(F.col("n") >= int(least)).toArrow()
    h, n = top.column("digest").to_numpy().view(U64), top.column("n").to_numpy()
    discard(counts)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(h: np.ndarray, bounds: np.ndarray, often: tuple[Lookup, np.ndarray], percent: int, longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """Of each set: its chosen l; and of all prefixes the shingles, their frequencies, sets, and how many of the prefix follow."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    freq = np.ones(len(h), np.int64)
    at = often[0].find(h)
    freq[at >= 0] = np.maximum(often[1][at[at >= 0]], 2)
    order = np.lexsort((h, freq, text))
    h, freq = h[order], freq[order]
    cum = np.concatenate([[0], np.cumsum(freq)])
    spare = n - _required(n, percent)
    verify = 8 + n / 32  # what comparing one candidate costs, in postings
    best, ell = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in range(1, longest + 1):
        size = np.minimum(spare + k, n)
        postings = cum[bounds[:-1] + size] - cum[bounds[:-1]]
        # sharing k of the prefix's shingles: at most the postings of others over k
        cost = postings + 2 * size + verify * (postings - size) / k
        better = (cost < best) & (k <= np.maximum(_required(n, percent), 1))
        best[better], ell[better] = cost[better], k
    size = np.minimum(spare + ell, n) * (n > 0)
    follow = size[text] - 1 - (np.arange(len(h)) - bounds[:-1][text])
    keep = follow >= 0
    return ell, h[keep], freq[keep], text[keep], follow[keep]


def postings(docs: DataFrame, k: int, often, percent: int, salted: int = SALTED) -> DataFrame:
    """shingle, salt, digest, l, n, follow: the prefix of each distinct set (repeated only across slices); salt 0: a bucket that is not split."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(often)  # at most FREQUENT shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Lookup(shared.value[0]), shared.value[1]
        for b in slices(batches):
            h, bounds = shingle_sets(b.column("text"), k)
            d = set_digest(h, bounds)
            _, first = np.unique(d, return_index=True)
            new = np.zeros(len(d), bool)
            new[first] = True
            new &= d != 0
            n = np.diff(bounds)
            h = h[np.repeat(new, n)]
            d, n = d[new], n[new]
            ell, token, freq, text, follow = prefixes(h, np.concatenate([[0], np.cumsum(n)]), counts, percent)
            own = d[text]
            # the buckets of very frequent shingles are split
            parts = np.maximum(1, freq // salted)
            salt = np.where(parts > 1, 1 + (mix(own.view(U64)) % parts.astype(U64)).astype(np.int32), 0).astype(np.int32)
            # what a text's rows have in common stands together, which packs well
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(follow, pa.int32()), pa.array(salt), pa.array(own), pa.array(ell[text], pa.int32()), pa.array(n[text], pa.int32())], names=["shingle", "follow", "salt", "digest", "l", "n"])

    return docs.mapInArrow(run, "shingle long, follow int, salt int, digest long, l int, n int")


def shared_postings(rows: DataFrame) -> DataFrame:
    """The postings of buckets with at least two classes, or split ones (salt above 0), once each, with the leader of the bucket."""
    dealt = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first row of a bucket waits until a second class shows up
        key, lead, last, waiting = None, (0, 0, 0), None, None
        for b in batches:
            if not b.num_rows:
                continue
            s, salt, d = (b.column(c).to_numpy() for c in ("shingle", "salt", "digest"))
            l_, n, follow = (b.column(c).to_numpy() for c in ("l", "n", "follow"))
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])
            carried = key == (int(s[0]), int(salt[0]))
            if carried:
                fresh[0] = False
            new = fresh.copy()
            new[1:] |= d[1:] != d[:-1]
            if carried:
                new[0] = int(d[0]) != last
            begin = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1  # -1: the carried bucket
            leaders = [np.append(x[begin], y if carried else 0)[group] for x, y in zip((d, l_, n), lead, strict=True)]
            members = np.bincount(group[new] + 1, minlength=len(begin) + 1)
            keep = new & (members[group + 1] > 1)
            if carried:
                keep |= new & (group == -1)
            keep |= new & (salt > 0)
            out = [s[keep], d[keep], l_[keep], n[keep], follow[keep], *(x[keep] for x in leaders)]
            if waiting is not None and carried and members[0] > 0:
                out = [np.append(x, y) for x, y in zip(out, waiting, strict=True)]
                waiting = None
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["shingle", "digest", "l", "n", "follow", "leader", "leader_l", "leader_n"])
            # what the next batch continues
            if len(begin):
                at = begin[-1]
                alone = members[group[at] + 1] == 1 and salt[at] == 0
                waiting = (s[at], d[at], l_[at], n[at], follow[at], d[at], l_[at], n[at]) if alone else None
                lead = int(d[at]), int(l_[at]), int(n[at])
            key, last = (int(s[-1]), int(salt[-1])), int(d[-1])

    return dealt.mapInArrow(run, "shingle long, digest long, l long, n long, follow long, leader long, leader_l long, leader_n long")


def may_link(least: str, most: str, l1: str, least2: str, most2: str, l2: str, percent: int):
    """Whether sets of these sizes can reach the similarity."""
    return (100 * F.col(most) >= percent * F.col(least2)) & (100 * F.col(most2) >= percent * F.col(least))


def needed(least: str, most: str, l1: str, least2: str, most2: str, l2: str, percent: int):
    """How many prefix shingles a linked pair of such sizes shares at least.

    A shared shingle outside both prefixes' intersection lies behind the prefix that ends first, which leaves at most
    ceil(t n) - l places; so the overlap that the similarity asks for, less those, must lie in the prefixes.
    """
    low = F.least(F.col(l1), F.col(l2))
    overlap = F.ceil(percent * (F.col(least) + F.col(least2)) / (100 + percent))
    behind = F.greatest(F.ceil(percent * F.col(most) / 100), F.ceil(percent * F.col(most2) / 100)) - low
    return F.greatest(low, overlap - behind)


def compare(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: labels of components that a link joins, between a class of ``left`` and one of ``right`` (bucket, block, digest, label) in the same bucket and block.

    At most one row for each component that becomes part of another in its block. A block's left sets are held in memory as
    an inverted index (their size is bounded by whoever makes the blocks), the right ones stream past.
    """
    put = lambda df, side: df.select("bucket", "block", F.lit(side).alias("side"), "digest", "label").hint("merge").join(sets, "digest")
    dealt = put(left, 0).unionByName(put(right, 1)).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for b in batches:
            out: tuple[list, list] = ([], [])
            buckets, blocks, sides, labels = (b.column(c).to_pylist() for c in ("bucket", "block", "side", "label"))
            raw = b.column("shingles")
            for i, side in enumerate(sides):
                if (buckets[i], blocks[i]) != key:
                    key, block = (buckets[i], blocks[i]), Block(percent)
                own = np.frombuffer(raw[i].as_buffer(), U64)
                if side == 0:
                    block.add(own, labels[i])
                else:
                    for x in block.joined(own, labels[i]):
                        out[0].append(x)
                        out[1].append(labels[i])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


class Block:
    """Sets of shingles with the labels of their components, as an inverted index; remembers which components have become one."""

    def __init__(self, percent: int):
        self.percent, self.held, self.label, self.index, self.one = percent, [], [], None, {}

    def add(self, own: np.ndarray, label: int) -> None:
        self.held.append(own)
        self.label.append(label)

    def root(self, label: int) -> int:
        while label in self.one:
            label = self.one[label]
        return label

    def joined(self, own: np.ndarray, label: int) -> list[int]:
        """Labels of the components that a link joins to the one of ``own``, those that were one already left out."""
        if not self.held:
            return []
        if self.index is None:
            self.sizes = np.array([len(x) for x in self.held])
            tokens = np.concatenate(self.held)
            order = np.argsort(tokens, kind="stable")
            self.index = tokens[order], np.repeat(np.arange(len(self.held)), self.sizes)[order]
            self.roots = np.array(self.label, np.int64)
        at = self.root(label)
        if (self.roots == at).all():
            return []
        tokens, owner = self.index
        lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        m = hi - lo
        inter = np.bincount(owner[np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=len(self.sizes))
        alike = 100 * inter >= self.percent * (self.sizes + len(own) - inter)
        found = np.unique(self.roots[alike & (self.roots != at)])
        if len(found):
            self.roots[np.isin(self.roots, found)] = at
            self.one.update(dict.fromkeys(found.tolist(), at))
        return found.tolist()


def fetch_sets(docs: DataFrame, scanned: DataFrame, digests: DataFrame, k: int) -> DataFrame:
    """digest, shingles (ascending 64-bit hashes) of classes, made anew from one text each."""
    first = scanned.where("kind = 0 and n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    some = digests.select("digest").distinct().hint("merge").join(first, "digest").select(F.col("doc_id").alias("_id"))
    # null ids meet here too
    texts = docs.hint("merge").join(some, docs["doc_id"].eqNullSafe(some["_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, None] = {}  # repeated rows stand close together, as they have one id
        for b in slices(batches):
            h, bounds = shingle_sets(b.column("text"), k)
            d = set_digest(h, bounds).tolist()
            new = [i for i, x in enumerate(d) if x not in recent and not recent.update({x: None})]
            raw = pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in new], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for i in new], pa.int64()), raw], names=["digest", "shingles"])
            if len(recent) > 10_000:
                recent = dict.fromkeys(d)

    return texts.mapInArrow(run, "digest long, shingles binary")


def link_classes(docs: DataFrame, scanned: DataFrame, often, k: int, percent: int, salted: int = SALTED) -> DataFrame:
    """node, label: the components of linked classes (those with a link only)."""
    shared = materialise(shared_postings(postings(docs, k, often, percent, salted)))

    # 1: against a few leaders
    met = shared.where("digest <> leader").groupBy("digest", "leader").agg(F.count("*").alias("common"), *(F.first(c).alias(c) for c in ("l", "n", "leader_l", "leader_n")))
    met = met.where(may_link("n", "n", "l", "leader_n", "leader_n", "leader_l", percent) & (F.col("common") >= needed("n", "n", "l", "leader_n", "leader_n", "leader_l", percent)))
    best = F.slice(F.sort_array(F.collect_list(F.struct("common", "leader")), False), 1, LEADERS)
    near = met.groupBy("digest").agg(best.alias("leaders"))
    pairs = near.select("digest", F.explode("leaders.leader").alias("bucket")).withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(16)).cast("long"))
    pairs = materialise(pairs.withColumn("label", F.col("digest")))
    leaders = pairs.select("bucket", "block").distinct().withColumn("digest", F.col("bucket")).withColumn("label", F.col("bucket"))
    sets = materialise(fetch_sets(docs, scanned, pairs.select("digest").union(pairs.select("bucket")), k))
    links = materialise(compare(leaders, pairs, sets, percent))
    labels = components(links)
    for df in (pairs, sets, links):
        discard(df)

    # 2: components that meet in buckets: first with the largest one of each, then what is left
    held = labelled(shared, labels)
    met = materialise(meetings(held))
    done = materialise(with_largest(met, percent))
    members = materialise(held.groupBy("label", "digest").agg(F.max("n").alias("n")))
    before, labels = labels, merged(labels, links_between(docs, scanned, done, members, k, percent))
    for df in (held, met, members):
        discard(df)

    held = labelled(shared, labels)
    met = materialise(meetings(held))
    crowded = materialise(met.groupBy("shingle").agg(F.count("*").alias("labels"), F.min("label").alias("leader")).where(F.col("labels") >= CROWD).select("shingle", "leader"))
    both = with_every_other(met, crowded, percent)
    both = materialise(both.hint("merge").join(compared_whole(done, before, labels), ["x", "y"], "left_anti"))
    members = materialise(held.groupBy("label", "digest").agg(F.max("n").alias("n")))
    between, within = links_between(docs, scanned, both, members, k, percent), links_within(docs, scanned, held, crowded, k, percent)
    labels = merged(labels, between.union(within))
    for df in (shared, held, met, members, crowded, both, done, between, within):
        discard(df)
    return labels


def labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of ``shared``, each with the component of its class (label), its own one as long as it has no link."""
    of = labels.select(F.col("node").alias("digest"), "label")
    rows = shared.select("shingle", "digest", "l", "n", "follow").distinct().hint("merge").join(of, "digest", "left")
    return materialise(rows.withColumn("label", F.coalesce("label", "digest")))


def compared_whole(done: DataFrame, before: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs x, y of ``done`` whose labels stand for the same classes in ``labels`` as in ``before``.

    A label is the smallest class of its component, so one that still stands can have grown only; it has if any of its classes
    had another label, or none, before.
    """
    grown = labels.hint("merge").join(before, ["node", "label"], "left_anti").select("label").distinct()
    for side in ("x", "y"):
        done = done.hint("merge").join(grown.withColumnRenamed("label", side), side, "left_anti")
    return done.select("x", "y")


def meetings(held: DataFrame) -> DataFrame:
    """shingle, label, l, least, most, follow, members: the components in each bucket that holds several, with their bounds."""
    mixed = held.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle")
    return held.hint("merge").join(mixed, "shingle").groupBy("shingle", "label").agg(F.min("l").alias("l"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("follow").alias("follow"), F.count("*").alias("members"))


_BOUNDS = ("label", "l", "least", "most")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """x < y: components that share as many prefix shingles as a link between them needs."""
    rows = rows.where(may_link("least", "most", "l", "least2", "most2", "l2", percent))
    x, y = F.least("label", "label2").alias("x"), F.greatest("label", "label2").alias("y")
    sums = rows.groupBy("label", "label2").agg(F.count("*").alias("common"), *(F.min(c).alias(c) for c in ("least", "l", "least2", "l2")), *(F.max(c).alias(c) for c in ("most", "most2")))
    # a pair can come in both orders when the largest component differs from bucket to bucket
    sums = sums.groupBy(x, y).agg(F.sum("common").alias("common"), F.min(F.least("least", "least2")).alias("least"), F.min(F.least("l", "l2")).alias("l"), F.max(F.greatest("most", "most2")).alias("most"), F.max("least").alias("a1"), F.max("least2").alias("a2"), F.count("*").alias("orders"), F.min("most").alias("b1"), F.min("most2").alias("b2"))
    exact = sums.where("orders = 1").select("x", "y", "common", F.col("a1").alias("least"), "l", F.col("b1").alias("most"), F.col("a2").alias("least2"), F.col("l").alias("l2"), F.col("b2").alias("most2"))
    loose = sums.where("orders > 1").select("x", "y", "common", "least", "l", "most", F.col("least").alias("least2"), F.col("l").alias("l2"), F.col("most").alias("most2"))
    return exact.unionByName(loose).where(F.col("common") >= needed("least", "most", "l", "least2", "most2", "l2", percent)).select("x", "y")


def with_largest(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of each component and the one with the most members in a bucket: as many rows as there are meetings."""
    top = met.groupBy("shingle").agg(F.max(F.struct("members", *_BOUNDS)).alias("t")).select("shingle", *(F.col(f"t.{c}").alias(f"{c}2") for c in _BOUNDS))
    return _pairs(met.hint("merge").join(top, "shingle").where("label <> label2"), percent)


def with_every_other(met: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """All pairs of components that share a bucket which is not ``crowded`` (so less than CROWD a posting) and can hold a link.

    A linked pair shares at least ``needed`` prefix shingles, and the first of them is followed by the others in both
    prefixes; so only shingles with that many followers on both sides need to bring a pair together.
    """
    one = met.hint("merge").join(crowded, "shingle", "left_anti").select("shingle", "follow", *_BOUNDS)
    other = one.toDF("shingle", "follow2", *(f"{c}2" for c in _BOUNDS))
    sizes = ("least", "most", "l", "least2", "most2", "l2", percent)
    first = (F.least("follow", "follow2") + 1 >= needed(*sizes)) & may_link(*sizes)
    on = (one["shingle"] == other["shingle"]) & (F.col("label") < F.col("label2")) & first
    pairs = materialise(one.hint("merge").join(other, on).select(F.col("label").alias("x"), F.col("label2").alias("y")).distinct())
    # then all that these pairs share is counted, a row a pair; components of many shingles go without
    own = met.groupBy("label").agg(F.min("l").alias("l"), F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n"))
    few = own.where(F.col("n") <= COUNTED).select("label")
    held = met.select("label", "shingle").hint("merge").join(few, "label").groupBy("label").agg(F.collect_list("shingle").alias("shingles"))
    known = materialise(own.drop("n").hint("merge").join(held, "label", "left").select(*_BOUNDS, "shingles"))
    told = pairs.toDF("label", "label2").hint("merge").join(known, "label").hint("merge").join(known.toDF(*(f"{c}2" for c in (*_BOUNDS, "shingles"))), "label2")
    enough = F.size(F.array_intersect("shingles", "shingles2")) >= needed(*sizes)
    uncounted = F.col("shingles").isNull() | F.col("shingles2").isNull()
    out = materialise(told.where(F.when(uncounted, True).otherwise(enough)).select(F.col("label").alias("x"), F.col("label2").alias("y")))
    for df in (known, pairs):
        discard(df)
    return out


def links_within(docs: DataFrame, scanned: DataFrame, held: DataFrame, crowded: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that share a crowded bucket (shingle, leader: its smallest label).

    The classes of all crowded buckets with the same leader meet as one group, as these hold much the same classes. A group
    is dealt into blocks of about BLOCK_TOKENS shingles: components larger than that have blocks of their own, the others
    are dealt by label. Every block meets itself and each other one, but not those of the same large component.
    """
    group = materialise(held.hint("merge").join(crowded, "shingle").groupBy("leader", "label", "digest").agg(F.max("n").alias("n")))
    sizes = group.groupBy("leader", "label").agg(F.sum("n").alias("size"))
    large = F.col("size") > BLOCK_TOKENS
    rest = sizes.where(~large).groupBy("leader").agg(F.ceil(F.sum("size") / BLOCK_TOKENS).alias("parts"))
    named = sizes.hint("merge").join(rest, "leader", "left").select("leader", "label", F.when(large, F.col("label")).alias("owner"), F.when(large, F.ceil(F.col("size") / BLOCK_TOKENS)).otherwise(F.col("parts")).alias("parts"))
    part = F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("digest")), F.col("parts"))
    dealt = materialise(group.hint("merge").join(named, ["leader", "label"]).select("leader", "label", "digest", F.xxhash64("leader", F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), part).alias("part"), "owner"))
    parts = dealt.groupBy("leader", "part").agg(F.first("owner").alias("owner"))
    other = parts.toDF("leader", "part2", "owner2")
    cells = parts.hint("merge").join(other, "leader").where("part <= part2 and not coalesce(owner = owner2, false)")
    cells = materialise(cells.select(F.col("leader").alias("bucket"), F.xxhash64("part", "part2").alias("block"), "part", "part2"))
    at = lambda side: cells.hint("merge").join(dealt, (cells["bucket"] == dealt["leader"]) & (cells[side] == dealt["part"])).select("bucket", "block", "digest", "label")
    sets = materialise(fetch_sets(docs, scanned, dealt.select("digest"), k))
    out = materialise(compare(at("part"), at("part2"), sets, percent))
    for df in (group, dealt, cells, sets):
        discard(df)
    return out


def links_between(docs: DataFrame, scanned: DataFrame, both: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of each pair of components: the members of the one with fewer shingles stream past the other's.

    Both sides are dealt into blocks of about BLOCK_TOKENS shingles, every block of one side meeting every one of the other.
    """
    sizes = members.groupBy("label").agg(F.sum("n").alias("size"))
    sized = both.hint("merge").join(sizes.select(F.col("label").alias("x"), F.col("size").alias("size1")), "x").hint("merge").join(sizes.select(F.col("label").alias("y"), F.col("size").alias("size2")), "y")
    swap = F.col("size2") > F.col("size1")
    sized = materialise(sized.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("bucket"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("small"), F.least("size1", "size2").alias("size"), F.ceil(F.greatest("size1", "size2") / BLOCK_TOKENS).cast("int").alias("rows")))
    grid = materialise(sized.groupBy("bucket").agg(F.max("rows").alias("rows"), F.ceil(F.sum("size") / BLOCK_TOKENS).cast("int").alias("columns")))
    row, column = F.pmod(F.xxhash64("digest"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("digest"), F.col("columns")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = (F.col("row") * F.col("columns") + F.col("column")).cast("long").alias("block")
    left = grid.hint("merge").join(members, grid["bucket"] == members["label"]).select("bucket", "columns", row.alias("row"), all_of("columns").alias("column"), "digest", "label")
    right = sized.select("bucket", "small").hint("merge").join(members, sized["small"] == members["label"]).select("bucket", "digest", "label").hint("merge").join(grid, "bucket").select("bucket", "columns", all_of("rows").alias("row"), column.alias("column"), "digest", "label")
    left, right = (materialise(x.select("bucket", cell, "digest", "label")) for x in (left, right))
    sets = materialise(fetch_sets(docs, scanned, left.select("digest").union(right.select("digest")), k))
    out = materialise(compare(left, right, sets, percent))
    for df in (sized, grid, left, right, sets):
        discard(df)
    return out


def _plain(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c not in ("doc_id", "text")))


def _named(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """digest, first (its smallest doc_id), label: all classes."""
    classes = scanned.where("kind = 0 and n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    return materialise(classes.hint("merge").join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "first", F.coalesce("label", "digest").alias("label")))


def join(docs: DataFrame, k: int = 5, percent: int = 75, salted: int = SALTED) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    docs = _plain(docs)
    scanned = materialise(scan(docs, k))
    named = _named(scanned, link_classes(docs, scanned, frequent(scanned), k, percent, salted))
    rows = scanned.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = named.hint("merge").join(lowest, "label").select("digest", "component_id")
    linked = rows.where("n_shingles > 0").hint("merge").join(of, "digest").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), k: int = 5, percent: int = 75) -> DataFrame:
    """The ``keep`` columns of one row of each component: of its rows with the smallest doc_id (null: only if no other has one) the smallest by set, then by the other columns.

    Rows without words are linked with nothing and all stay, repeated ones too.
    """
    ship(docs.sparkSession)
    docs = _plain(docs, keep)
    scanned = materialise(scan(docs, k, keep))
    named = _named(scanned, link_classes(docs, scanned, frequent(scanned), k, percent))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("b")).select(F.col("b.digest").alias("digest"), F.col("b.first").alias("first"))
    best = best.select("digest", F.coalesce("first", F.lit(0)).alias("_id"), F.col("first").isNull().alias("_none"))
    rows = scanned.where("kind = 0").withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull())
    row = F.struct(*(F.col(f"keep_{c}").alias(c) for c in keep))
    key = ["digest", "_id", "_none"]
    first = rows.where("n > 0").hint("merge").join(best, key, "left_semi").groupBy(*key).agg(F.min(row).alias("r"))
    return first.select("r.*").unionByName(rows.where("n = 0").select(row.alias("r")).select("r.*"))
