"""A hidden Markov language model.

Words (A-Z lower-cased) and one end token a text. Every word belongs to a class (a hash of its last bytes). A hidden state
emits a class, the class emits the word by its share of the class's training tokens: P(text) = P(class sequence) times the
product of P(word | class), where P(class sequence) is the exact likelihood of the hidden Markov chain, by the scaled
forward recursion. The recursion runs over fixed-length stretches of many texts at once: each stretch gives the matrix that
takes the state before it to the state after it, and a text's matrices are multiplied in order, which is exact.

Training is incremental Baum-Welch over all tokens of all training texts: the states start as random leanings of the class
shares of all texts; texts are dealt into ``PARTS`` by a hash, and the chain follows the sum of all parts' latest expected
counts (of starts, steps and emissions), a part being counted anew at each turn. Rounds over all parts go on until one gains
less than ``SETTLED`` of the log-likelihood (or ``rounds`` are over, if given). Fixed points are those of plain Baum-Welch.
Word counts cover all training texts. The most frequent words (at most ``head``) go to every task; a text's other words
are joined with the count table by hash, so that nothing that grows with the corpus is broadcast.

Null text is empty: only the end token. No training text: every token is unknown, all states are alike. Words are told apart
by 64-bit hashes. Repeated rows each count and get a row, as do rows with equal or null ids. Very long texts are read whole,
in stretches. Words equally frequent at the edge of the head are all in or all out. Empty table: empty result. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, ship
from .text import _LOWER, Lookup, Words, mix, slices

U64 = np.uint64
CLASSES, STATES, STRETCH, SLICE = 2048, 6, 128, 2 << 20
PARTS, SETTLED, SCALED = 8, 5e-4, 4
END, END_HASH = CLASSES, np.int64(0x5E4D)
HALF = 0.5


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token (each text's words, then its end), and n + 1 bounds."""
    w = Words(column, lower=True)
    n = len(w.bounds) - 1
    bounds = w.bounds + np.arange(n + 1)
    h, c = np.full(bounds[-1], END_HASH, np.int64), np.full(bounds[-1], END, np.int32)
    at = np.arange(len(w.hash)) + w.doc
    h[at] = w.hash.view(np.int64)
    if len(at):
        low, last = _LOWER[w.data], w.start + w.length - 1
        key = low[last].astype(U64)
        for k in (1, 2):
            key = key << U64(8) | np.where(w.length > k, low[last - np.minimum(k, w.length - 1)], 0).astype(U64)
        c[at] = (mix(key) % U64(CLASSES)).astype(np.int32)
    return h, c, bounds


@dataclass
class Chain:
    start: np.ndarray  # K
    step: np.ndarray  # K x K
    emit: np.ndarray  # (CLASSES + 1) x K, columns sum to 1

    @classmethod
    def from_counts(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Chain:
        start, step = start + 0.1, step + 0.1
        prior = emit.sum(1, keepdims=True) + 0.01
        emit = emit + 5.0 * prior / prior.sum()  # leans on the classes' own shares
        return cls(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class Stretches:
    """Stretches of at most ``STRETCH`` tokens of the texts between bounds, none empty."""

    def __init__(self, c: np.ndarray, bounds: np.ndarray):
        size = np.diff(bounds)
        self.per = -(-size // STRETCH)
        self.text = np.repeat(np.arange(len(size)), self.per)
        self.no = np.arange(len(self.text)) - np.repeat(np.cumsum(self.per) - self.per, self.per)
        begin = bounds[self.text] + self.no * STRETCH
        self.length = np.minimum(bounds[self.text + 1] - begin, STRETCH)
        # longest first, so that those still running are a prefix
        self.order = np.argsort(-self.length, kind="stable")
        self.begin, self.sorted_length = begin[self.order], self.length[self.order]
        self.first = self.no[self.order] == 0
        self.running = np.searchsorted(-self.sorted_length, -np.arange(1, STRETCH + 1), "right")
        self.c, self.texts = c, len(size)

    def steps(self) -> Iterator[tuple[int, int]]:
        for t in range(STRETCH):
            if not (n := int(self.running[t])):
                return
            yield t, n

    def matrices(self, m: Chain) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch (in text order) the normalised matrix and the logarithm of what was divided out."""
        k = len(m.start)
        a = np.broadcast_to(m.step, (len(self.begin), k, k)).copy()
        a[self.first] = np.eye(k)
        log = np.zeros(len(self.begin))
        for t, n in self.steps():
            em = m.emit[self.c[self.begin[:n] + t]]
            x = a[:n] if t == 0 else (a[:n].reshape(n * k, k) @ m.step).reshape(n, k, k)
            x *= em[:, None, :]
            if t:
                a[:n] = x
            if t % SCALED == SCALED - 1:
                s = x.sum((1, 2))
                a[:n] /= s[:, None, None]
                log[:n] += np.log(s)
        s = a.sum((1, 2))
        a /= s[:, None, None]
        log += np.log(s)
        out, l2 = np.empty_like(a), np.empty_like(log)
        out[self.order], l2[self.order] = a, log
        return out, l2

    def forward(self, m: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log-likelihood of each text, the state before each stretch, and the matrices."""
        mats, log = self.matrices(m)
        like = np.zeros(self.texts)
        np.add.at(like, self.text, log)
        before = np.empty((len(self.text), len(m.start)))
        state = np.tile(m.start, (self.texts, 1))
        for i in range(int(self.per.max(initial=0))):
            at = np.flatnonzero(self.no == i)
            own = self.text[at]
            before[at] = state[own]
            x = np.einsum("nk,nkl->nl", state[own], mats[at])
            s = x.sum(1)
            like[own] += np.log(s)
            state[own] = x / s[:, None]
        return like, before, mats

    def expected(self, m: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, steps and emissions, and the log-likelihood of all texts."""
        like, before, mats = self.forward(m)
        k = len(m.start)
        after = np.ones((len(self.text), k))
        beta = np.ones((self.texts, k))
        for i in range(int(self.per.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero(self.no == i)
            own = self.text[at]
            after[at] = beta[own]
            x = np.einsum("nkl,nl->nk", mats[at], beta[own])
            beta[own] = x / x.sum(1, keepdims=True)
        begin = alpha = before[self.order]
        alphas, ems, sums = [], [], []
        for t, n in self.steps():
            em = m.emit[self.c[self.begin[:n] + t]]
            x = alpha[:n] @ m.step
            if t == 0:
                x[self.first] = alpha[:n][self.first]
            x *= em
            total = x.sum(1, keepdims=True)
            alpha = x / total
            alphas.append(alpha)
            ems.append(em)
            sums.append(total)
        # beta is scaled so that alpha times beta sums up to one: the states' shares at each token
        beta, had = after[self.order], 0
        steps, start = np.zeros((k, k)), np.zeros(k)
        emit = np.zeros((CLASSES + 1, k))
        classes, gammas = [], []
        for t, n in reversed(list(self.steps())):
            beta[had:n] /= (alphas[t][had:] * beta[had:n]).sum(1, keepdims=True)
            had = n
            own = beta[:n]
            g = alphas[t] * own
            classes.append(self.c[self.begin[:n] + t])
            gammas.append(g)
            own *= ems[t]
            own /= sums[t]
            if t:
                steps += alphas[t - 1][:n].T @ own
                beta[:n] = own @ m.step.T
            else:
                later = ~self.first[:n]
                steps += begin[:n][later].T @ own[later]
                start += g[self.first[:n]].sum(0)
        step = m.step * steps
        cls, g = np.concatenate(classes), np.concatenate(gammas)
        for j in range(k):
            emit[:, j] = np.bincount(cls, g[:, j], CLASSES + 1)
        return start, step, emit, float(like.sum())


def begin_chain(texts: list[np.ndarray], states: int = STATES, rounds: int = 12, seed: int = 5) -> Chain:
    """A chain of texts in memory: Baum-Welch from states that lean on random groups of them."""
    rng = np.random.default_rng(seed)
    if not texts:
        one = np.ones(states)
        return Chain.from_counts(one, np.ones((states, states)), np.ones((CLASSES + 1, states)))
    # groups: a few rounds of mixture-of-classes clustering give the states different classes to begin with
    bags = np.stack([np.bincount(t, minlength=CLASSES + 1) for t in texts]).astype(float)
    resp = rng.dirichlet(np.ones(states), len(texts))
    for turn in range(12):
        p = resp.T @ bags + 0.05 * bags.sum(0) / bags.sum() * 100 + 1e-3
        score = bags @ np.log(p / p.sum(1, keepdims=True)).T
        score = score / max(1.0, 20.0 / (turn + 1)) + np.log(resp.sum(0) + 1)
        resp = np.exp(score - score.max(1, keepdims=True))
        resp /= resp.sum(1, keepdims=True)
    emit = (resp.T @ bags).T
    chain = Chain.from_counts(resp.sum(0), np.eye(states) * 50 * len(texts) + 1, emit)
    c, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s = Stretches(c, bounds)
    for _ in range(rounds):
        chain = Chain.from_counts(*s.expected(chain)[:3])
    return chain


@dataclass
class Model:
    vocabulary: DataFrame  # hash, count: all words of the training texts
    chain: Chain
    tokens: int  # N
    distinct: int  # V
    class_log: np.ndarray  # log10 of each class's denominator
    head_from: int  # words with at least this count are in the head
    head: np.ndarray  # their hashes, ascending
    head_log: np.ndarray  # log10(count + 0.5)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, class, count over all texts: counted in each task first."""
    ship(docs.sparkSession)

    def merged(held: list) -> list:
        h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return [(h[first], c[order[first]], np.add.reduceat(n[order], first))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int64())], names=["hash", "class", "n"])
        for b in slices(batches, limit=SLICE):
            h, c, _ = tokens(b.column("text"))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, c[first], n))
            size += len(u)
            if size > 2 * kept + 500_000:
                held = merged(held)
                size = kept = len(held[0][0])
                if size > 1_500_000:  # bounds a task's memory
                    yield out(held[0])
                    held, size, kept = [], 0, 0
        if held:
            yield out(merged(held)[0])

    parts = _texts(docs).mapInArrow(run, "hash long, class int, n long")
    return parts.groupBy("hash").agg(F.first("class").alias("class"), F.sum("n").alias("count"))


def class_sequences(docs: DataFrame) -> DataFrame:
    """part, c: the classes of all tokens of each text (16-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            _, c, bounds = tokens(b.column("text"))
            c = c.astype(np.int16)
            own = pa.array([c[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("part"), own], names=["part", "c"])

    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(PARTS)).cast("int")
    # a part's rows stand together in each file, so that reading one skips the others' pages
    return _texts(docs).withColumn("part", part).mapInArrow(run, "part int, c binary").sortWithinPartitions("part")


def expected_counts(sequences: DataFrame, chain: Chain) -> np.ndarray:
    """Of all ``sequences``, in a row: expected counts of starts, steps and emissions, then the log-likelihood."""
    k = len(chain.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(k + k * k + (CLASSES + 1) * k + 1)
        held, size = [], 0

        def flush() -> None:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            got = Stretches(np.concatenate(held).astype(np.int32), bounds).expected(chain)
            flat[:] += np.concatenate([got[0], got[1].ravel(), got[2].ravel(), [got[3]]])

        for b in batches:
            for x in b.column("c"):
                held.append(np.frombuffer(x.as_buffer(), np.int16))
                size += len(held[-1])
                if size > SLICE // 6:  # a word takes about six bytes of text
                    flush()
                    held, size = [], 0
        if held:
            flush()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["at", "n"])

    got = sequences.select("c").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # as many rows as the model has parameters
    flat = np.zeros(k + k * k + (CLASSES + 1) * k + 1)
    flat[[r["at"] for r in got]] = [r["n"] for r in got]
    return flat


def train(docs: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int | None = None, seed: int = 5) -> Chain:
    """The chain of all texts of ``docs``; ``shares``: how often each class occurs in them."""
    k = states
    chain = Chain.from_counts(np.ones(k), np.eye(k) * k + 1, shares[:, None] * np.random.default_rng(seed).gamma(2.0, 0.5, (CLASSES + 1, k)))
    sequences = materialise(class_sequences(docs))
    held, last, turn = [np.zeros(k + k * k + (CLASSES + 1) * k + 1)] * PARTS, None, 0
    while rounds is None or turn < rounds:
        turn += 1
        for part in range(PARTS):
            held[part] = expected_counts(sequences.where(F.col("part") == part), chain)
            flat = np.sum(held, 0)
            chain = Chain.from_counts(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(-1, k))
        if last is not None and flat[-1] - last < SETTLED * abs(last):
            break
        last = flat[-1]
    discard(sequences)
    return chain


def fit(docs: DataFrame, states: int = STATES, rounds: int | None = None, head: int = 1_000_000) -> Model:
    """The model of all texts of ``docs`` (column text)."""
    ship(docs.sparkSession)
    vocabulary = materialise(word_counts(docs))
    by_class = vocabulary.groupBy("class").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()  # at most CLASSES + 1 rows
    n, v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in by_class:
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    # the lowest count that at most ``head`` words reach, on a scale of at most 1000 steps
    scale = F.least(F.col("count"), F.lit(500) + F.floor(20 * F.log2("count")))
    steps = vocabulary.groupBy(scale.cast("long").alias("s")).agg(F.count("*").alias("words"), F.min("count").alias("least")).orderBy(F.desc("s")).collect()
    total, head_from = 0, int(steps[0]["least"]) + 1 if steps else 1
    for r in steps:
        total += r["words"]
        if total > head:
            break
        head_from = int(r["least"])
    top = vocabulary.where(F.col("count") >= head_from).select("hash", "count").toArrow()
    h, c = top.column("hash").to_numpy(), top.column("count").to_numpy()
    order = np.argsort(h.view(U64))
    chain = train(docs, n, states, rounds) if by_class else begin_chain([], states)
    return Model(vocabulary, chain, int(n.sum()), int(v.sum()), np.log10(n + HALF * (v + 1)), head_from, h[order], np.log10(c[order] + HALF))


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.head, model.head_log.astype(np.float64)))  # at most ``head`` words
    chain, class_log = model.chain, model.class_log

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_log = shared.value
        find = Lookup(head).find
        row = TaskContext.get().partitionId() << 36
        for b in slices(batches, limit=SLICE):
            h, c, bounds = tokens(b.column("text"))
            n = len(bounds) - 1
            like = Stretches(c, bounds).forward(chain)[0] / math.log(10)
            doc = np.repeat(np.arange(n), np.diff(bounds))
            at = find(h)
            known = at >= 0
            logs = np.bincount(doc[known], head_log[at[known]], n) if known.any() else np.zeros(n)
            classes = np.bincount(doc, class_log[c], n)
            rest = np.flatnonzero(~known)
            cuts = np.searchsorted(rest, bounds)
            tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h[rest], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(bounds), pa.int64()), pa.array(np.bincount(doc[known], minlength=n), pa.int64()), pa.array(logs), pa.array(like - classes), tail],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "own", "tail"],
            )
            row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    local = materialise(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, own double, tail array<long>"))
    rare = model.vocabulary.where(F.col("count") < model.head_from).select("hash", "count")
    words = local.select("row", F.explode("tail").alias("hash"))
    found = words.hint("merge").join(rare, "hash", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("count", F.lit(0)) + HALF)).alias("tail_logs"), F.count("count").alias("tail_known")
    )
    all_rows = local.drop("tail").hint("merge").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0))
    return all_rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(model.tokens + HALF * (model.distinct + 1))).alias("base_score"), (logs + F.col("own")).alias("score"),
    )
