"""Language identification by a byte convolutional network.

Bytes (A-Z lower-cased, all other ASCII but letters merged) are embedded, filters of several widths run over fixed-length
windows that cover the whole text, each filter's maximum in a window feeds a softmax. A text's language is the one with
the highest probability averaged over its windows, weighted by their letters. The network is trained in numpy, on every
window of all labelled texts: in each of ROUNDS rounds every task goes on from the same network over its own texts, and
the tasks' networks are averaged by their windows. Given ``per_lang``, it learns on the driver instead, from a bounded
sample (``per_lang`` texts of a language, ``per_doc`` windows of a text).

Null text, or one without a letter: ``und`` with score 0. No labelled text: all ``und``. Null labels teach nothing. Ties
go to the language that sorts first. Repeated rows each get a row, as do rows with equal or null ids. Very long texts are
read whole. Empty table: empty result. Of the input's columns those in ``keep`` stay, whatever their names.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .text import buffers, slices

WIDTHS = (2, 3, 4)
UNUSUAL = 0.002  # the share of held-out windows below a network's floor
ROUNDS, TASK_BYTES, SHUFFLED, LEAST = 4, 32 << 20, 1 << 16, 32_000  # LEAST: windows, repeated if need be, that each network learns from
LETTERS, BINS, UNIT = 8, 10_000, 1 << 20  # letters of a window that teaches; bins of scores; parameters are summed as whole numbers of 1 / UNIT
_CLASS = np.zeros(256, np.int32)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = 1 + _i
_CLASS[128:] = 27 + np.arange(128)
CLASSES = 155
_LETTERS = _CLASS > 0


@dataclass
class ByteCNN:
    langs: list[str]
    embed: np.ndarray  # CLASSES x dim
    filters: list[np.ndarray]  # for each width: width x dim x n
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int
    floor: float = 0.0  # what all but a few held-out windows score at least

    def taps(self) -> list[np.ndarray]:
        return [np.einsum("cd,wdn->wcn", self.embed, f) for f in self.filters]

    def tables(self) -> tuple[np.ndarray, ...]:
        """What a pair (or one) of bytes adds to each filter: the convolution as few table look-ups."""
        two, three, four = self.taps()
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, -1), np.float32)
        return pair(two[0], two[1]), pair(three[0], three[1]), np.ascontiguousarray(three[2], np.float32), pair(four[0], four[1]), pair(four[2], four[3])

    def probabilities(self, c: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """c: windows x window classes."""
        t2, t3, t3b, t4, t4b = tables
        pairs = c[:, :-1] * CLASSES + c[:, 1:]
        a = t2[pairs].max(1)
        b = t3[pairs[:, :-1]]
        b += t3b[c[:, 2:]]
        d = t4[pairs[:, :-2]]
        d += t4b[pairs[:, 2:]]
        h = np.maximum(np.concatenate([a, b.max(1), d.max(1)], 1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def begin(langs: list[str], window: int, dim: int, n: int, rng: np.random.Generator) -> ByteCNN:
    return ByteCNN(langs, rng.normal(0, 0.5, (CLASSES, dim)), [rng.normal(0, (w * dim) ** -0.5, (w, dim, n)) for w in WIDTHS], np.zeros(n * len(WIDTHS)), rng.normal(0, 0.2, (n * len(WIDTHS), len(langs))), np.zeros(len(langs)), window)


class Learner:
    """Changes a network's parameters in place (Adam)."""

    def __init__(self, m: ByteCNN):
        self.m, self.params, self.steps = m, [m.embed, *m.filters, m.bias, m.out, m.out_bias], 0
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def put(self, flat: np.ndarray) -> None:
        for p, own in zip(self.params, np.split(flat, np.cumsum([p.size for p in self.params])[:-1]), strict=True):
            p[...] = own.reshape(p.shape)

    def step(self, c: np.ndarray, t: np.ndarray, rate: float, weight: np.ndarray | None = None) -> None:
        """c: windows x window classes; t: their languages; weight: what each window counts."""
        m, window = self.m, c.shape[1]
        n = len(m.bias) // len(WIDTHS)
        self.steps += 1
        rows = np.arange(len(c))[:, None]
        best, raw = [], []
        for w, tap in zip(WIDTHS, m.taps(), strict=True):
            s = tap[0][c[:, : window - w + 1]]
            for k in range(1, w):
                s = s + tap[k][c[:, k : window - w + 1 + k]]
            best.append(at := s.argmax(1))
            raw.append(s[rows, at, np.arange(n)[None, :]])
        pre = np.concatenate(raw, 1) + m.bias
        h = np.maximum(pre, 0)
        z = h @ m.out + m.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(t)), t] -= 1
        if weight is not None:
            p *= weight[:, None]
        p /= len(t)
        back = (p @ m.out.T) * (pre > 0)
        grads = [np.zeros_like(m.embed)]
        for j, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
            g, gf = back[:, j * n : (j + 1) * n], np.zeros_like(f)
            for k in range(w):
                cls = c[rows, best[j] + k]  # batch x n
                gf[k] = np.einsum("bnd,bn->dn", m.embed[cls], g)
                np.add.at(grads[0], cls, g[:, :, None] * f[k].T[None])
            grads.append(gf)
        grads += [back.sum(0), h.T @ p, p.sum(0)]
        for q, g, a, b in zip(self.params, grads, self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.99**self.steps)) + 1e-8)


def train(texts: list[tuple[str, bytes]], window: int = 256, dim: int = 8, n: int = 16, steps: int = 500, batch: int = 64, seed: int = 7) -> ByteCNN:
    """texts: (language, bytes of at most one window)."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in texts})
    x = np.zeros((len(texts), window), np.int32)
    for i, (_, t) in enumerate(texts):
        t = np.frombuffer(t[:window], np.uint8)
        x[i, : len(t)] = _CLASS[t]
    y = np.array([langs.index(lang) for lang, _ in texts])
    learner = Learner(m := begin(langs, window, dim, n, rng))
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, batch // len(langs))) for own in by])
        learner.step(x[pick], y[pick], 0.01 * min(1, 2 * (1 - step / (steps + 1))))
    return m


def windowed(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window in ``data`` and its text: every text is covered, its last window padded by the caller."""
    n = -(-np.diff(offsets) // window)
    doc = np.repeat(np.arange(len(n)), n)
    start = offsets[doc] + window * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    return start, doc


def predict_batch(m: ByteCNN, tables, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language (-1: und) and score of each text."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    start, doc = windowed(data, offsets, m.window)
    votes, weight = np.zeros((n, len(m.langs))), np.zeros(n)
    cls = np.append(_CLASS[data], np.zeros(m.window, np.int32))
    for a in range(0, len(start), 512):
        s, d = start[a : a + 512], doc[a : a + 512]
        at = s[:, None] + np.arange(m.window)
        c = np.where(at < offsets[d + 1][:, None], cls[at], 0)
        letters = (c > 0).sum(1)
        p = m.probabilities(c, tables)
        np.add.at(votes, d, p * letters[:, None])
        np.add.at(weight, d, letters)
    p = votes / np.maximum(weight, 1)[:, None]
    best = p.argmax(1)
    score = np.clip(p[np.arange(n), best], 0, 1)
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTERS[data] & (data < 128))])
    for i in np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]):
        if not any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode()):
            best[i], score[i] = -1, 0
    return best, score


def sample(docs: DataFrame, usable: Column, per_lang: int, per_doc: int = 4, window: int = 256, max_texts: int = 40_000) -> list[tuple[str, bytes]]:
    """At most per_lang * per_doc windows of each language (max_texts texts in all, or one a language); rows are chosen by a hash of doc_id."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy("lang").collect()  # a row a language, as the network has outputs
    if not counts:
        return []
    per_lang = min(per_lang, max(1, max_texts // len(counts)))
    # a hash below the share that per_lang is of a language's rows
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.1 * per_lang / r["count"]))])
    chosen = rows.withColumn("rank", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))).where(F.col("rank") < F.coalesce(share[F.col("lang")], F.lit(0.0)) * float(1 << 40))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for rank, lang, t in zip(*(b.column(k).to_pylist() for k in ("rank", "lang", "text")), strict=True):
                raw = t.encode()
                step = max(window, -(-len(raw) // per_doc))
                out += [(rank, lang, i, raw[a : a + window]) for i, a in enumerate(range(0, len(raw), step))]
            yield pa.RecordBatch.from_pylist([dict(zip(("rank", "lang", "i", "piece"), x, strict=True)) for x in out], schema=pa.schema([("rank", pa.int64()), ("lang", pa.string()), ("i", pa.int32()), ("piece", pa.binary())]))

    got = chosen.select("rank", "lang", "text").mapInArrow(cut, "rank long, lang string, i int, piece binary").collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"], r["i"], bytes(r["piece"]))):
        own = by.setdefault(r["lang"], [])
        if len(own) < per_lang * per_doc:
            own.append((r["lang"], bytes(r["piece"])))
    return [x for own in by.values() for x in own if _LETTERS[np.frombuffer(x[1], np.uint8)].sum() >= LETTERS]


def teaching(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of every window with enough letters of the texts of a batch, and the text each is in; some windows at a time."""
    data, offsets = buffers(batch.column("text"))
    start, doc = windowed(data, offsets, window)
    cls = np.append(_CLASS[data].astype(np.uint8), np.zeros(window, np.uint8))
    for a in range(0, len(start), 4096):
        s, d = start[a : a + 4096], doc[a : a + 4096]
        at = s[:, None] + np.arange(window)
        c = np.where(at < offsets[d + 1][:, None], cls[at], 0)
        enough = (c > 0).sum(1) >= LETTERS
        yield c[enough], d[enough]


def learnt(rows: DataFrame, nets: list[ByteCNN], weights: np.ndarray, epochs: int, rate: float) -> np.ndarray:
    """Learning goes on from ``nets`` in each task over its rows (lang, half, text); the nets then hold the tasks' averages. How many windows each learnt from."""
    size = len(Learner(nets[0]).flat())
    number = {lang: i for i, lang in enumerate(nets[0].langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, rng = [Learner(copy.deepcopy(m)) for m in nets], np.zeros(len(nets), np.int64), np.random.default_rng(7)
        held, waiting = [], 0

        def learn() -> None:
            c, t, half = (np.concatenate(x) for x in zip(*held, strict=True))
            for _ in range(epochs):
                for j, x in enumerate(own):
                    use = rng.permutation(np.flatnonzero((half != j - 1) | (j == 0)))
                    seen[j] += len(use)
                    for a in range(0, len(use), 64):
                        pick = use[a : a + 64]
                        x.step(c[pick].astype(np.int32), t[pick], rate, weights[t[pick]])

        for b in slices(batches):
            langs, halves = np.array([number[x] for x in b.column("lang").to_pylist()]), b.column("half").to_numpy()
            for c, doc in teaching(b, nets[0].window):
                held.append((c, langs[doc], halves[doc]))
                waiting += len(c)
                if waiting >= SHUFFLED:
                    learn()
                    held, waiting = [], 0
        if waiting:
            learn()
        flat = np.concatenate([np.append(np.rint(x.flat() * UNIT) * n, n) for x, n in zip(own, seen, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat.astype(np.int64))], names=["at", "n"])

    got = rows.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # as many rows as the nets have parameters
    flat = np.zeros(len(nets) * (size + 1))
    flat[[r["at"] for r in got]] = [r["n"] for r in got]
    seen = flat[size :: size + 1]
    for m, own in zip(nets, flat.reshape(len(nets), -1), strict=True):
        if own[-1]:
            Learner(m).put(own[:-1] / own[-1] / UNIT)
    return seen


def usual(rows: DataFrame, nets: list[ByteCNN]) -> float:
    """What all but UNUSUAL of the windows of all rows score at least, each by the network that did not learn from its text: a multiple of 1 / BINS, at most 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bins = [m.tables() for m in nets], np.zeros(BINS + 1, np.int64)
        for b in slices(batches):
            halves = b.column("half").to_numpy()
            for c, doc in teaching(b, nets[0].window):
                for j in (1, 2):
                    own = c[halves[doc] == j - 1].astype(np.int32)
                    for a in range(0, len(own), 512):
                        top = nets[j].probabilities(own[a : a + 512], tables[j]).max(1)
                        bins += np.bincount(np.minimum(top * BINS, BINS).astype(np.int64), minlength=BINS + 1)
        at = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bins[at])], names=["at", "n"])

    got = rows.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most BINS + 1 rows
    bins = np.zeros(BINS + 1, np.int64)
    bins[[r["at"] for r in got]] = [r["n"] for r in got]
    below = np.cumsum(bins) - bins
    return min(0.5, int(np.flatnonzero(below <= UNUSUAL * bins.sum()).max()) / BINS)


def fit_whole(docs: DataFrame, usable: Column, window: int = 256) -> ByteCNN | None:
    """A network of all windows of all labelled texts; its floor comes from all of them too, by two networks that each learn from one half of the texts and are tried on the other.

    Copies are in the same half. If there are enough windows each round reads its own share of the texts, so that each text is
    learnt from once; else every round reads all, again and again.
    """
    part = F.pmod(F.xxhash64("text"), F.lit(2 * ROUNDS)).cast("int")
    rows = docs.where(usable).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text <> ''")
    rows = rows.select("lang", (part % 2).alias("half"), F.floor(part / 2).alias("round"), "text")
    counts = rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / window)).alias("n")).orderBy("lang").collect()  # a row a language, as the network has outputs
    if not counts:
        return None
    n = np.array([r["n"] for r in counts], float)
    tasks, epochs = max(1, int(n.sum() * window) // TASK_BYTES), max(1, -(-2 * LEAST // int(n.sum())))
    nets = [begin([r["lang"] for r in counts], window, 8, 16, np.random.default_rng(7)) for _ in range(3)]
    seen = np.zeros(3)
    for turn in range(ROUNDS):
        own = rows.where(F.col("round") == turn) if epochs == 1 else rows
        rate = 0.01 * min(1, 2 * (1 - (turn + 0.5) / ROUNDS))
        # rare languages count more, by the root of what they lack
        seen += learnt(own.coalesce(tasks), nets, np.sqrt(n.mean() / n), -(-epochs // ROUNDS), rate)
    if not seen[0]:
        return None
    nets[0].floor = usual(rows, nets) if seen.all() else 0.0
    return nets[0]


def fit(docs: DataFrame, usable: Column | None = None, per_lang: int | None = None, **kw) -> ByteCNN | None:
    """A network trained on the rows of ``docs`` (doc_id, lang, text) where ``usable``, on a sample of them if ``per_lang`` is given; None if they teach nothing."""
    ship(docs.sparkSession)
    if per_lang is None:
        return fit_whole(docs, F.lit(True) if usable is None else usable, **kw)
    texts = sample(docs, F.lit(True) if usable is None else usable, per_lang, **kw)
    if not texts:
        return None
    # a network that has not seen a fifth of the windows tells which scores are usual for clean text
    tried, rest = texts[::5], [t for i, t in enumerate(texts) if i % 5]
    model = train(texts)
    model.floor = float(min(0.5, np.quantile(top_scores(train(rest), [t for _, t in tried]), UNUSUAL))) if rest else 0.0
    return model


def top_scores(m: ByteCNN, pieces: list[bytes]) -> np.ndarray:
    """The score of each piece's most likely language."""
    tables, out = m.tables(), [np.ones(1)]
    for a in range(0, len(pieces), 512):
        c = np.zeros((len(pieces[a : a + 512]), m.window), np.int32)
        for row, piece in zip(c, pieces[a : a + 512], strict=True):
            own = np.frombuffer(piece[: m.window], np.uint8)
            row[: len(own)] = _CLASS[own]
        out.append(m.probabilities(c, tables).max(1))
    return np.concatenate(out)


def predict(docs: DataFrame, model: ByteCNN | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score."""
    ship(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    if model is None:
        return kept.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        names = np.array([*model.langs, "und"], object)
        for b in slices(batches, "_text"):
            tables = tables or model.tables()
            best, score = predict_batch(model, tables, b.column("_text"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")
