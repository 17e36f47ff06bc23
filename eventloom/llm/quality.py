"""Quality rules with host-level verdicts.

Every text gets its counts and the rules it breaks. Failures are summed by host (the domain, where the host column holds
URLs), each host's failure rate is shrunk by a beta prior fitted to all hosts, and the host's verdict goes back to its
documents: it decides how strictly the rules beyond the base ones are read. A host is good if the upper bound of its rate
(posterior mean and Z deviations) is LIFT times below the rate of all documents, bad if the lower bound is LIFT times above
it; a good host's documents have twice the limits of ordinary ones, a bad host's half of them, and where the lower bound
of a bad host reaches CONDEMNED, all its documents go.

Null text: no words, which breaks the base rule. Null host: one host of its own. Empty table: empty result. Repeated
rows each count and each get a row, also with equal or null ids. Very long texts are counted whole. Of the input's columns
those in ``keep`` stay, whatever they are called, unless they have the name of a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .text import Words, buffers, code_points, slices, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

SYMBOLS_PER_100_WORDS, DUP_LINES_PER_100_WORDS = 5, 10
Z, LIFT, CONDEMNED = 1.645, 1.5, 0.5


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    w = Words(column)
    n = len(w.offsets) - 1
    data, offsets = w.data, w.offsets
    words = np.diff(w.bounds)

    def summed(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[offsets[1:]] - c[offsets[:-1]]

    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    chars = summed(is_word[data] & ((data & 0xC0) != 0x80))
    symbols = summed(_SYMBOL[data])

    # lines: exact comparison of the bytes of lines that hold a word
    dup = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if raw.find(b"\n", a, b) < 0:
            continue
        lines = [x for x in raw[a:b].split(b"\n") if x and x.strip(b" \t\n\x0b\x0c\r")]
        dup[i] = len(lines) - len(set(lines))

    repeat = np.zeros(n, np.int64)
    h, at = windows(w, 3)
    if len(h):
        doc = w.doc[at]
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
        twice = np.zeros(len(hs), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(w.hash), bool)
        for k in range(3):
            hit[at[order[twice]] + k] = True
        repeat = np.bincount(w.doc[hit], minlength=n)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def domain(host: Column) -> Column:
    """The domain of a URL, in lower case and without ``www.``; what is no URL stays as it is."""
    found = F.regexp_extract(F.lower(host), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(found != "", found).otherwise(host)


def measure(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, host and the counts of every text."""
    ship(docs.sparkSession)
    kept = [F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in keep]
    rows = docs.select(*kept, domain(F.col(host).cast("string")).alias("_host"), F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            c = count_batch(b.column("_text"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column("_host"), *(pa.array(v, pa.int64()) for v in c.values())], names=[*keep, "host", *c])

    return rows.mapInArrow(run, f"{fields}, host string, {COUNTS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed(halves: Column | int = 2) -> Column:
    """Whether a document breaks a rule beyond the base ones, with limits of ``halves`` halves of the usual."""
    return (200 * F.col("n_symbols") > halves * SYMBOLS_PER_100_WORDS * F.col("n_words")) | (200 * F.col("n_dup_lines") > halves * DUP_LINES_PER_100_WORDS * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed, shrunk (the posterior mean of its failure rate), halves (of the usual limits, for its documents), condemned.

    The beta prior has the mean of all documents and the strength that the spread of the hosts' rates gives (method of
    moments, weighted by documents; between 1 and 1000 documents).
    """
    by_host = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum((base_failed() | soft_failed()).cast("long")).alias("failed"))
    m = F.col("f") / F.col("t")
    prior = by_host.agg(
        F.sum("n").alias("t"), F.sum("failed").alias("f"), F.count("*").alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("s"),
    ).select(
        m.alias("mean"),
        # between-host variance: weighted variance of the rates less what sampling alone gives
        (F.col("s") / F.col("t") - m * m - (F.col("hosts") / F.col("t")) * m * (1 - m)).alias("var"),
    ).select("mean", F.when(F.col("var") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1))).otherwise(1000.0).alias("strength"))
    mean, strength = prior.select("mean").scalar(), prior.select("strength").scalar()
    rates = by_host.select("host", "n", "failed", ((F.col("failed") + mean * strength) / (F.col("n") + strength)).alias("shrunk"), mean.alias("mean"), strength.alias("strength"))
    spread = Z * F.sqrt(F.col("shrunk") * (1 - F.col("shrunk")) / (F.col("n") + F.col("strength") + 1))
    good, bad = F.col("shrunk") + spread <= F.col("mean") / LIFT, F.col("shrunk") - spread >= F.col("mean") * LIFT
    return rates.select("host", "n", "failed", "shrunk", F.when(good, 4).when(bad, 1).otherwise(2).alias("halves"), (~good & bad & (F.col("shrunk") - spread >= CONDEMNED)).alias("condemned"))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed, soft_failed (by the usual limits), host_rate and kept.

    The rates are written first, so that their size is known: a few hosts are broadcast, many are joined by sorting, with
    large hosts split.
    """
    rates = materialise(host_rates(measured)).select(F.col("host").alias("_host"), F.col("shrunk").alias("host_rate"), F.col("halves").alias("_halves"), F.col("condemned").alias("_condemned"))
    out = measured.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed())
    out = out.join(rates, out["host"].eqNullSafe(rates["_host"]), "left")
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("_condemned") | soft_failed(F.col("_halves")))).drop("_host", "_halves", "_condemned")
