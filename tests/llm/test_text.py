"""Word, shingle and line helpers against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from eventloom.llm import quality, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = ["", None, " ", "a", "one two", "A b\tC\x0bd\x0ce f", "é漢字 ü x", "x " * 300, "\n\n a\n", "same same same same same same same", "word" * 2000 + " tail"]


def test_words():
    w = text.Words(pa.array(CASES))
    for i, t in enumerate(CASES):
        assert [w.text(j).decode() for j in range(w.bounds[i], w.bounds[i + 1])] == WORD.findall(t or "")


def test_word_hashes_follow_equality():
    rng = random.Random(1)
    words = ["".join(rng.choice("abAB") for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    h = text.Words(pa.array([" ".join(words)]), lower=True).hash
    assert len(set(h.tolist())) == len({w.lower() for w in words})
    by = dict(zip(h.tolist(), (w.lower() for w in words), strict=True))
    assert all(by[x] == w.lower() for x, w in zip(h.tolist(), words, strict=True))


def test_shingle_sets():
    rng = random.Random(2)
    texts = [*CASES, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    h, bounds = text.shingle_sets(pa.array(texts))
    own = [frozenset(h[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]

    def plain(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    want = [plain(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(len(CASES))), pa.array(CASES, pa.string())], names=["i", "text"])
    for limit in (1, 10, 10_000):
        assert [x for s in text.slices([b], limit=limit) for x in s.column("i").to_pylist()] == list(range(len(CASES)))


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    q = np.concatenate([keys[::3], keys[::5] + np.uint64(1)])
    assert (text.Lookup(keys).find(q) >= 0).tolist() == np.isin(q, keys).tolist()
    assert text.Lookup(keys[:0]).find(q).max() == -1


def test_quality_counts():
    texts = [*CASES, "a b c a b c", "l1 x\nl1 x\n\n \nl2\nl1 x", "#*$ %&|<> ##", "p q\r\np q\n"]
    got = quality.count_batch(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
