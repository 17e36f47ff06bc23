"""Token counts under edits, SentencePiece search, packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import packing, pieces, tokencount

ALPHABET = "ab  \n\t'sé1,漢.   <|endoftext|>"


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=300), st.lists(st.tuples(st.integers(0, 320), st.integers(0, 60), st.text(ALPHABET, max_size=40)), max_size=4))
def test_edits(text, edits):
    count = tokencount.counter()
    t = tokencount.CountedText(text, count)
    for start, n, new in edits:
        t.edit(start, start + n, new)
        a = min(start, len(text))
        text = text[:a] + new + text[min(start + n, len(text)) :]
        assert t.text == text
        assert [p for b in t.blocks for p in b] == count.split(text)
        assert t.tokens == sum(len(count.encode(p)) for p in count.split(text))


def test_an_edit_looks_up_little(monkeypatch):
    """What ``encoded`` tells is what was looked up, also when an insertion brings new leaves."""
    t = tokencount.CountedText("some words in a row " * 5000, tokencount.counter())
    looked, many = [], t.count.many
    monkeypatch.setattr(t.count, "many", lambda pieces: looked.extend(pieces) or many(pieces))
    t.edit(50_000, 50_004, "other")
    assert len(looked) == t.encoded < 10
    t.edit(30_000, 30_000, " new words" * 300)
    assert len(looked) == t.encoded < 620
    assert t.tokens == len(t.count.encode(t.text))


def test_trees_stay_balanced():
    rng = random.Random(5)
    t = tokencount.CountedText("", tokencount.counter())
    for k in range(300):
        at = 0 if k % 3 else rng.randint(0, len(t.text))
        t.edit(at, at + rng.choice([0, 0, 200]), " many words" * rng.choice([1, 40, 500]))

    def check(x):
        if x.height:
            assert abs(x.left.height - x.right.height) <= 1 and x.height == 1 + max(x.left.height, x.right.height)
            assert (x.tokens, x.chars, x.leaves) == tuple(getattr(x.left, c) + getattr(x.right, c) for c in ("tokens", "chars", "leaves"))
            check(x.left)
            check(x.right)

    check(t.root)
    assert t.root.leaves > 100 and t.tokens == len(t.count.encode(t.text)) and [p for b in t.blocks for p in b] == t.count.split(t.text)


def test_counts_of_nothing_of_long_texts_and_of_clashing_columns(spark):
    long = "a long text of many words, " * 40_000
    df = spark.createDataFrame([(1, long, "c"), (None, "x y", "c")], "doc_id long, text string, n_tokens string").withColumn("edits", tokencount.sample_edits())
    got = {r.doc_id: r for r in tokencount.count_edits(df).collect()}
    encode = tokencount.counter().encode
    assert got[1].n_tokens == len(encode(long)) and got[1].reencoded < 60 and got[None].n_tokens == 2
    assert tokencount.count_edits(df.limit(0)).count() == 0


def test_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "Hello world, it's  me\n"), (2, None), (3, ""), (4, "é" * 500 + " 漢字 x" * 40), (4, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokencount.count_edits(df.withColumn("edits", tokencount.sample_edits())).collect()
    assert sorted((r.doc_id, r.n_chars, r.n_tokens) for r in got) == sorted((i, len(t or ""), len(ref.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert tokencount.count_edits(df.withColumn("edits", F.lit(None).cast("array<struct<start: long, stop: long, replacement: string>>"))).where("edited_tokens <> n_tokens").count() == 0


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeth  \n<s>"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_pieces_equal_the_library(library, text):
    m = pieces.piece_model()
    text = text.replace("\x00", "")
    ids = m.encode(text)
    assert ids == library.encode(text)
    assert m.decode(ids) == text.replace(pieces.SPACE, " ")


def test_long_units_stream(library):
    rng = random.Random(4)
    m = pieces.piece_model()
    for t in ("x" * 5000, "thetion" * 900, " " * 700, "".join(rng.choice("ethaonéç") for _ in range(4000))):
        assert m.encode(t) == library.encode(t)


def test_stream_commits_early():
    m = pieces.piece_model()
    text = "thetionandwith" * 50
    parts = list(m.stream(text[i : i + 40] for i in range(0, len(text), 40)))
    assert len(parts) > 5 and "".join(p for part in parts for p in part) == text


def test_unigram_search_is_the_best_sum():
    m = pieces.PieceModel(__import__("public_tokenizers").path("piece_bpe_32k.model"), "unigram")
    rng = random.Random(6)
    for _ in range(30):
        text = "".join(rng.choice("ethaon") for _ in range(rng.randint(1, 200)))
        best = [0.0] + [-1e18] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(max(0, i - m.longest), i):
                p = text[j:i]
                if p in m.ids or i - j == 1:
                    best[i] = max(best[i], best[j] + m.score.get(p, m.lowest))
        got = [p for part in m.stream(iter([text])) for p in part]
        assert "".join(got) == text and sum(m.score.get(p, m.lowest) for p in got) == pytest.approx(best[-1])


def test_piece_frames(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world")], "doc_id long, text string")
    ids = pieces.encode(df)
    assert sorted((r.doc_id, r.text) for r in pieces.decode(ids).collect()) == [(1, "hello world"), (1, "hello world"), (2, ""), (3, "")]
    assert pieces.digest(df).where("not round_trip").count() == 0 and pieces.digest(df.limit(0)).count() == 0


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    import public_tokenizers

    ref, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.bpe_encoder()
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice([*ALPHABET, "<|endoftext|>", " the", "ing"]) for _ in range(rng.randint(0, 80)))
        assert own(t).tolist() == ref.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 63), max_size=300))
def test_plan_fills_windows_exactly(lengths):
    filled, left = packing.plan(np.array(lengths, int), 64)
    assert sorted([i for f in filled for i in f] + left) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in f) == 64 for f in filled)
    assert [lengths[i] for i in left] == sorted((lengths[i] for i in left), reverse=True)


def test_least_squares():
    x = packing.nnls([(10, 54), (32, 32), (20, 20, 24)], np.bincount([10] * 5 + [54] * 5 + [32] * 8 + [20] * 4 + [24] * 2, minlength=65))
    assert x.round(3).tolist() == [5, 4, 2]


@pytest.mark.parametrize("group", [50, 8_000_000])
def test_packing_round_trip(spark, group):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "é"]) for _ in range(rng.choice([0, 1, 5, 40, 500, 2500])))) for i in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(df, group_tokens=group).collect()
    encode = packing.bpe_encoder()
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in {i: t for i, t in rows}.items():
        ids = np.append(encode(text or ""), 0).astype("<u4")
        own = sorted(by.pop(doc), key=lambda r: r.start)
        copies = 2 if doc == 7 else 1
        assert sum(r.length for r in own) == copies * len(ids) and all(r.doc_tokens == copies * len(ids) // copies for r in own)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        if copies == 1:
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    assert not by
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 1024
    if group > 50:
        assert sum(1024 - sum(n for _, n in p) for p in seqs.values()) < 1024 * df.rdd.getNumPartitions()
