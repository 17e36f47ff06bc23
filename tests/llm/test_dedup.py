"""Fingerprints, line dedup, the n-gram join, quality verdicts and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import fingerprints, graph, linededup, ngramjoin, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- fingerprints ----


def test_chunks_shift_with_the_text():
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh \n") for _ in range(5000))
    a, b = fingerprints.Prints(pa.array([t])), fingerprints.Prints(pa.array(["some new words before " + t]))
    assert fingerprints.likeness(a, np.array([0]), b, np.array([0]))[0] > 0.97
    assert a.strings()[0] == fingerprints.Prints(pa.array(["x", t, t[:50]])).strings()[1]


def test_chunk_sizes():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("abcdefghijkl ") for _ in range(40_000)).encode(), np.uint8)
    starts = fingerprints.chunk_starts(data, np.array([0, len(data)]))
    sizes = np.diff(np.append(starts, len(data)))
    assert sizes[:-1].min() >= fingerprints.MIN and sizes.max() <= fingerprints.MAX
    assert 15 < sizes.mean() < 45


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=2, max_size=6))
def test_likeness_equals_strings(texts):
    p = fingerprints.Prints(pa.array(texts))
    i = np.arange(len(texts) - 1)
    for got, x, y in zip(fingerprints.likeness(p, i, p, i + 1), p.strings(), p.strings()[1:], strict=False):
        assert got == pytest.approx(fingerprints.contains(x, y))


def test_chunks_against_a_plain_search():
    """Gear hashes, cuts and weights, one byte at a time."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh \né") for _ in range(n)) for n in (0, 1, 7, 8, 9, 100, 700)] + ["a" * 300, "the same again " * 40]
    prints = fingerprints.Prints(pa.array(texts))
    for t, got in zip(texts, prints.strings(), strict=True):
        raw, chunks, start = t.encode(), [], 0
        for i in range(len(raw)):
            size = i + 1 - start
            h = sum(int(fingerprints._GEAR[raw[j]]) << (i - j) for j in range(max(0, i - 7), i + 1)) & 0xFFFFFFFF if size >= fingerprints.MIN else 1 << 6
            mask = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
            if size >= fingerprints.MIN and not h & int(mask) or size == fingerprints.MAX or i + 1 == len(raw):
                chunks.append(raw[start : i + 1])
                start = i + 1
        weights = sorted(int(got[k + 12 : k + 20], 16) for k in range(0, len(got), 20))
        assert weights == sorted(chunks.count(c) * len(c) for c in set(chunks))


def test_sketches():
    rng = random.Random(6)
    t = " ".join(f"w{rng.randint(0, 99999)}" for _ in range(30_000))
    a, b, c = fingerprints.Prints(pa.array([t, t[40_000:] + t[:9], t[:50]])).strings()
    most = 400
    assert len(fingerprints.sketch(a, most)) == 20 * most
    cut = [fingerprints.sketch(x, most) for x in (a, b, c)]
    assert abs(fingerprints.sketches_contain(cut[0], cut[1], most) - fingerprints.contains(a, b)) < 0.1
    assert fingerprints.sketches_contain(cut[0], "", most) == 0.0 and fingerprints.sketches_contain(cut[2], cut[2], most) == 1.0


def test_compare_against_plain(spark):
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("abé \n") for _ in range(rng.choice([0, 1, 3, 50, 900])))) for i in range(80)]
    rows += [(500, None), (501, ""), (None, "null id"), (503, "漢" * 41), (3, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    for size in (2000, 7):
        from unittest import mock

        real = fingerprints.with_next
        with mock.patch.object(fingerprints, "with_next", lambda d, s=size: real(d, s)):
            got = fingerprints.compare(df).collect()
        order = sorted(((i is not None, i or 0, t or ""), i) for i, t in rows)
        texts = [k[2] for k, _ in order]
        want = []
        for n, ((_, _, t), i) in enumerate(order):
            nxt = texts[(n + 1) % len(texts)]
            want.append((i, len(t), hashlib.sha256(fingerprints.edited(t, nxt).encode()).hexdigest()))
        assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, want))
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1


def test_compare_of_nothing_and_of_one(spark):
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")
    r = fingerprints.compare(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and r.near_next == 1.0
    assert fingerprints.compare(one.limit(0)).count() == 0


# ---- lines ----


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.data())
def test_cuckoo_filter(keys, data):
    keys = np.array(sorted(keys), np.uint64)
    f = linededup.CuckooFilter(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() if len(keys) else True
    gone = keys[:: data.draw(st.integers(1, 3))]
    f.delete(gone)
    left = np.setdiff1d(keys, gone)
    g = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert not len(left) or g.contains(left).all()


def test_cuckoo_filter_rarely_errs():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    f = linededup.CuckooFilter(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.001


def lines_by_force(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (i is not None and len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def docs_with_lines(seed, n=60):
    rng = random.Random(seed)
    shared = ["Shared line number %d that is long enough to count é" % k for k in range(6)] + ["short", "x" * 39, "y" * 40, "É" * 40]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randint(0, 6))]
        parts = [p.upper() if rng.random() < 0.2 and p.isascii() else f" \t{p}\r" if rng.random() < 0.2 else p for p in parts]
        rows.append((i, "\n".join(parts)))
    return rows


def test_lines(spark):
    rows = [*docs_with_lines(1), (100, None), (101, ""), (None, "y" * 40), (5, docs_with_lines(1)[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash"))
    got = linededup.dedup(df).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == lines_by_force(rows)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_very_long_lines_and_clashing_columns(spark):
    line = "the same line of a text that is very long " * 2000
    rows = [(i, f"{line}\nown {i}\n" * 30, "c", "d") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_dropped_ string")
    got = linededup.dedup(df, ("doc_id", "key")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == lines_by_force([r[:2] for r in rows])
    assert {r.n_dropped for r in got} == {0, 30} and {r.key for r in got} == {"c"}


def test_lines_are_reversible(spark):
    a, b = docs_with_lines(1), [(i + 1000, t) for i, t in docs_with_lines(2)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = linededup.LineIndex.build(frame(a), shard_keys=2)
    assert one.shards > 1
    both = one.insert(frame(b))
    tell = lambda index, rows: sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in index.apply(frame(rows)).collect()), key=str)
    assert tell(both, a + b) == lines_by_force(a + b)
    assert tell(both.delete(frame(b)), a) == lines_by_force(a) == tell(one, a)
    # inserting what is there already changes nothing
    assert tell(one.insert(frame(a[:20])), a) == lines_by_force(a)


def test_full_filters_are_built_anew(spark):
    lines = [f"line number {k} which has at least forty characters" for k in range(600)]
    few, many = [(i, "\n".join(lines[:2])) for i in range(5)], [(100 + i, "\n".join(lines)) for i in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    grown = linededup.LineIndex.build(frame(few), shard_keys=200).insert(frame(many))
    assert grown.shards == 3  # one could not hold them
    got = grown.apply(frame(few + many)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == lines_by_force(few + many)


# ---- n-gram join ----


def shingles_of(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(rows):
    sets = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=6, size=14, words=60):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{k}" for k in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                t += passage
            rows.append(" ".join(t))
    rows += [" ".join(passage + [f"s{i}{k}" for k in range(rng.randint(0, 12))]) for i in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    rows = near_copies(seed)
    rows += [(900, None), (901, ""), (902, "A b C"), (903, "a B c"), (904, "a b"), (905, "a b c d e"), (906, "A B C D E f"), (None, rows[0][1]), (0, rows[0][1]), (None, "only here without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = ngramjoin.join(df.repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_force(rows)


@pytest.mark.parametrize("counted", [5, 4096])
def test_join_with_split_buckets(spark, monkeypatch, counted):
    monkeypatch.setattr(ngramjoin, "COUNTED", counted)
    rows = near_copies(3, groups=2, size=60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngramjoin, "BLOCK_TOKENS", 400)  # many blocks a component
    monkeypatch.setattr(ngramjoin, "CROWD", 3)
    got = ngramjoin.join(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_force(rows)


def bridged_groups(groups=30, seed=9):
    """Large groups; each with a text that resembles a few members, not the leader, and one that resembles this text alone."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        new = iter(range(10**6))
        w = lambda n, g=g, new=new: [f"g{g}n{next(new)}" for _ in range(n)]
        base, front = w(60), rng.choice([5, 6, 7])
        rows += [base[:59] + w(1 + rng.randint(0, 7)) for _ in range(12)] + [base[:53]]
        far = base[: 60 - rng.choice([3, 4, 5, 6])]
        far += w(60 - len(far))
        rows += [far[:59] + w(1) for _ in range(3)]
        bridge = w(front) + far[front:]
        rows += [bridge, bridge[:front] + w(3) + bridge[front + 3 :]]
    rng.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_join_of_what_a_bridge_brings_into_a_group(spark):
    rows = bridged_groups()
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components_by_force(rows)


def passage_copies(seed=6, groups=4, size=8):
    """Passages, each in a few copies with another tail: most of what they share is in buckets that a small ``salted`` splits."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for _ in range(size):
            rows.append(" ".join([f"g{g}p{k}" for k in range(40)] + [f"t{rng.random()}" for _ in range(rng.randint(1, 3))]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("salted", [1, 2])
def test_join_of_lone_postings_in_split_buckets(spark, salted):
    rows = passage_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = ngramjoin.postings(docs.repartition(3), 5, ngramjoin.frequent(ngramjoin.scan(docs.coalesce(1), 5)), 75, salted)
    split = held.groupBy("shingle").agg(F.max("salt").alias("top")).where("top > 0").select("shingle")
    want = held.join(split, "shingle").select("shingle", "digest").distinct()
    got = ngramjoin.shared_postings(held).select("shingle", "digest")
    assert split.count() and want.subtract(got).count() == 0
    joined = ngramjoin.join(docs.repartition(3), salted=salted).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined), key=str) == components_by_force(rows)


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.join(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=8), st.lists(st.integers(1, 200), min_size=26, max_size=26))
def test_prefixes_never_lose_a_link(sets, counts):
    """Whatever the frequencies: linked sets share as many prefix shingles as ``needed`` asks for."""
    from eventloom.llm.text import Lookup

    h = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    often = Lookup(np.arange(26, dtype=np.uint64)), np.array(counts)
    ell, token, _, text, follow = ngramjoin.prefixes(h, np.concatenate([[0], np.cumsum(n)]), often, 75)
    own = [set(token[text == i].tolist()) for i in range(len(sets))]
    for i in range(len(sets)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low = min(ell[i], ell[j])
                overlap = -(-75 * (a + b) // 175)
                behind = max(-(-75 * a // 100), -(-75 * b // 100)) - low
                need = max(low, overlap - behind)
                assert len(own[i] & own[j]) >= need
                after = [dict(zip(token[text == k].tolist(), follow[text == k].tolist(), strict=True)) for k in (i, j)]
                assert any(after[0][x] + 1 >= need and after[1][x] + 1 >= need for x in own[i] & own[j])


@pytest.mark.parametrize("few", [0, 20, 200_000])
def test_components(spark, few):
    rng = random.Random(7)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(300, 380)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x in got:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[x] == min(seen)
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}


# ---- quality ----


def test_verdicts(spark):
    """Hosts decide in both directions: a good one rescues a broken rule, a bad one costs clean documents theirs or all of them."""
    text_of = lambda i: " ".join(f"word{i}x{k}" for k in range(80))
    symbols = {"few": " ###", "some": " ###" * 2, "many": " ###" * 30}  # of 80 words: under, over and far over the limit of 5 %
    rows = [(i, text_of(i) + (symbols["many"] if i % 7 == 0 else ""), f"host{i % 5}") for i in range(1000)]
    rows += [(2000 + i, text_of(i) + (symbols["many"] if i % 5 < 2 else ""), "https://www.Poor.example/a?b" if i % 2 else "poor.example") for i in range(400)]
    rows += [(3000 + i, text_of(i) + (symbols["many"] if i % 10 < 9 else ""), "worst") for i in range(200)]
    rows += [(4000 + i, text_of(i), "good") for i in range(800)]
    rows += [(9000, None, "good"), (9001, "x", None), (9002, text_of(1), None), (None, text_of(2), "good"), (9002, text_of(1), None)]
    for k, host in enumerate(("host1", "poor.example", "worst", "good")):
        rows += [(8000 + 10 * k + j, text_of(j) + symbols[s], host) for j, s in enumerate(symbols)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    out = quality.judge(quality.measure(df)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert not got[9000].kept and not got[9001].kept and got[9000].base_failed and got[9002].kept and got[None].kept
    assert {r.host for r in out} >= {"poor.example", "good", None} and "https://www.Poor.example/a?b" not in {r.host for r in out}
    kept = lambda k: [got[8000 + 10 * k + j].kept for j in range(3)]
    assert kept(0) == [True, False, False]  # an ordinary host: the rules as they are
    assert kept(1) == [False, False, False] and got[2003].kept  # a bad one: half the limits
    assert not any(r.kept for r in out if r.host == "worst")  # the worst: all go
    assert kept(3) == [True, True, False]  # a good one: twice the limits
    rule_alone = lambda r: not (r.base_failed or r.soft_failed)
    assert {rule_alone(r) for r in out if r.kept != rule_alone(r)} == {True, False}
    assert quality.judge(quality.measure(df.limit(0))).count() == 0


def test_verdicts_against_sql(spark, tmp_path):
    """The query's SQL, run by DuckDB, where hosts differ."""
    import duckdb

    from eventloom.llm import oracles, queries

    rng = random.Random(8)
    rows = []
    for i in range(1500):
        host = rng.choice([None, "a", "b", "http://c.example/x", "d", "d"])
        bad = {"a": 0.9, "b": 0.3, None: 0.1}.get(host, 0.02)
        n = rng.choice([0, 40, 60, 120, 120])
        rows.append((i, "\n".join(" ".join(f"w{rng.randint(0, 400)}" for _ in range(10)) for _ in range(n // 10)) + (" #" * rng.choice([3, 7, 20]) if rng.random() < bad else ""), host))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracles.QUALITY).fetchall()
    got = [tuple(r) for r in queries.op6_quality_rules(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {r[-1] for r in got} == {True, False}


# ---- pipeline ----


def test_representatives(spark):
    rows = [*near_copies(4, groups=3, size=8), (900, None), (901, ""), (None, ""), (902, ""), (902, "")]
    rows += [(0, rows[0][1]), (None, rows[0][1]), (None, "only here without an id"), (None, "only here without an id"), (700, "a b c"), (700, "d e f"), (701, "d e f")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.text) for r in ngramjoin.representatives(df.repartition(3), ("doc_id", "text", "digest")).collect()), key=str)
    # one row of each component, the smallest id first; rows without words all stay
    comps: dict = {}
    for (d, t), label in zip(rows, labels_by_force(rows), strict=True):
        comps.setdefault(label, []).append((d is None, d or 0, d, t))
    want = []
    for label, own in comps.items():
        want += [x[2:] for x in own] if not WORD.findall(own[0][3] or "") else [min(own, key=lambda x: x[:2])[2:]]
    assert got == sorted(want, key=str)
    assert ngramjoin.representatives(df.limit(0), ("doc_id", "text")).count() == 0


def test_scan_reads_each_text_once(spark):
    df = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    scanned = ngramjoin.scan(df, 5, ("doc_id", "text", "lang"))
    assert scanned._jdf.queryExecution().analyzed().child().output().size() == 3
    assert [tuple(r) for r in scanned.where("kind = 0").select("keep_doc_id", "keep_text", "keep_lang").collect()] == [(1, "a b c", "en")]


def labels_by_force(rows):
    sets = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage against a brute-force version on what its predecessor kept."""
    import zlib

    import corpus_pipeline
    from eventloom.llm import language, packing

    rng = random.Random(5)
    rows = []
    for i in range(120):
        text = " ".join(f"w{rng.randint(0, 500)}" for _ in range(80))
        if i % 9 == 0:
            text += " $$$" * 40
        if i % 4 == 1 and rows:
            text = rows[-1][1] + " tail"
        if i % 5 == 0:
            text += "\nThis line of at least forty characters is in many texts."
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "12 34 " * 40, "en", "s1", 240), (None, rows[1][1].replace("w", "v"), "en", "s1", 1), (None, rows[2][1].replace("w", "u"), "de", None, 2)]
    rows += [rows[3], rows[3], (905, " ".join(f"long{k}" for k in range(30_000)), "en", "s2", 3), (906, "", "en", "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumn("digest", F.lit("clash")).withColumn("kept", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "line dedup", "n-gram join", "packing"]
    order = lambda found: sorted((tuple(r) for r in found), key=str)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)

    def soft(t):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {x for x in tri if tri.count(x) > 1} if len(w) < 1000 else set()
        hit = {k + j for k, x in enumerate(tri) if x in often for j in range(3)}
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return base, 100 * sum((t or "").count(c) for c in "#*$%&|<>") > 5 * len(w) or 100 * (len(lines) - len(set(lines))) > 10 * len(w)

    # hosts are alike, so the rules count as they are
    kept = [r for r in rows if not any(soft(r[1]))]
    got = stage["quality rules"](spark, docs, str(tmp_path))
    assert got.columns == df.columns and order(got.collect()) == order(kept) and None in {r[0] for r in kept}

    docs = spark.createDataFrame(kept, df.schema)
    model = language.fit(docs)
    scores = language.predict(docs, model, keep=("doc_id", "text")).collect()
    sure = {(r.doc_id, r.text) for r in scores if r.lang_pred != "und" and r.score >= model.floor}
    got = stage["language ID"](spark, docs, str(tmp_path)).collect()
    kept = [r for r in kept if (r[0], r[1]) in sure]
    assert order(got) == order(kept) and not any(r[0] == 901 for r in kept) and len(kept) > 60
    assert stage["language ID"](spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == docs.count()

    got = stage["line dedup"](spark, spark.createDataFrame(kept, df.schema), str(tmp_path)).collect()
    shorter = lines_by_force([r[:2] for r in kept])
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((d, t) for d, _, _, t in shorter), key=str) and all(r.n_chars == len(r.text) for r in got)

    kept = [tuple(r) for r in got]
    got = stage["n-gram join"](spark, spark.createDataFrame(kept, df.schema), str(tmp_path)).collect()
    groups: dict = {}
    for r, label in zip(kept, labels_by_force(kept_texts := [r[:2] for r in kept]), strict=True):
        groups.setdefault(label, []).append(r)
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(min(own, key=lambda r: (r[0] is None, r[0] or 0))[0]) for own in groups.values()) and len(got) < len(kept_texts)
    assert {tuple(r) for r in got} <= set(kept)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.bpe_encoder()
    for r in got:
        ids = np.append(encode(r.text), 0).astype("<u4")
        own = [p for p in pieces if p.doc_id == r.doc_id]
        if r.doc_id is not None:
            assert sum(p.length for p in own) == len(ids)
            assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in got}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
