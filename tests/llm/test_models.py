"""Language identification, the hidden Markov model, page extraction."""

import math

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import hmm, htmltext, language

WORDS = {"en": "the and of with reading water stone this that which", "de": "der und nicht eine lesen wasser stein diese durch größe", "fr": "le et avec une lire eau pierre cette qui être"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), 40)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, "the water", None), (None, "le et avec", "fr"), (903, "the water", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(docs):
    from eventloom.llm.queries import fold

    model = language.fit(docs, ~fold(0), per_lang=50)
    got = language.predict(docs, model, keep=("doc_id", "lang")).collect()
    assert len(got) == docs.count()
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == r.lang for r in plain) / len(plain) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)


def test_language_learns_from_every_window(spark):
    # the windows at the start of each quarter tell nothing
    rng = np.random.default_rng(6)
    plain = ("abc " * 64)[:256]
    said = lambda lang: " ".join(rng.choice(WORDS[lang].split(), 150))[:512]
    rows = [(i, "".join(plain + said(lang) for _ in range(4)), lang) for i, lang in enumerate(list(WORDS) * 20)]
    df = spark.createDataFrame([(d, t, lang) for d, t, lang in rows], "doc_id long, text string, lang string").repartition(3)
    model = language.fit(df)
    got = language.predict(df, model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.97 * len(rows) and 0 < model.floor <= 0.5
    assert all(r.score >= model.floor for r in got)


def test_language_without_labels(docs):
    none = docs.where("lang = 'xx'")
    model = language.fit(none)
    assert model is None
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_tables_are_the_convolution():
    m = language.train([(lang, (w * 3).encode()) for lang, w in WORDS.items()], window=64, steps=20)
    c = np.random.default_rng(0).integers(0, language.CLASSES, (5, 64)).astype(np.int32)
    h = []
    for w, f in zip(language.WIDTHS, m.filters, strict=True):
        e = m.embed[c]
        h.append(np.max([sum(e[:, i + k] @ f[k] for k in range(w)) for i in range(64 - w + 1)], axis=0))
    z = np.maximum(np.concatenate(h, 1) + m.bias, 0) @ m.out + m.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(m.probabilities(c, m.tables()), p / p.sum(1, keepdims=True), atol=1e-4)


def test_windows_cover_every_text():
    data = np.arange(1000) % 200
    start, doc = language.windowed(data.astype(np.uint8), np.array([0, 0, 300, 300, 1000]), 256)
    assert start.tolist() == [0, 256, 300, 556, 812] and doc.tolist() == [1, 1, 3, 3, 3]


def _chain(k=3, seed=1):
    rng = np.random.default_rng(seed)
    return hmm.Chain.from_counts(rng.random(k) * 5, rng.random((k, k)) * 5, rng.random((hmm.CLASSES + 1, k)))


def _brute(m, c):
    a = m.start * m.emit[c[0]]
    like = 0.0
    for x in c[1:]:
        s = a.sum()
        like += math.log(s)
        a = (a / s) @ m.step * m.emit[x]
    return like + math.log(a.sum())


def test_forward_is_exact():
    m, rng = _chain(), np.random.default_rng(2)
    texts = [rng.integers(0, hmm.CLASSES + 1, n) for n in (1, 2, 127, 128, 129, 256, 257, 1000, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = hmm.Stretches(np.concatenate(texts), bounds).forward(m)[0]
    assert np.allclose(got, [_brute(m, t) for t in texts], rtol=1e-10)


def test_expected_counts_against_plain_forward_backward():
    m, rng = _chain(), np.random.default_rng(3)
    texts = [rng.integers(0, 50, n) for n in (1, 5, 130, 300)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, step, emit, _ = hmm.Stretches(np.concatenate(texts), bounds).expected(m)
    s2, t2, e2 = np.zeros_like(start), np.zeros_like(step), np.zeros_like(emit)
    for c in texts:
        f = [m.start * m.emit[c[0]]]
        for x in c[1:]:
            f.append(f[-1] / f[-1].sum() @ m.step * m.emit[x])
        f = [x / x.sum() for x in f]
        b = [np.ones(3)]
        for x in c[:0:-1]:
            b.append(m.step @ (m.emit[x] * b[-1]))
            b[-1] /= b[-1].sum()
        b = b[::-1]
        for i, x in enumerate(c):
            g = f[i] * b[i]
            g /= g.sum()
            e2[x] += g
            if i == 0:
                s2 += g
            else:
                xi = f[i - 1][:, None] * m.step * (m.emit[x] * b[i])[None]
                t2 += xi / xi.sum()
    assert np.allclose(start, s2) and np.allclose(step, t2) and np.allclose(emit, e2)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 20, 60) + 100 * (i % 2) for i in range(40)]
    c, bounds = np.concatenate(texts), np.arange(41) * 60
    s, m, last = hmm.Stretches(c, bounds), hmm.begin_chain(texts, 2, 0), -math.inf
    for _ in range(4):
        *counts, like = s.expected(m)
        assert like > last - 1.0
        last, m = like, hmm.Chain.from_counts(*counts)


def test_model_scores(spark, docs):
    rows = docs.select("doc_id", "text")
    from pyspark.sql import functions as F

    train = rows.where("doc_id % 3 <> 1")
    for head in (1_000_000, 3):  # with a small head most words go through the join
        model = hmm.fit(train.select("text"), rounds=1, head=head)
        got = hmm.score(rows, model, F.lit(False)).collect()
        assert len(got) == rows.count()
        from collections import Counter

        c = Counter()
        for r in train.collect():
            c.update([*(r.text or "").split(), None])
        n, v = sum(c.values()), len(c)
        texts = Counter((r.doc_id, r.text or "") for r in rows.collect())
        for (doc, t), k in texts.items():
            own = [r for r in got if r.doc_id == doc]
            w = [*t.lower().split(), None]
            base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            assert len(own) == k
            assert all(abs(r.base_score - base) < 1e-6 and r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w) and r.train_tokens == n and r.score < 0 for r in own)


def test_training_settles_over_whole_texts(spark):
    """What differs between texts comes after their first 400 tokens."""
    rng = np.random.default_rng(6)
    words = [[f"{a}{b}{c}" for b in "xyz" for c in "uvw"] for a in "abcdef"]
    rows = [(" ".join(["same"] * 400 + [w for _ in range(10) for w in rng.choice(words[rng.integers(6)], 30)]),) for _ in range(40)]
    texts = [r[0] for r in rows]
    chain = hmm.fit(spark.createDataFrame(rows, "text string").repartition(3)).chain
    _, c, bounds = hmm.tokens(pa.array(texts))
    s, likes = hmm.Stretches(c, bounds), []
    for _ in range(6):
        *counts, like = s.expected(chain)
        chain = hmm.Chain.from_counts(*counts)
        likes.append(like)
    assert likes[-1] - likes[0] < 0.01 * abs(likes[0])
    assert likes[0] > -0.9 * 40 * 300 * math.log(54), likes  # -1.0: the states tell no groups apart


def test_model_of_nothing(docs):
    from pyspark.sql import functions as F

    none = docs.where("false")
    model = hmm.fit(none.select("text"))
    assert (model.tokens, model.distinct) == (0, 0)
    assert hmm.score(docs.select("doc_id", "text"), model, F.lit(True)).count() == docs.count()
    assert hmm.score(none.select("doc_id", "text"), model, F.lit(True)).count() == 0


def test_blocks_and_entities():
    page = "<p>a &amp; b<br>c <b>d<p>e<ul><li>f<li>g</ul><script>var x='<p>no</p>'</script><!-- <p>no --><td>h &lt;i&gt;\n\t j&nbsp;k</td>"
    assert [b.text for b in htmltext.blocks(page)] == ["a & b c d", "e", "f", "g", "h <i> j k"]
    assert htmltext.blocks("") == [] and [b.text for b in htmltext.blocks("a < b <p>c")] == ["a < b", "c"]
    assert [b.text for b in htmltext.blocks("<style>p{}</style><p title='a>b'>x</p><script>never ends")] == ["x"]


def test_blocks_after_elements_that_never_end():
    texts = lambda page: [b.text for b in htmltext.blocks(page)]
    assert texts("<html><head><title>t</title><meta charset=x><body><p>a<p>b") == ["a", "b"]
    assert texts("<head><title>t</title><h1>a</h1><p>b</p>") == texts("<head><title>t</title></head><h1>a</h1><p>b</p>") == ["a", "b"]
    for e in ("<svg class='i'/>", "<svg><path d='M0'/></svg>", "<math/>", "<object data=x>", "<canvas>", "<iframe src='x' />", "<title/>"):
        assert texts(f"<p>a {e}b</p><p>c</p>") == ["a b", "c"], e
    assert texts("<p>a</p><select><option>x<p>b</p>") == ["a", "x", "b"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><object><p>instead</p></object>") == ["let x=2 be", "instead"]
    assert texts("<template><p>no</p><template>no</template></template><p>a</p><div><template><p>b</p></div>") == ["a", "b"]
    assert texts("<title-bar>a</title-bar><script>no</script><style/><textarea>no</textarea>b") == ["a", "b"]


def test_viterbi_is_the_best_path():
    import itertools

    m = htmltext.default_model()
    for p, _ in htmltext.labelled_pages(20, seed=5):
        p = p[:10]
        s = m.scores(p)
        path = lambda y: sum(a for a, b in zip(s, y, strict=True) if b) + sum(m.step[a][b] for a, b in itertools.pairwise(y))
        assert path(m.decode(p)) == pytest.approx(max(path(y) for y in itertools.product((0, 1), repeat=len(p))))


def test_held_out_pages():
    m = htmltext.default_model()
    pages = htmltext.labelled_pages(150, seed=77)
    right = sum(a == b for p, y in pages for a, b in zip(m.decode(p), y, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.98


PAGES = {
    "<html><title>t</title><body><p>First paragraph of some length.</p><p>Second one.</p>": "First paragraph of some length.\n\nSecond one.",
    "<body><div class='text'><p>First paragraph here.</p><p>Second one.</p></div>": "First paragraph here.\n\nSecond one.",
    "<html><head><title>t</title><body><nav><a href=x>Home</a></nav><article><h1>A title of words</h1><p>Body of it.</p></article>": "A title of words\n\nBody of it.",
    "<body><svg viewBox='0 0 1 1'/><article><p title=don't>It is here.</p><p data-x = 'a>b'>And here.</p></article>": "It is here.\n\nAnd here.",
    "A text without any markup at all.": "A text without any markup at all.",
    "<body><ul class='menu'><li><a href=a>One</a><li><a href=b>Two</a></ul><div id='inner'><h2>Title of the page</h2><div>A paragraph in a division, with <i>some</i> words.</div><ul><li>First of the points.<li>Second of them.</ul></div><div class='footer'>&copy; Someone</div>": "Title of the page\n\nA paragraph in a division, with some words.\n\nFirst of the points.\n\nSecond of them.",
    "<main><h1>Long title of a story</h1><p>The story begins here and goes on.</p><aside><p>Related stories of today.</p></aside><p>It ends here.</p></main><section class='comments'><h3>Comments</h3><div class='comment'><p>Me: I like it a lot.</p></div></section>": "Long title of a story\n\nThe story begins here and goes on.\n\nIt ends here.",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_labelled_by_hand(page):
    assert htmltext.main_text(page, htmltext.default_model()) == PAGES[page]


def test_scanning_takes_time_in_proportion():
    """Ten times the page takes far less than a hundred times the time."""
    import time

    m = htmltext.default_model()
    makes = (lambda n: "<a " * n, lambda n: "<div>x" * n, lambda n: "".join(f"<div class=a{i}>x" for i in range(n)), lambda n: "<p>" + "<i>" * n + "</b></p>" * n, lambda n: '<a b="' * n, lambda n: "<!--" * n)
    for make in makes:
        took = []
        for n in (2_000, 20_000):
            page, began = make(n), time.perf_counter()
            htmltext.main_text(page, m)
            took.append(time.perf_counter() - began)
        assert took[1] < 0.5 + 40 * took[0]


def test_features_of_deep_elements_are_all_ancestors():
    page = "<main class='alpha'>" + "<div class='beta'>" * 50 + "<p id=gamma>x"
    (b,) = htmltext.blocks(page)
    assert {"in:main", "mark:alpha", "in:div", "mark:beta", "in:p", "mark:gamma"} <= set(b.element.features) and len(set(b.element.features)) == len(b.element.features)
    (c,) = htmltext.blocks(page, {"in:p", "mark:beta"})
    assert set(c.element.features) == {"in:p", "mark:beta"}


def test_extract(spark):
    art = "<nav><a href=x>Home</a></nav><article><h1>Title words here</h1><p>First   paragraph of text.</p><p>Second.</p></article><footer>&copy; us</footer>"
    rows = [(1, "u", art, "clash"), (2, None, None, "x"), (3, "u", "", "y"), (1, "u", art, "clash")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = "Title words here\n\nFirst paragraph of text.\n\nSecond."
    long = "<article>" + "<p>One more paragraph of it.</p>" * 20_000 + "</article>"
    (r,) = htmltext.extract(spark.createDataFrame([(5, "u", long)], "page_id long, url string, html string")).collect()
    assert r.text == "\n\n".join(["One more paragraph of it."] * 20_000)
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
