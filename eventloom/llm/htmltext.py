"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is scanned into leaf blocks: runs of text between block-level borders, each in the innermost block-level element
that is open there. Features of its ancestors' tags, classes, ids and roles and of the text give every block a score for
being main text, and neighbouring blocks a score for each pair of labels. The weights are trained by stochastic gradient on
the exact likelihood (forward-backward) over labelled pages; Viterbi decodes a page (of equal paths the one that keeps
less). Scripts, styles, other raw text and closed templates never become blocks. Scanning takes time in proportion to the page.

The labelled pages come from ``labelled_pages``: a generator of page layouts (semantic tags, classed divisions, tables,
plain bodies and divisions whose names say nothing) with the label of every block; callers may train on pages of their own.

Null or empty html: empty text. Empty table: empty result. Repeated rows each get a row. Very long pages are read whole.
Of the input's columns those in ``keep`` stay, further ones are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Container, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .text import slices

#: Elements whose content is raw text and never shown, up to the end tag (or the end of the page, as in browsers).
_RAW = frozenset("script style textarea title iframe noscript".split())
#: A quote opens a value only after an equals sign; no part is ever tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label nobr ruby rt rp blink img br picture source object canvas".split())
#: Formulas and drawings run on in the text around them.
_INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mpadded mphantom menclose mstyle merror mspace semantics annotation annotation-xml".split())
_INLINE |= frozenset("svg g path circle ellipse rect line polyline polygon text tspan textpath defs use symbol stop lineargradient radialgradient clippath mask pattern marker filter desc metadata animate animatetransform image foreignobject".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
#: Which open elements a start tag ends.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Blocks that may stand inside a paragraph.
_WITHIN = frozenset(("select", "template"))
_SECTIONS = frozenset("article main section nav aside header footer form dialog menu".split())
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
KEEP, DROP = 1, 0


class Element:
    """An open block-level element; ``features``: the distinct ones of it and its ancestors, shared with the parent if it adds none."""

    __slots__ = ("before", "context", "features", "inside", "links", "main", "near", "other", "tag")

    def __init__(self, tag: str, attrs: str, parent: Element | None, known: Container[str] | None):
        self.tag, self.links, self.before = tag, 0, 0
        marks = _marks(attrs) if attrs else ()
        own = [f"in:{tag}", *(f"mark:{w}" for w in marks), *(f"stem:{w[:4]}" for w in marks if len(w) > 4)]
        held = parent.features if parent else ()
        have = set(held)
        new = [f for f in dict.fromkeys(own) if f not in have and (known is None or f in known)]
        self.features = (*held, *new) if new else held
        # the innermost section, and what is around it
        self.near, self.main, self.other = (parent.near, parent.main, parent.other) if parent else (None, False, False)
        if tag in _SECTIONS or marks:
            if self.near:
                self.main |= self.near[0] in ("article", "main")
                self.other = True
            self.near = (tag if tag in _SECTIONS else "marked", marks)
        near, words = self.near or ("", ())
        inside = "main" if self.main else "other" if self.other else "top"
        self.context = ("bias", f"own:{tag}", *(f"near:{w}" for w in words), f"near:{near}", f"{near} in {inside}", f"{tag} of {near}", f"{tag} of {near} in {inside}")


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page: kind "" for text, "<" for a start tag and "/" for an end tag (value: its name)."""
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "", page[at : lt if lt >= 0 else n], ""
            if lt < 0:
                return
        at = lt
        after = page[at + 1 : at + 2]
        if after in ("!", "?") and after:
            end, size = (page.find("-->", at + 2), 3) if page.startswith("<!--", at) else (page.find(">", at), 1)
            if end < 0:
                return
            at = end + size
            continue
        m = _TAG.match(page, at) if at < last and (after.isalpha() or after == "/") else None
        if not m:
            yield "", "<", ""
            at += 1
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            yield "/", tag, ""
        elif tag not in _RAW:
            yield "<", tag, attrs
        elif not attrs.endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in page order; ``known``: the features of ancestors that matter (all, if not given)."""
    out: list[Block] = []
    stack: list[Element] = []  # open block-level elements
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, linked))
            parts.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            opened[e.tag] -= 1
            links -= e.links
        del stack[depth:]

    for kind, tag, attrs in tokens(page):
        if not kind:
            parts.append(tag)
            if links:
                linked += len(tag)
            continue
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a" and stack:
                # a link ends with the block it stands in
                step = 1 if kind == "<" else -1 if stack[-1].links else 0
                stack[-1].links += step
                links += step
            elif tag == "a":
                links = max(0, links + (1 if kind == "<" else -1))
            continue
        end()
        if kind == "/":
            if opened.get(tag):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)
                if tag == "template":  # what it holds is not part of the page
                    del out[stack[k].before :]
                pop(k)
            continue
        if tag == "head":  # holds no text but raw; what else stands there belongs to the body, closed or not
            continue
        if tag in _VOID:
            continue
        if tag not in _WITHIN and stack and stack[-1].tag == "p":  # a block ends an open paragraph
            pop(len(stack) - 1)
        if tag in _ENDS:
            own, stop = _ENDS[tag]
            if any(opened.get(t) for t in own):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in own:
                        pop(k)
                        break
                    if stack[k].tag in stop:
                        break
        element = Element(tag, attrs, stack[-1] if stack else None, known)
        element.before = len(out)
        stack.append(element)
        opened[tag] = opened.get(tag, 0) + 1
    end()
    return out


@lru_cache(20_000)
def _marks(attrs: str) -> tuple[str, ...]:
    """Words of an element's class, id and role."""
    words: list[str] = []
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "hidden":
            words.append("hidden")
        else:
            words += (w.lower() for w in _WORD.findall(m[2] or ""))
    return tuple(dict.fromkeys(words))


_NOWHERE = Element("", "", None, frozenset())


def features(block: Block, i: int, n: int) -> list[str]:
    """Features of the text and of where it stands, without those of all ancestors."""
    text, words = block.text, block.text.count(" ") + 1
    share = block.linked / max(1, len(text))
    out = [*(block.element or _NOWHERE).context, f"words:{min(7, words.bit_length())}", f"links:{min(3, int(share * 4))}"]
    if text[-1] in ".!?…。\"'”»":
        out.append("sentence")
    if "©" in text[:40]:
        out.append("copyright")
    if i == 0 and n > 1:
        out.append("first")
    if i == n - 1:
        out.append("last" if i else "only")
    return out


class CRF:
    """weights: feature -> score of KEEP less that of DROP; step[a][b]: score of label b after a."""

    def __init__(self, weights: dict[str, float] | None = None, step: list[list[float]] | None = None):
        self.weights, self.step = weights or {}, step or [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, page: list[Block]) -> list[float]:
        get, n, out = self.weights.get, len(page), []
        summed: dict[int, float] = {}  # of ancestors, by the tuple that elements share; the page keeps these alive
        for i, b in enumerate(page):
            above = (b.element or _NOWHERE).features
            if (s := summed.get(id(above))) is None:
                s = summed[id(above)] = sum([get(f, 0.0) for f in above])
            out.append(s + sum([get(f, 0.0) for f in features(b, i, n)]))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        s = self.scores(page)
        if not s:
            return []
        (dd, dk), (kd, kk) = self.step
        d, k, back = 0.0, s[0], []
        for x in s[1:]:
            back.append((d + dd < k + kd, d + dk < k + kk))
            d, k = max(d + dd, k + kd), max(d + dk, k + kk) + x
        label = int(k > d)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> CRF:
        data = [([[*features(b, i, len(p)), *(b.element or _NOWHERE).features] for i, b in enumerate(p)], y) for p, y in pages if p]
        rng, w, t = random.Random(seed), self.weights, self.step
        turn = 0
        for _ in range(epochs):
            rng.shuffle(data)
            for rows, y in data:
                turn += 1
                lr = rate / (1 + turn / (2 * len(data)))
                s = [sum(w.get(f, 0.0) for f in r) for r in rows]
                n = len(s)
                # forward and backward in logarithms
                fwd = [(0.0, s[0])]
                for x in s[1:]:
                    d, k = fwd[-1]
                    fwd.append((_lse(d + t[0][0], k + t[1][0]), _lse(d + t[0][1], k + t[1][1]) + x))
                bwd = [(0.0, 0.0)] * n
                for i in range(n - 2, -1, -1):
                    d, k = bwd[i + 1][0], bwd[i + 1][1] + s[i + 1]
                    bwd[i] = (_lse(t[0][0] + d, t[0][1] + k), _lse(t[1][0] + d, t[1][1] + k))
                z = _lse(*fwd[-1])
                grad = [[0.0, 0.0], [0.0, 0.0]]
                for i in range(n - 1):
                    for a in (0, 1):
                        for b in (0, 1):
                            grad[a][b] -= math.exp(min(0.0, fwd[i][a] + t[a][b] + (s[i + 1] if b else 0.0) + bwd[i + 1][b] - z))
                    grad[y[i]][y[i + 1]] += 1
                for i, r in enumerate(rows):
                    g = lr * (y[i] - math.exp(min(0.0, fwd[i][1] + bwd[i][1] - z)))
                    for f in r:
                        w[f] = w.get(f, 0.0) * (1 - decay) + g
                for a in (0, 1):
                    for b in (0, 1):
                        t[a][b] += lr * grad[a][b] / n
        return self


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


# ---- labelled pages ----

_TOPICS = "river stone market winter engine garden letter signal bridge copper harvest museum orchard planet railway season tunnel valley window yellow".split()


#: Names that say nothing about what a division holds.
_DULL = "text row col inner block container wrapper box wrap page left right center body site root app grid section cell".split()


def _sentence(rng: random.Random, lo: int = 6, hi: int = 22) -> str:
    words = [rng.choice(_TOPICS) + rng.choice(("", "s", "ed", "ing", "")) for _ in range(rng.randint(lo, hi))]
    return " ".join(words).capitalize() + "."


def labelled_pages(n: int = 900, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages of varied layouts with the label of every block. Kept blocks start with a mark character that is taken off."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        found = blocks(_page(rng))
        labels = [int(b.text.startswith("\u0001")) for b in found]
        for b in found:
            b.text = b.text.replace("\u0001", "").strip() or "x"
        out.append((found, labels))
    return out


def _page(rng: random.Random) -> str:
    pick, some = rng.choice, lambda p: rng.random() < p
    s = lambda lo=6, hi=22: _sentence(rng, lo, hi)
    long = lambda: " ".join(s() for _ in range(rng.randint(1, 5)))
    link = lambda: f'<a href="/{pick(_TOPICS)}">{pick(_TOPICS).title()}</a>'
    if some(0.03):
        return f"\u0001{long()}"
    semantic = some(0.6)
    dull = lambda: pick(("", f' class="{pick(_DULL)}"', f' id="{pick(_DULL)}"', f' class="{pick(_TOPICS)}-{rng.randrange(99)}"'))

    def box(tag: str, marks: tuple[str, ...], inner: str) -> str:
        mark = pick(marks)
        if semantic and tag:
            return f"<{tag}>{inner}</{tag}>" if some(0.5) else f'<{tag} class="{mark}">{inner}</{tag}>'
        return f'<div {pick(("class", "id"))}="{mark}">{inner}</div>'

    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8))) + "</ul>"

    def junk() -> str:
        kind = rng.randrange(11)
        if kind == 9:
            return pick((f"<dialog><p>{s()}</p></dialog>", f'<div class="{pick(("modal", "popup", "overlay", "lightbox", "toast"))}"><p>{s()}</p></div>', f'<ins class="adsbygoogle">{s(2, 8)}</ins>'))
        if kind == 10:
            return f'<ul class="{pick(("breadcrumbs", "pagination", "tags", "share-links", "pager"))}">' + "".join(f"<li>{pick((link(), s(1, 3)))}</li>" for _ in range(3)) + "</ul>"
        if kind == 0:
            return box("nav", ("nav", "menu", "main-menu", "navbar", "breadcrumb", "navigation"), pick((menu(), link() + " " + link(), f"<p>{link()}</p>")))
        if kind == 1:
            return box("aside", ("sidebar", "side-bar", "widget", "related", "sidebar right"), f"<h3>{s(1, 4)}</h3>" + (menu() if some(0.5) else f"<p>{long()}</p>"))
        if kind == 2:
            return box("", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), pick((s(), f"<p>{long()}</p>")))
        if kind == 3:
            return box("", ("cookie-notice", "notice", "cookie", "consent", "gdpr banner", "alert", "popup", "newsletter"), pick((s(), f"<p>{s()}</p><button>OK</button>")))
        if kind == 4:
            return f'<form{pick(("", " class=" + chr(34) + "search" + chr(34)))}><label>{s(1, 5)}</label><input name="q"><p>{s()}</p><button>{pick(_TOPICS)}</button></form>'
        if kind == 5:
            who = lambda: f'<div class="comment"><p>{s(1, 3)}</p><p>{long()}</p></div>'
            return box("section", ("comments", "comment-list", "reader-comments", "responses", "discussion"), f"<h3>Comments</h3>{''.join(who() for _ in range(rng.randint(1, 4)))}") if not semantic else f'<section {pick(("class", "id"))}="{pick(("comments", "comment-list", "reader-comments"))}"><h2>Comments</h2>{"".join(who() for _ in range(rng.randint(1, 4)))}</section>'
        if kind == 6:
            return box("", ("share", "social", "tags", "meta", "byline", "pagination"), pick((menu(), s(1, 6))))
        if kind == 7:
            return box("footer", ("footer", "site-footer", "copyright", "legal"), pick((f"&copy; {s()}", f"<p>{long()}</p>", menu())))
        return box("header", ("header", "site-header", "masthead", "topbar", "logo"), pick((s(1, 6), f"<h1>{s(1, 4)}</h1><p>{s()}</p>")))

    body = [f"<h1>\u0001{s(3, 12)}</h1>"]
    if some(0.2):
        body[0] = f"<header>{body[0]}</header>"
    for _ in range(rng.randint(1, 12)):
        kind = rng.randrange(14)
        if kind == 0:
            body.append(f"<h2>\u0001{s(2, 8)}</h2>")
        elif kind == 1:
            body.append("<ul>" + "".join(f"<li>\u0001{s()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind == 2:
            body.append(f"<blockquote><p>\u0001{long()}</p></blockquote>")
        elif kind == 3:
            body.append(f"<p><b>\u0001{long()}<br>")
        elif kind == 4:
            body.append(f"<p>\u0001{s()} {link()} {s()}</p>")
        elif kind == 5:
            body.append("<table><tr>" + "".join(f"<td>\u0001{s(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
        elif kind == 6:
            body.append(f"<figure><img src=x><figcaption>\u0001{s()}</figcaption></figure>")
        elif kind == 7:
            body.append(f"<pre>\u0001{s()}</pre>")
        elif kind == 8:
            body.append(f"<div>\u0001{long()}</div>")
        elif kind in (9, 10):
            body.append(f"<p>\u0001{s(1, 5)}</p>")
        else:
            body.append(f"<p>\u0001{long()}</p>")
        if some(0.12):
            body.append(junk())
    inner = "".join(body)
    if plain := some(0.3):  # nothing says where the text is
        inner = pick((inner, f"<div{dull()}>{inner}</div>", f"<div{dull()}><div{dull()}>{inner}</div></div>", f"<section{dull()}>{inner}</section>", f"<table><tr><td>{inner}</td></tr></table>", f"<center>{inner}</center>"))
    elif semantic:
        inner = pick((f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f'<article class="post">{inner}</article>', f"<main>{inner}</main>"))
    else:
        inner = f'<div {pick(("class", "id"))}="{pick(("content", "article", "post", "entry-content", "main-content", "story", "article-body", "post-body", "main"))}">{inner}</div>'
    around = 0 if plain and some(0.4) else 4
    before = "".join(junk() for _ in range(rng.randint(0, around)))
    after = "".join(junk() for _ in range(rng.randint(0, around)))
    wrap = pick(("", '<div class="wrapper">', '<div id="page" class="container">', f"<div{dull()}>"))
    head, close = pick((("<html><head>", "</head><body>"), ("<html>", "<body>"), ("", ""), ("<html><head>", "</head>"))), pick(("</body></html>", ""))
    return f"{pick(('<!DOCTYPE html>', ''))}{head[0]}<title>{s()}</title>{head[1]}{wrap}{before}{inner}{after}{'</div>' if wrap else ''}{close}"


@lru_cache(1)
def default_model() -> CRF:
    return CRF().train(labelled_pages())


def main_text(page: str | None, model: CRF) -> str:
    found = blocks(page or "", model.weights)
    return "\n\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract(pages: DataFrame, model: CRF | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars of every page (column html)."""
    ship(pages.sparkSession)
    model = model or default_model()
    weights, step = model.weights, model.step
    rows = pages.select(*keep, F.col("html").cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = CRF(weights, step)
        for b in slices(batches, "_html"):
            texts = [main_text(p, crf) for p in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
