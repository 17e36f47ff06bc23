"""Token counts that follow edits.

A document is split into pre-tokens, of which the byte-level BPE never merges two. A segment tree holds their token counts:
its leaves are runs of up to ``2 * LEAF`` pre-tokens with the count of each, its nodes hold the sums of what is below. An
edit re-splits and re-encodes only the pre-tokens it touches, with the boundary context the splitting pattern can look at,
until the new borders meet the old ones again; the leaves it touches are replaced (a long insertion brings leaves of its
own), and the sums on the paths above them are updated. The tree stays balanced, so an edit costs its own length and the
logarithm of the text's, besides the copy of the text.

Null text is empty: 0 tokens. Edits outside a text are clipped to it. Very long texts are counted whole. Repeated rows each
get a row, as do rows with equal or null ids. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .packing import bpe_encoder
from .text import slices

LEAF = 64
_patterns: dict[str, object] = {}


class Counter:
    """Tokens of a pre-token, remembered in two generations of at most ``most`` entries each."""

    def __init__(self, tokenizer: str = "byte_bpe_50k", most: int = 250_000):
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.encode, self.most = bpe_encoder(tokenizer), most
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def many(self, pieces: list[str]) -> list[int]:
        get = self.young.get
        out = [get(p) for p in pieces]
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = self.one(pieces[i])
        return out

    def one(self, piece: str) -> int:
        n = self.young.get(piece) or self.old.get(piece) or len(self.encode(piece))
        if len(piece) <= 64:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[piece] = n
        return n


def counter(tokenizer: str = "byte_bpe_50k") -> Counter:
    """One for each process and tokenizer."""
    if tokenizer not in _patterns:
        _patterns[tokenizer] = Counter(tokenizer)
    return _patterns[tokenizer]


class Leaf:
    """A run of pre-tokens and the tokens of each."""

    __slots__ = ("chars", "counts", "pieces", "tokens")
    height, leaves = 0, 1

    def __init__(self, pieces: list[str], counts: list[int]):
        self.pieces, self.counts = pieces, counts
        self.tokens, self.chars = sum(counts), sum(map(len, pieces))


class Node:
    """Two subtrees and the sums (tokens, code points, leaves) of both."""

    __slots__ = ("chars", "height", "leaves", "left", "right", "tokens")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.tokens, self.chars, self.leaves = left.tokens + right.tokens, left.chars + right.chars, left.leaves + right.leaves
        self.height = max(left.height, right.height) + 1


Tree = Leaf | Node | None


def build(leaves: list[Leaf]) -> Tree:
    """A balanced tree."""
    level: list = leaves
    while len(level) > 1:
        level = [Node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        if len(level) > 1 and level[-1].height < level[-2].height - 1:  # keeps the heights of neighbours within one
            level[-2:] = [join(level[-2], level[-1])]
    return level[0] if level else None


def join(a: Tree, b: Tree) -> Tree:
    """The leaves of both in order: the lower tree goes down the side of the higher one, whose heights are kept within one."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _level(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _level(join(a, b.left), b.right)
    return Node(a, b)


def _level(a: Leaf | Node, b: Leaf | Node) -> Node:
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return Node(Node(a, b.left.left), Node(b.left.right, b.right))
        return Node(Node(a, b.left), b.right)
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return Node(Node(a.left, a.right.left), Node(a.right.right, b))
        return Node(a.left, Node(a.right, b))
    return Node(a, b)


def split(tree: Tree, k: int) -> tuple[Tree, Tree]:
    """The first k leaves and the others."""
    if tree is None or k <= 0:
        return None, tree
    if k >= tree.leaves:
        return tree, None
    if k <= tree.left.leaves:
        a, b = split(tree.left, k)
        return a, join(b, tree.right)
    a, b = split(tree.right, k - tree.left.leaves)
    return join(tree.left, a), b


class CountedText:
    """A text with its token count under edits; ``encoded``: pre-tokens counted again since it was built."""

    def __init__(self, text: str, count: Counter):
        self.count, self.text, self.encoded = count, text, 0
        pieces = count.split(text)
        self.pretokens = len(pieces)
        self.root = build(self._leaves(pieces, count.many(pieces))) or Leaf([], [])

    @staticmethod
    def _leaves(pieces: list[str], counts: list[int]) -> list[Leaf]:
        return [Leaf(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def blocks(self) -> list[list[str]]:
        return [self.leaf(k).pieces for k in range(self.root.leaves)]

    def leaf(self, k: int) -> Leaf:
        at = self.root
        while at.height:
            if k < at.left.leaves:
                at = at.left
            else:
                at, k = at.right, k - at.left.leaves
        return at

    def find(self, at: int) -> tuple[int, int]:
        """The number of the leaf that holds code point ``at`` (the last one for the end of the text), and its start."""
        node, k, start = self.root, 0, 0
        at = min(at, max(0, node.chars - 1))
        while node.height:
            if at - start < node.left.chars:
                node = node.left
            else:
                k, start, node = k + node.left.leaves, start + node.left.chars, node.right
        return k, start

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replaces code points start to stop."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        # first pre-token that may change: the one before the edit, and further back over white space, on which the pattern looks ahead
        blk, at = self.find(max(0, start - 1))
        own = self.leaf(blk).pieces
        ends, e = [], at
        for p in own:
            e += len(p)
            ends.append(e)
        i = min(bisect_right(ends, max(0, start - 1)), max(0, len(own) - 1))
        at = ends[i - 1] if i else at
        while (blk or i) and at:
            if i == 0:
                blk -= 1
                own = self.leaf(blk).pieces
                i = len(own)
            i -= 1
            at -= len(own[i])
            if not own[i].isspace():
                break
        # new pre-tokens from there, in growing spans, until a border after the edit is an old one too
        moved = len(replacement) - (stop - start)
        text = self.text[:start] + replacement + self.text[stop:]
        last = self.root.leaves - 1
        span = max(64, start - at + len(replacement) + 32)
        while True:
            part = text[at : at + span]
            whole = at + span >= len(text)
            fresh = self.count.split(part)
            if not whole:
                # the pattern may still look beyond the span: its last pieces are not certain
                while fresh and len(fresh) > 1 and fresh[-1].isspace():
                    fresh.pop()
                fresh = fresh[:-2]
            new: list[str] = []
            pos, met = at, False
            old_blk, old, old_i, old_end = blk, self.leaf(blk), i, at
            for p in fresh:
                new.append(p)
                pos += len(p)
                if pos < start + len(replacement):
                    continue
                while old_end < pos - moved or old_end < stop:
                    if old_i >= len(old.pieces):
                        if old_blk == last:
                            break
                        old_blk, old_i = old_blk + 1, 0
                        old = self.leaf(old_blk)
                        continue
                    old_end += len(old.pieces[old_i])
                    old_i += 1
                if old_end == pos - moved and old_end >= stop and not p.isspace():
                    met = True
                    break
            if met or whole:
                break
            span *= 2
        if not met:
            old_blk, old = last, self.leaf(last)
            old_i = len(old.pieces)
        self.text = text
        self.encoded += len(new)
        first = self.leaf(blk)
        pieces, counts = first.pieces[:i] + new + old.pieces[old_i:], first.counts[:i] + self.count.many(new) + old.counts[old_i:]
        left, rest = split(self.root, blk)
        right = split(rest, old_blk - blk + 1)[1]
        own_leaves = [Leaf(pieces, counts)] if pieces and len(pieces) <= 2 * LEAF else self._leaves(pieces, counts)
        self.root = join(join(left, build(own_leaves)), right) or Leaf([], [])


SCHEMA = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, n_pretokens long, reencoded long"


def count_edits(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """docs: doc_id, text, edits (array of structs start, stop, replacement, applied in order; null: none) -> ``SCHEMA``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in slices(batches):
            rows = []
            for doc_id, text, edits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "edits")), strict=True):
                t = CountedText(text or "", count)
                chars, tokens, pre = len(t.text), t.tokens, t.pretokens
                for e in edits or ():
                    t.edit(e["start"], e["stop"], e["replacement"] or "")
                rows.append((doc_id, chars, tokens, len(t.text), t.tokens, pre, t.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits")
    return rows.mapInArrow(run, SCHEMA)


def sample_edits(text: str = "text"):
    """Edits that every text gets in the query: a word typed at a quarter, ten code points cut at half, the last twenty replaced."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    edit = lambda a, b, r: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(r).alias("replacement"))
    quarter, half = F.floor(n / 4), F.floor(n / 2)
    return F.array(edit(quarter, quarter, " revised"), edit(half, half + 10, ""), edit(F.greatest(n - 20, F.lit(0)), n + 8, " The end.\n"))
