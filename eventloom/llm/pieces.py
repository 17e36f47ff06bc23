"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the boundaries of a text; from each it extends the paths by the pieces that begin there, so it needs
the last ``longest`` boundaries only. Ids are committed as soon as the back pointers of all boundaries that can still be
continued from meet in one boundary. With a unigram model a path's score is the sum of its pieces' scores; of equal sums the
one whose last piece is longest counts. With a byte-pair model a step from one piece to the next is allowed if merging the
two pieces' characters in the model's order gives just these two pieces again; then exactly one path reaches each boundary,
and it is the encoding that the merges give, so the ids are those of the SentencePiece library.

No piece crosses the border between two words, so all paths meet there: every word ends in a commit, and the ids between two
such borders depend on nothing else. Those of words seen before are remembered (two generations of a bounded size) and
committed at once; the search runs over the others, whatever their length.

Null text is empty: no ids. Decoding gives the text back, but for U+2581, which the model reads as a space; null ids give null.
Repeated rows each get a row. Empty table: empty result. Of the input's columns those in ``keep`` stay, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .text import slices

SPACE = "▁"
_loaded: dict[tuple, object] = {}


class PieceModel:
    """The pieces of a SentencePiece model file and their scores."""

    def __init__(self, path: str, kind: str = "bpe", remembered: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.remembered = kind, remembered
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(text) if not special[i] and not byte[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(text[i][1:-1], 16): i for i in range(n) if byte[i]}
        self.unknown = sp.unk_id()
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.plain = [None if special[i] else bytes([int(text[i][1:-1], 16)]) if byte[i] else text[i].replace(SPACE, " ").encode() for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece crosses words")
        # a line break that no piece has is a border too
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if any("\n" in p for p in self.ids) else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        # characters lead on, the empty string leads to the piece that ends there
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = p
        self.stable: dict[str, dict[str, bool]] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    # ---- byte-pair models ----

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives, best score first, then leftmost; for short texts."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, a: str, b: str) -> bool:
        row = self.stable.setdefault(a, {})
        ok = row.get(b)
        if ok is None:
            if len(row) > 5000:  # bounds the memory: pieces times this
                row.clear()
            ok = row[b] = self.merged(a + b) == [a, b]
        return ok

    # ---- the search ----

    def stream(self, chunks: Iterable[str]) -> Iterator[list[str]]:
        """Pieces of the joined chunks, committed as they become certain."""
        longest, trie, nothing, stable, score, bpe = self.longest, self.trie, {}, self.stable, self.score, self.kind == "bpe"
        text, at = "", 0  # the retained window; the next boundary to extend from
        last: list[str | None] = [""]  # the piece that ends at each retained boundary (None: out of reach, "": the start)
        total = [0.0]
        source, more = iter(chunks), True
        while more:
            chunk = next(source, None)
            more = chunk is not None
            text += chunk or ""
            n = len(text)
            last += [None] * (n + 1 - len(last))
            total += [0.0] * (n + 1 - len(total))
            # pieces that may go on in the next chunk wait for it
            ready = n - longest + 1 if more else n
            while at < ready:
                q, node = last[at], trie
                if q is None:
                    at += 1
                    continue
                row = stable.get(q)
                for k in range(at, min(n, at + longest)):
                    node = node.get(text[k], nothing)
                    if bpe and last[k + 1] is not None:
                        if node is nothing:
                            break
                        continue
                    # a character is a piece, known or not
                    p = node.get("") or (text[k] if k == at else None)
                    if p is None:
                        if node is nothing:
                            break
                    elif not bpe:
                        s = total[at] + score.get(p, self.lowest)
                        if last[k + 1] is None or s > total[k + 1]:
                            last[k + 1], total[k + 1] = p, s
                    else:
                        ok = True if not q else row.get(p) if row is not None else None
                        if ok is None:
                            ok = self._stable(q, p)
                            row = stable[q]
                        if ok:
                            last[k + 1] = p
                at += 1
            if more and at > 2 * longest:
                # where the paths to all boundaries that can still be extended from meet
                heads = {k for k in range(at, n + 1) if last[k] is not None}
                while len(heads) > 1:
                    k = max(heads)
                    heads.remove(k)
                    heads.add(k - len(last[k]))
                if done := heads.pop():
                    yield self._back(last, done)
                    # what is committed stays as context of the next step
                    text, last, total, at = text[done:], [last[done] if bpe else "", *last[done + 1 :]], total[done:], at - done
        if len(last) > 1:
            yield self._back(last, len(last) - 1)

    @staticmethod
    def _back(last: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit between two borders in which all paths meet."""
        step = 8 * self.longest
        chunks = (unit,) if len(unit) <= step else (unit[k : k + step] for k in range(0, len(unit), step))
        pieces = [p for part in self.stream(chunks) for p in part]
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[x] for x in p.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        young, old = self.young, self.old
        for u in self.units(SPACE + text.replace(" ", SPACE)):
            ids = young.get(u)
            if ids is None:
                ids = old.get(u) or self._unit(u)
                if len(u) <= 48:
                    if len(young) >= self.remembered:
                        self.old, self.young = old, young = young, {}
                    young[u] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; invalid bytes become U+FFFD, control ids nothing."""
        plain = self.plain
        raw = b"".join([p for i in ids if (p := plain[i]) is not None])
        return raw[raw.startswith(b" ") :].decode(errors="replace")


def piece_model(name: str = "piece_bpe_32k.model", kind: str = "bpe") -> PieceModel:
    """One for each process and file; ``name`` is a public tokenizer's or a path."""
    key = (name, kind)
    if key not in _loaded:
        import public_tokenizers

        _loaded[key] = PieceModel(name if "/" in name else public_tokenizers.path(name), kind)
    return _loaded[key]


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ids (array of int) of every text."""
    return _mapped(docs, keep, "ids array<int>", lambda m, texts: [pa.array([m.encode(t) if t else [] for t in texts], pa.list_(pa.int32()))], name, kind)


def decode(rows: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and text of the ids column; null ids: null."""
    return _mapped(rows, keep, "text string", lambda m, ids: [pa.array([None if i is None else m.decode(i) for i in ids], pa.string())], name, kind, "ids")


def digest(docs: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and whether decoding gives the text back."""

    def run(m: PieceModel, texts: list) -> list:
        n, crc, same = [], [], []
        for t in texts:
            ids = m.encode(t or "")
            n.append(len(ids))
            crc.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
            same.append(m.decode(ids) == (t or "").replace(SPACE, " "))
        return [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]

    return _mapped(docs, ("doc_id",), "n_ids long, ids_crc32 long, round_trip boolean", run, name, kind)


def _mapped(rows: DataFrame, keep: tuple[str, ...], made: str, run, name: str, kind: str, column: str = "text") -> DataFrame:
    ship(rows.sparkSession)
    own = rows.select(*keep, F.col(column).alias("_in"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keep)
    names = [*keep, *(c.split()[0] for c in made.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(name, kind)
        for b in slices(batches, "_in") if column == "text" else batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *run(m, b.column("_in").to_pylist())], names=names)

    return own.mapInArrow(each, f"{fields}, {made}")
