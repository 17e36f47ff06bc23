"""The pipeline language: operators joined by pipes, named streams, ports, labels and macros.

    events | keyflow user_id -t 1h -> $s
    $s | keycount event_type -P -> $counts
    $a, $b | sort value -> $all          # several streams: their union
    $s.BIG | top value -N 5 -> $big      # rows whose container has the label
    $l:LEFT, $r:RIGHT | jointuple -K id  # inputs by port
    %func f($x -> $y) { $x | firstn user_id -N 2 -> $y }
    %f($s -> $t)

A pipeline begins with streams or with the name of a source (a table given to ``run``); the result of the last pipeline, or
of a stream that is asked for, is a DataFrame.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators import joins
from .registry import ENTRIES, SOURCES, Call, Entry

_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>\#[^\n]*)|(?P<str>"(?:[^"\\]|\\.)*"|'[^']*')|(?P<arrow>->)|(?P<pipe>@?\|\|?)"""
    r"""|(?P<end>;|(?<=\n))|(?P<brace>[{}()])|(?P<comma>,)|(?P<stream>@?\$[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?(?::[A-Za-z_]\w*)?)"""
    r"""|(?P<macro>%[A-Za-z_]\w*)|(?P<word>[^\s|;{}(),]+))"""
)


class GraphError(ValueError):
    pass


def expand(text: str, env: Mapping[str, str]) -> str:
    """${NAME} by its value, nested ones too."""
    for _ in range(100):
        new = re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), text)
        if new == text:
            return new
        text = new
    raise GraphError("variables expand without end")


def statements(text: str) -> list[list[tuple[str, str]]]:
    """Tokens of each statement; a statement ends at a line's end (unless it ends in a pipe or comma) or a semicolon."""
    out: list[list[tuple[str, str]]] = [[]]
    depth = 0
    text = re.sub(r"\\\n", " ", text)
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            m = _TOKEN.match(line, at)
            if not m or m.end() == at:
                break
            at = m.end()
            kind = m.lastgroup
            if kind == "comment" or kind is None:
                continue
            v = m[kind]
            if kind == "brace":
                depth += {"{": 1, "}": -1}.get(v, 0)
            if kind == "end" and depth == 0:
                out.append([])
                continue
            out[-1].append((kind, v))
        if depth == 0 and out[-1] and out[-1][-1][0] not in ("pipe", "comma", "arrow"):
            out.append([])
        elif depth and out[-1] and out[-1][-1] != ("brace", "{"):
            out[-1].append(("end", ";"))
    return [s for s in out if s]


class Graph:
    """Runs pipelines over named tables; ``order`` and ``time`` name the arrival order and the event time."""

    def __init__(self, sources: Mapping[str, DataFrame], order: str = "event_id", time: str = "ts", env: Mapping[str, str] | None = None):
        self.sources, self.order, self.time = dict(sources), order, time
        self.env = dict(os.environ if env is None else env)
        self.streams: dict[str, list[DataFrame]] = {}
        self.macros: dict[str, tuple[list[str], list[str], list[tuple[str, str]]]] = {}
        self.result: DataFrame | None = None

    def run(self, text: str, stream: str | None = None) -> DataFrame:
        for s in statements(expand(self._included(text), self.env)):
            self._statement(s, {})
        if stream:
            return self.stream(stream, "")
        if self.result is None:
            raise GraphError("nothing to run")
        return self.result

    def _included(self, text: str, depth: int = 0) -> str:
        """``#include "file"`` lines by the file's text."""
        if depth > 20:
            raise GraphError("files include each other without end")
        one = lambda m: self._included(open(m[1]).read(), depth + 1)
        return re.sub(r'^#include\s+"([^"]+)"', one, text, flags=re.M)

    def stream(self, name: str, label: str) -> DataFrame:
        if name not in self.streams:
            raise GraphError(f"stream ${name} is not known (feedback loops are not supported)")
        df = joins.union(*self.streams[name])
        return joins.with_label(df, label) if label else df

    def _statement(self, toks: list[tuple[str, str]], names: dict[str, str]) -> None:
        kind, v = toks[0]
        if kind == "macro":
            if v == "%func":
                return self._define(toks)
            if v == "%extern":
                return None
            if v == "%thread":
                at = toks.index(("brace", "{"))
                return self._body(toks[at + 1 : -1], names)
            return self._call(toks, names)
        return self._pipeline(toks, names)

    def _body(self, toks: list[tuple[str, str]], names: dict[str, str]) -> None:
        own: list[tuple[str, str]] = []
        depth = 0
        for t in [*toks, ("end", ";")]:
            depth += {"{": 1, "}": -1}.get(t[1], 0) if t[0] == "brace" else 0
            if t[0] == "end" and depth == 0:
                if own and own[-1][0] not in ("pipe", "comma"):
                    self._statement(own, names)
                    own = []
            else:
                own.append(t)

    def _params(self, toks: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
        ins: list[str] = []
        outs: list[str] = []
        into = ins
        for kind, v in toks:
            if kind == "arrow":
                into = outs
            elif kind == "stream":
                into.append(v.lstrip("@$"))
        return ins, outs

    def _define(self, toks: list[tuple[str, str]]) -> None:
        name = toks[1][1]
        a, b = toks.index(("brace", "(")), toks.index(("brace", ")"))
        body = toks.index(("brace", "{"))
        ins, outs = self._params(toks[a + 1 : b])
        end = len(toks) - 1 - [t for t in reversed(toks)].index(("brace", "}"))
        self.macros[name] = (ins, outs, toks[body + 1 : end])

    def _call(self, toks: list[tuple[str, str]], names: dict[str, str]) -> None:
        name = toks[0][1][1:]
        if name not in self.macros:
            raise GraphError(f"no macro {name!r}")
        ins, outs, body = self.macros[name]
        given_in, given_out = self._params(toks[1:])
        if len(ins) != len(given_in) or len(outs) != len(given_out):
            raise GraphError(f"{name} takes {len(ins)} streams and gives {len(outs)}")
        self.version = getattr(self, "version", 0) + 1
        inner: dict[str, str] = {}
        for mine, theirs in zip(ins + outs, given_in + given_out, strict=True):
            inner[mine] = names.get(theirs, theirs)
        # streams that the macro alone uses get a name of their own
        inner[""] = f"_{name}{self.version}"
        self._body(body, inner)

    def _name(self, name: str, names: dict[str, str]) -> str:
        if name in names:
            return names[name]
        return f"{name}{names['']}" if "" in names else name

    def _pipeline(self, toks: list[tuple[str, str]], names: dict[str, str]) -> None:
        parts: list[list[tuple[str, str]]] = [[]]
        targets: list[str] = []
        after = False
        for t in toks:
            if t[0] == "pipe":
                parts.append([])
            elif t[0] == "arrow":
                after = True
            elif after and t[0] == "stream":
                targets.append(self._name(t[1].lstrip("@$"), names))
            elif t[0] != "end":
                parts[-1].append(t)
        inputs: dict[str, list[DataFrame]] = {}
        first = parts[0]
        if first and first[0][0] == "stream":
            for kind, v in first:
                if kind != "stream":
                    continue
                m = re.fullmatch(r"@?\$(\w+)(?:\.(\w+))?(?::(\w+))?", v)
                inputs.setdefault(m[3] or "", []).append(self.stream(self._name(m[1], names), m[2] or ""))
            parts = parts[1:]
        elif first and first[0][1] in self.sources:
            inputs[""] = [self.sources[first[0][1]]]
            parts = parts[1:]
        elif first and first[0][1] in SOURCES:
            inputs[""] = [self._run(SOURCES[first[0][1]], first, {})]
            parts = parts[1:]
        else:
            raise GraphError(f"no source {first[0][1] if first else ''!r}")
        current = {p: joins.union(*dfs) for p, dfs in inputs.items()}
        for p in parts:
            current = {"": self._apply(p, current)}
        self.result = next(iter(current.values())) if len(current) == 1 else joins.union(*current.values())
        for t in targets:
            self.streams.setdefault(t, []).append(self.result)

    def _apply(self, toks: list[tuple[str, str]], inputs: dict[str, DataFrame]) -> DataFrame:
        if not toks:
            raise GraphError("an operator is missing between two pipes")
        name = toks[0][1]
        if ":" in name and name.split(":")[-1] in ENTRIES:
            port, name = name.split(":", 1)
            inputs = {port: joins.union(*inputs.values())}
        if name not in ENTRIES:
            raise GraphError(f"no operator {name!r}")
        return self._run(ENTRIES[name], toks, inputs)

    def _run(self, e: Entry, toks: list[tuple[str, str]], inputs: dict[str, DataFrame]) -> DataFrame:
        name = e.name
        words = [v[1:-1].replace('\\"', '"') if k == "str" else v for k, v in toks]
        quoted = [k == "str" for k, _ in toks]
        args: list[str] = []
        opts: dict[str, str | bool] = {}
        i = 1
        while i < len(words):
            w = words[i]
            if not quoted[i] and len(w) > 1 and w[0] == "-" and not re.fullmatch(r"-\d.*", w) or not quoted[i] and re.fullmatch(r"-\d", w) and e.takes_value(w[1]) is not None:
                takes = e.takes_value(w[1])
                if takes is None:
                    raise GraphError(f"{name} has no option {w}")
                if takes and len(w) == 2:
                    i += 1
                    if i >= len(words):
                        raise GraphError(f"{name} {w} needs a value")
                    opts[w[1]] = f"{opts[w[1]]} {words[i]}" if w[1] in opts else words[i]
                elif takes:
                    opts[w[1]] = f"{opts[w[1]]} {w[2:]}" if w[1] in opts else w[2:]
                else:
                    for letter in w[1:]:
                        opts[letter] = True
            else:
                args.append(w)
            i += 1
        if lost := sorted(o for o in opts if o in e.refused):
            raise GraphError(f"{name}: -{lost[0]} is not available here and would change the result")
        return e.run(Call(inputs, args, opts, self.order, self.time, self.env))


def run(text: str, sources: Mapping[str, DataFrame], stream: str | None = None, **kw) -> DataFrame:
    """The result of a pipeline text over named tables."""
    return Graph(sources, **kw).run(text, stream)
