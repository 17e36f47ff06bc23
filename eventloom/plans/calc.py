"""An expression language over record members, compiled to column expressions.

    TOTAL = PRICE * QTY; if TOTAL > 100 then SIZE = "big"; else SIZE = "small"; endif;
    #n[USER]++; enqueue(#w[USER], 5, VALUE); MEAN = qavg(#w[USER]); #PASS = #n[USER] > 3;

Names are members (a missing one is 0), ``#name`` registers: plain assignments last for the record, while ``+=``, ``-=``,
``++`` and ``--`` accumulate along the order of the records, for each key if one is given in brackets. ``enqueue`` keeps
the last n values, over which the q-functions work. ``#PASS`` and ``#FAIL`` filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEX = re.compile(
    r'\s*(?:(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+[eE][+-]?\d+|0[xX][0-9a-fA-F]+|\d+)|"(?P<str>(?:[^"\\]|\\.)*)"'
    r"|(?P<name>\#?[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>\*\*|<<=|>>=|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%<>=!&|^~()\[\],;]))",
    re.S,
)
#: Binary operators, loosest first; all associate to the left.
_LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%", "**")]
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "|=", "^="}
_MATH = {"sin": F.sin, "cos": F.cos, "atan": F.atan, "ln": F.ln, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "round": F.round}
_QUEUE = {"qcount", "qsum", "qavg", "qmax", "qmin", "qspan", "qvar", "qstdev"}
#: Accepted date layouts, tried in this order, in the notation of strptime (fixed values).
DATE_FORMATS = (
    "%a, %d %b %Y %T %Z",
    "%a %d %b %Y %T %Z",
    "%a %b %d %Y %T %Z",
    "%a, %d-%b-%Y %T %Z",
    "%a %d-%b-%Y %T %Z",
    "%d %b %Y %T %Z",
    "%a %b %d %T %Z %Y",
    "%c",
    "%R",
    "%A %B %d, %Y, %H:%M:%S",
    "%Y-%m-%d %I:%M:%S %p",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %I:%M %p",
    "%m/%d/%y %I:%M %p",
    "%m/%d/%Y %I:%M %p",
    "%m/%d/%y %I:%M:%S %p",
    "%m/%d/%Y %I:%M:%S %p",
)
#: Further ones of this library.
MORE_DATE_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DATE_PARTS = {
    "a": "(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?", "b": "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)",
    "d": r"(\d{1,2}+)", "m": r"(\d{1,2}+)", "Y": r"(\d{1,4}+)", "y": r"(\d{1,2}+)", "H": r"(\d{1,2}+)", "I": r"(\d{1,2}+)", "M": r"(\d{1,2}+)", "S": r"(\d{1,2}+)", "p": "([ap]m)", "Z": r"\S*+",
}


def date_layout(layout: str) -> tuple[str, list[str]]:
    """A regular expression for texts that begin in a strptime layout, and what its groups hold."""
    for short, long in (("%c", "%a %b %d %H:%M:%S %Y"), ("%T", "%H:%M:%S"), ("%R", "%H:%M"), ("%A", "%a"), ("%B", "%b")):
        layout = layout.replace(short, long)
    out, groups = "", []
    for m in re.finditer(r"%(\w)|(\s+)|([^%\s])", layout):
        if m[1]:
            out += r"\s*" + _DATE_PARTS[m[1]]
            groups += [m[1]] if "(" in _DATE_PARTS[m[1]].replace("(?:", "") else []
        else:
            out += r"\s*" if m[2] else re.escape(m[3])
    return f"(?i)^{out}", groups


_DATE_GROUPS = "YymbdHIMSp"


def date_parts(c: Column) -> Column:
    """The parts of a text in the first layout that it begins in, in the order of _DATE_GROUPS, empty where it has none; NULL if there is none."""
    found = []
    for pattern, groups in map(date_layout, (*DATE_FORMATS, *MORE_DATE_FORMATS)):
        parts = "|".join(f"${groups.index(g) + 1}" if g in groups else "" for g in _DATE_GROUPS)
        found.append(F.when(c.rlike(pattern), F.regexp_replace(c, f"{pattern}(?s:.*)", parts)))
    return F.split(F.coalesce(*found), r"\|")


def parse_date(parts: Column) -> Column:
    """The time of ``date_parts``; time zone names are read and not applied."""
    part = {g: F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i, g in enumerate(_DATE_GROUPS)}
    number = {g: v.cast("int") for g, v in part.items() if g not in "bp"}
    year = F.coalesce(number["Y"], number["y"] + F.when(number["y"] < 69, 2000).otherwise(1900), F.lit(1899))
    month = F.coalesce(number["m"], F.floor((F.instr(F.lit(" ".join(_MONTHS)), F.lower(F.substring(part["b"], 1, 3))) + 3) / 4).cast("int"), F.lit(12))
    hour = F.coalesce(number["H"], number["I"] % 12 + F.when(F.lower(part["p"]) == "pm", 12).otherwise(0))
    second = F.coalesce(number["S"], F.lit(0)).cast("decimal(16,6)")
    minute = F.coalesce(number["M"], F.when(number["Y"].isNotNull(), 0))
    hour = F.coalesce(hour, F.when(number["Y"].isNotNull(), 0))
    return F.try_make_timestamp(year, month, F.coalesce(number["d"], F.lit(31)), hour, minute, second)


class CalcError(ValueError):
    pass


@dataclass
class Value:
    c: Column
    t: str  # int, double, bool, string or time


@dataclass
class _Queue:
    key: str
    size: int
    value: Value


@dataclass
class _Scope:
    df: DataFrame
    order: str
    members: dict[str, Value] = field(default_factory=dict)
    registers: dict[str, Value] = field(default_factory=dict)
    queues: dict[str, _Queue] = field(default_factory=dict)
    labels: list[tuple[Column, str]] = field(default_factory=list)
    flush: list[Column] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)  # of keyed variables
    tmp: int = 0


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise CalcError(f"unexpected text: {text[at:at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind and kind != "comment":
            out.append((kind, m[kind]))
    return out


class _Compiler:
    def __init__(self, script: str, scope: _Scope):
        self.toks, self.at, self.s = tokens(script), 0, scope

    # ---- tokens ----

    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return self.toks[i][1] if i < len(self.toks) and self.toks[i][0] != "str" else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.toks):
            raise CalcError("unexpected end")
        self.at += 1
        return self.toks[self.at - 1]

    def take(self, op: str) -> bool:
        if self.peek() == op:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise CalcError(f"{op!r} expected, not {self.peek()!r}")

    # ---- statements ----

    def program(self) -> None:
        while self.at < len(self.toks):
            self.statement(None)

    def block(self, ends: set[str], when: Column | None) -> None:
        while self.peek() not in ends:
            self.statement(when)

    def statement(self, when: Column | None) -> None:
        if self.take(";"):
            return
        if self.take("if"):
            cond = self.keep(_bool(self.expr()))
            self.need("then")
            both = lambda c: c if when is None else when & c
            self.block({"else", "endif"}, both(cond))
            if self.take("else"):
                self.block({"endif"}, both(~cond))
            self.need("endif")
            self.take(";")
            return
        if self.peek() == "flush":
            self.next()
            self.s.flush.append(self.keep(F.lit(True) if when is None else F.coalesce(when, F.lit(False))))
            self.take(";")
            return
        if self.at >= len(self.toks):
            raise CalcError("unexpected end: endif is missing")
        kind, name = self.toks[self.at]
        if kind != "name" and name not in ("++", "--"):
            raise CalcError(f"a statement can't begin with {name!r}")
        if name == "label" and self.peek(1) == "(":
            self.at += 2
            label = self.next()[1]
            if self.take(","):
                self.assign(self.next()[1], "", self.member(label), "=", when)
            else:
                self.s.labels.append((F.lit(True) if when is None else when, label))
            self.need(")")
        elif name == "enqueue" and self.peek(1) == "(":
            self.at += 2
            reg = self.next()[1]
            key = self.key()
            self.need(",")
            size = int(self.next()[1])
            self.need(",")
            v = self.expr()
            self.need(")")
            held = self.keep(v.c if when is None else F.when(when, v.c))
            self.s.queues[reg + key] = _Queue(key, size, Value(held, v.t))
        elif kind == "op" and name in ("++", "--"):
            self.at += 1
            reg = self.next()[1]
            self.assign(reg, self.key(), Value(F.lit(1), "int"), "+=" if name == "++" else "-=", when)
        else:
            self.next()
            key = self.key()
            op = self.peek()
            if op in ("++", "--"):
                self.at += 1
                self.assign(name, key, Value(F.lit(1), "int"), "+=" if op == "++" else "-=", when)
            elif op in _ASSIGN:
                self.at += 1
                self.assign(name, key, self.expr(), op, when)
            else:
                raise CalcError(f"a statement can't begin with {name!r}")
        if self.at < len(self.toks) and self.peek() not in ("else", "endif"):
            self.need(";")

    def key(self) -> str:
        if not self.take("["):
            return ""
        k = self.next()[1]
        self.need("]")
        return k

    def keep(self, c: Column) -> Column:
        """A helper column, so that later assignments don't change what was computed here."""
        self.s.tmp += 1
        name = f"_calc{self.s.tmp}"
        self.s.df = self.s.df.withColumn(name, c)
        return F.col(name)

    def assign(self, name: str, key: str, v: Value, op: str, when: Column | None) -> None:
        if name.startswith("#"):
            slot = name + key
            if key:
                self.s.keys[slot] = key
            if op in ("+=", "-=") and name not in ("#PASS", "#FAIL"):
                step = v.c if op == "+=" else -v.c
                if when is not None:
                    step = F.when(when, step).otherwise(F.lit(0))
                step = self.keep(F.coalesce(step, F.lit(0)))
                if key:
                    total = F.sum(step).over(W.partitionBy(key).orderBy(self.s.order).rowsBetween(W.unboundedPreceding, 0))
                    total = self.keep(total)
                else:
                    from ..operators.sorts import running_total

                    self.s.tmp += 1
                    out = f"_calc{self.s.tmp}"
                    self.s.df = running_total(self.s.df.withColumn("_step", step), "_step", self.s.order, out).drop("_step")
                    total = F.col(out)
                old = self.s.registers.get(slot)
                self.s.registers[slot] = Value(total if old is None or old.t == "acc" else old.c + total, "double" if v.t == "double" else "int")
                return
            old = self.s.registers.get(slot)
            if op != "=":
                if old is None:
                    raise CalcError(f"{name} {op}: only sums accumulate over records")
                v = self.binary(op[:-1], old, v)
            if when is not None:
                v = Value(F.when(when, v.c).otherwise(old.c if old else F.lit(0 if v.t in ("int", "double", "bool") else None)), v.t)
            self.s.registers[slot] = Value(self.keep(v.c), v.t)
            return
        if op != "=":
            v = self.binary(op[:-1], self.member(name), v)
        c = v.c
        if when is not None:
            have = F.col(name) if name in self.s.df.columns else F.lit(None)
            if name in self.s.df.columns and self.type_of(name) != v.t and v.t != "int":
                have = have.cast(_SPARK[v.t])
            c = F.when(when, c).otherwise(have)
        self.s.df = self.s.df.withColumn(name, c)

    # ---- expressions ----

    def type_of(self, name: str) -> str:
        t = self.s.df.select(name).schema[0].dataType
        if isinstance(t, T.StringType | T.BinaryType):
            return "string"
        if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
            return "time"
        if isinstance(t, T.BooleanType):
            return "bool"
        return "int" if isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0 else "double"

    def member(self, name: str) -> Value:
        if name.split(".")[0] not in self.s.df.columns:
            return Value(F.lit(0), "int")
        t = self.type_of(name)
        c = F.col(name)
        if t in ("int", "double"):
            c = F.coalesce(c, F.lit(0).cast(_SPARK[t]))
        return Value(c, t)

    def expr(self, level: int = 0) -> Value:
        if level == len(_LEVELS):
            return self.unary()
        left = self.expr(level + 1)
        while (op := self.peek()) in _LEVELS[level] and self.toks[self.at][0] == "op":
            self.at += 1
            left = self.binary(op, left, self.expr(level + 1))
        return left

    def unary(self) -> Value:
        if self.take("-"):
            v = self.unary()
            return Value(-v.c, v.t)
        if self.take("!"):
            return Value(~_bool(self.unary()), "bool")
        if self.take("~"):
            return Value(F.bitwise_not(self.unary().c.cast("long")), "int")
        return self.primary()

    def primary(self) -> Value:
        kind, text = self.next()
        if kind == "num":
            if text[:2].lower() == "0x":
                return Value(F.lit(int(text, 16)), "int")
            return Value(F.lit(float(text)), "double") if re.search(r"[.eE]", text) else Value(F.lit(int(text)).cast("long"), "int")
        if kind == "str":
            return Value(F.lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text)), "string")
        if text == "(":
            v = self.expr()
            self.need(")")
            return v
        if kind != "name":
            raise CalcError(f"unexpected {text!r}")
        if self.peek() == "(":
            return self.call(text)
        if text.startswith("#"):
            slot = text + self.key()
            return self.s.registers.get(slot, Value(F.lit(0), "int"))
        return self.member(text)

    def call(self, name: str) -> Value:
        self.need("(")
        if name == "exists":
            member = self.next()[1]
            self.need(")")
            return Value(F.col(member).isNotNull() if member.split(".")[0] in self.s.df.columns else F.lit(False), "bool")
        if name == "cast":
            to = self.next()[1]
            self.need(",")
            v = self.expr()
            self.need(")")
            return _cast(v, to)
        if name in _QUEUE:
            slot = self.next()[1] + self.key()
            self.need(")")
            return self.queue(name, slot)
        args = []
        if not self.take(")"):
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
            self.need(")")
        c = [a.c for a in args]
        if name in _MATH:
            out = _MATH[name](c[0])
            return Value(out.cast("double"), "double") if name not in ("abs",) else Value(out, args[0].t)
        if name == "trunc":
            return Value(F.when(c[0] < 0, F.ceil(c[0])).otherwise(F.floor(c[0])).cast("double"), "double")
        if name == "strlen":
            return Value(F.octet_length(c[0].cast("string")).cast("long"), "int")
        if name == "strfind":
            return Value((F.call_function("instr", c[0], c[1]) - 1).cast("long"), "int")
        if name == "substr":
            n = F.when(c[2] < 0, F.length(c[0])).otherwise(c[2]) if len(c) > 2 else F.length(c[0])
            return Value(F.substring(c[0], c[1].cast("int") + 1, n.cast("int")), "string")
        if name == "strRepl":
            at = F.call_function("instr", c[0], c[1])
            return Value(F.when(at > 0, F.concat(F.substring(c[0], F.lit(1), at - 1), c[2], F.substring(c[0], at + F.length(c[1]), F.length(c[0])))).otherwise(c[0]), "string")
        if name == "strReplAll":
            return Value(F.replace(c[0], c[1], c[2]), "string")
        if name == "parseDate":
            return Value(self.keep(parse_date(self.keep(date_parts(self.keep(_text(args[0])))))), "time")
        raise CalcError(f"no function {name!r}")

    def queue(self, fn: str, slot: str) -> Value:
        q = self.s.queues.get(slot)
        if q is None:
            return Value(F.lit(0), "int")
        if not q.key:
            raise CalcError("a queue without a key would pass all rows through one task: give it one, as in #w[KEY]")
        w = W.partitionBy(q.key).orderBy(self.s.order).rowsBetween(-(q.size - 1), 0)
        v = q.value.c
        out = {
            "qcount": lambda: F.count(v).over(w), "qsum": lambda: F.sum(v).over(w), "qavg": lambda: F.avg(v).over(w), "qmax": lambda: F.max(v).over(w), "qmin": lambda: F.min(v).over(w),
            "qspan": lambda: F.max(v).over(w) - F.min(v).over(w), "qvar": lambda: F.var_pop(v).over(w), "qstdev": lambda: F.stddev_pop(v).over(w),
        }[fn]()
        return Value(self.keep(out), "int" if fn == "qcount" else q.value.t if fn not in ("qavg", "qvar", "qstdev") else "double")

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            return Value(_bool(a) & _bool(b) if op == "&&" else _bool(a) | _bool(b), "bool")
        if op in ("==", "!=", "<", "<=", ">", ">="):
            x, y = (a.c.cast("string"), b.c.cast("string")) if "string" in (a.t, b.t) else (a.c, b.c)
            return Value({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
        if op in ("<<", ">>", "&", "|", "^"):
            if "double" in (a.t, b.t) or "string" in (a.t, b.t):
                raise CalcError(f"{op} needs integers")
            x, y = a.c.cast("long"), b.c.cast("long")
            if op in ("<<", ">>"):
                return Value(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int")), "int")
            return Value({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y), "int")
        if "time" in (a.t, b.t):
            if op == "-" and a.t == b.t:
                return Value((F.unix_micros(a.c) - F.unix_micros(b.c)) / 1_000_000, "double")
            if op in "+-" and a.t == "time":
                micros = F.unix_micros(a.c) + (F.lit(1) if op == "+" else F.lit(-1)) * (b.c.cast("double") * 1_000_000).cast("long")
                return Value(F.timestamp_micros(micros), "time")
            raise CalcError(f"{op} on times")
        if "string" in (a.t, b.t):
            if op != "+":
                raise CalcError(f"{op} on text")
            return Value(F.concat(_text(a), _text(b)), "string")
        t = "double" if "double" in (a.t, b.t) else "int"
        x, y = (v.c.cast("int") if v.t == "bool" else v.c for v in (a, b))
        if op == "+":
            return Value(x + y, t)
        if op == "-":
            return Value(x - y, t)
        if op == "*":
            return Value(x * y, t)
        if op == "**":
            p = F.pow(x, y)
            return Value(p.cast("long") if t == "int" else p, t)
        if op == "/":
            return Value(F.when(y != 0, F.call_function("div", x.cast("long"), y.cast("long"))) if t == "int" else F.try_divide(x.cast("double"), y.cast("double")), t)
        if op == "%":
            if t == "double":
                raise CalcError("% needs integers")
            return Value(F.when(y != 0, x % y), "int")
        raise CalcError(op)


_SPARK = {"int": "long", "double": "double", "bool": "boolean", "string": "string", "time": "timestamp"}


def _text(v: Value) -> Column:
    return v.c.cast("string")


def _bool(v: Value) -> Column:
    return v.c if v.t == "bool" else F.coalesce(v.c.cast("string") != "", F.lit(False)) if v.t == "string" else v.c.isNotNull() if v.t == "time" else v.c != 0


def _cast(v: Value, to: str) -> Value:
    if to in ("int", "uint"):
        c = F.unix_seconds(v.c) if v.t == "time" else F.when(v.c.cast("double") < 0, F.ceil(v.c.cast("double"))).otherwise(F.floor(v.c.cast("double"))) if v.t == "double" else v.c.try_cast("long")
        c = c.cast("long")
        return Value(F.greatest(c, F.lit(0)) if to == "uint" and v.t != "time" else c, "int")
    if to == "double":
        return Value(F.unix_micros(v.c) / 1_000_000 if v.t == "time" else v.c.try_cast("double"), "double")
    if to == "bool":
        return Value(_bool(v), "bool")
    if to == "string":
        return Value(v.c.cast("string"), "string")
    if to == "time":
        return Value(F.try_to_timestamp(v.c) if v.t == "string" else F.timestamp_micros((v.c.cast("double") * 1_000_000).cast("long")), "time")
    raise CalcError(f"no type {to!r}")


def calc(df: DataFrame, script: str, order: str = "event_id", last_only: bool = False) -> DataFrame:
    """Runs a script on every record.

    A ``flush`` statement ends an epoch with its record: the member ``epoch`` counts the epochs from 0, as ``flush_epochs`` does.
    With ``last_only`` the records don't pass: the result has a row for each key, with the last values of the keyed variables.
    """
    from ..operators.shape import add_label
    from ..operators.sorts import running_total

    s = _Scope(df, order)
    _Compiler(script, s).program()
    out = s.df
    if last_only:
        keyed = {slot: v for slot, v in s.registers.items() if slot in s.keys}
        by = {s.keys[slot] for slot in keyed}
        if len(by) != 1:
            raise CalcError("only the last values: the script needs variables with one key")
        (key,) = by
        last = [F.max_by(v.c, order).alias(slot.removeprefix("#").removesuffix(key)) for slot, v in keyed.items()]
        return out.where(F.col(key).isNotNull()).groupBy(key).agg(*last)
    for when, label in s.labels:
        out = add_label(out, label, when)
    if s.flush:
        ends = F.greatest(*[c.cast("int") for c in s.flush], F.lit(0)).cast("long")
        out = running_total(out.withColumn("_calc_end", ends), "_calc_end", order, "_calc_ends").withColumn("epoch", (F.col("_calc_ends") - F.col("_calc_end")).cast("long"))
    if "#PASS" in s.registers:
        out = out.where(_bool(s.registers["#PASS"]))
    if "#FAIL" in s.registers:
        out = out.where(~_bool(s.registers["#FAIL"]))
    return out.drop(*[c for c in out.columns if c.startswith("_calc")])
