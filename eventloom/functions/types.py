"""Type detection of ingested fields and virtual members of values."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = re.compile(r"-?\d+")
_FLOAT = re.compile(r"-?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?")
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(Z|\.\d+Z?)?")


def kind(text: str) -> str:
    """uint, uint64 (ten characters and more), int, int64, double, time or string; one leading space is ignored."""
    t = text[1:] if text.startswith(" ") else text
    if _TIME.fullmatch(t):
        return "time"
    if _INT.fullmatch(t):
        if t[0] == "-":
            return "int" if len(t) < 10 else "int64"
        return "uint" if len(t) < 10 else "uint64"
    if _FLOAT.fullmatch(t) and any(ch.isdigit() for ch in t):
        return "double"
    return "string"


def detect(text: str):
    """The Python value of a constant by the rules of ``kind``."""
    k, t = kind(text), text[1:] if text.startswith(" ") else text
    if k in ("uint", "uint64", "int", "int64"):
        return int(t) if abs(int(t)) < 2**63 else t
    if k == "double":
        return float(t)
    if k == "time":
        return dt.datetime.fromisoformat(t.replace(" ", "T").replace("Z", "+00:00"))
    return text


def detected_kind(c: Column) -> Column:
    """``kind`` of every value of a string column; NULL for NULL and empty text."""
    t = F.regexp_replace(c, "^ ", "")
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(t.rlike(rf"^(?:{_TIME.pattern})$"), "time")
        .when(t.rlike(r"^-\d+$"), F.when(F.length(t) < 10, "int").otherwise("int64"))
        .when(t.rlike(r"^\d+$"), F.when(F.length(t) < 10, "uint").otherwise("uint64"))
        .when(t.rlike(rf"^(?:{_FLOAT.pattern})$"), "double")
        .otherwise("string")
    )


def typed(c: Column) -> Column:
    """A struct (kind, i, d, t, s) with the value in the member of its kind, for free-form fields."""
    k, t = detected_kind(c), F.regexp_replace(c, "^ ", "")
    return F.struct(
        k.alias("kind"),
        F.when(k.isin("uint", "uint64", "int", "int64"), t.try_cast("decimal(20,0)")).alias("i"),
        F.when(k == "double", t.try_cast("double")).alias("d"),
        F.when(k == "time", F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))).alias("t"),
        F.when(k == "string", c).alias("s"),
    )


def member(c: Column, name: str, of: str = "string") -> Column:
    """Virtual members: LENGTH, UINT, UINT64, INT, INT64, DOUBLE, DATETIME, STRING, ROUND, TRUNC, FLOOR, CEIL."""
    n = name.upper()
    if n == "LENGTH":
        return F.octet_length(c)
    if n in ("UINT", "UINT64"):
        v = c.try_cast("decimal(20,0)")
        return F.when((v >= 0) & (v < 2 ** (32 if n == "UINT" else 64)), v)
    if n in ("INT", "INT64"):
        return c.try_cast("int" if n == "INT" else "long")
    if n == "DOUBLE":
        return c.try_cast("double")
    if n == "STRING":
        return c.cast("string")
    if n == "DATETIME":
        return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")) if of == "string" else F.timestamp_micros((c.cast("double") * 1e6).cast("long"))
    if n == "ROUND":
        return F.round(c).cast("long")
    if n == "TRUNC":
        return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
    if n in ("FLOOR", "CEIL"):
        return (F.floor if n == "FLOOR" else F.ceil)(c).cast("long")
    raise ValueError(name)
