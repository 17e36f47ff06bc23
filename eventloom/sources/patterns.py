"""Pattern files: one pattern a line, read through Spark, so that they may lie in any store."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Lines that the driver holds at most; longer lists are tables (``filters.match_table``, ``filters.exact_match``).
MOST = 100_000


@dataclass(frozen=True)
class Pattern:
    text: str
    label: str | None = None
    offset: int = 0
    at_end: bool = False


def unescape(text: str) -> str:
    """``\\x41`` by its character."""
    return re.sub(r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def lines(spark: SparkSession, path: str, most: int = MOST) -> list[str]:
    """The lines of a file but for empty ones and comments (#)."""
    got = [r[0].rstrip("\r") for r in spark.read.text(path).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{path} has more than {most} lines: use a table")
    return [x for x in got if x and not x.startswith("#")]


def labelled(spark: SparkSession, path: str, escapes: bool = True) -> list[Pattern]:
    """``"text" (LABEL)`` or ``{hex digits} (LABEL)`` lines, with ``atend`` and ``offset=n`` after the pattern; other lines are skipped."""
    out = []
    for x in lines(spark, path):
        m = re.match(r'"(.*)"([^"]*)$', x) or re.match(r"\{(.*)\}([^}]*)$", x)
        if not m:
            continue
        text = m[1] if x[0] == '"' else bytes.fromhex(re.sub(r"[^0-9A-Fa-f]", "", m[1])).decode("utf-8", "replace")
        label, offset = re.search(r"\((.*)\)", m[2]), re.search(r"offset=(\d+)", m[2])
        if text:
            out.append(Pattern(unescape(text) if escapes and x[0] == '"' else text, label[1] if label else None, int(offset[1]) if offset else 0, "atend" in m[2]))
    return out
