"""Functions of text and byte members, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buffers, and bytes of them, whose byte values are counted at once.
_ROWS, _BYTES = 1024, 1 << 20


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_chars(c: Column | str, chars: str) -> Column:
    """How many characters of the text are in a set."""
    return F.length(_c(c)) - F.length(F.translate(_c(c), chars, ""))


def from_hex(c: Column | str, ignore: str = "", strict: bool = False) -> Column:
    """Bytes of a hexadecimal text; ``strict``: NULL unless all of it is hexadecimal, otherwise other characters are left out."""
    t = F.translate(_c(c), ignore, "") if ignore else _c(c)
    digits = F.regexp_replace(t, "[^0-9A-Fa-f]", "")
    if strict:
        return F.when(t.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(t))
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.substring(digits, F.lit(1), F.length(digits) - 1)).otherwise(digits))


def from_base64(c: Column | str, url_safe: bool = False) -> Column:
    """NULL where it isn't base64."""
    return F.try_to_binary(F.translate(_c(c), "-_", "+/") if url_safe else _c(c), F.lit("base64"))


def to_base64(c: Column | str) -> Column:
    return F.regexp_replace(F.base64(_c(c).cast("binary")), "[\r\n]", "")


def combine(cols: list[Column | str], separator: str = " ") -> Column:
    """Texts joined by a separator; empty and missing ones are left out."""
    return F.concat_ws(separator, *[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


def edit_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_c(a), _c(b))


def edit_norm(a: Column | str, b: Column | str) -> Column:
    """The distance over the longer length (0 for two empty texts)."""
    most = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(_c(a), _c(b)) / most)


def byte_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which text and how often, for each byte value that occurs in a text."""
    ends = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    cells = len(texts) * 256
    if len(data) < cells:  # short texts: sorting costs less than a table of all byte values
        of, k = np.unique(np.repeat(np.arange(0, cells, 256), np.diff(ends)) + data, return_counts=True)
        return of >> 8, k
    table = np.zeros(cells, np.int64)
    for at in range(0, len(data), _BYTES):
        part = data[at : at + _BYTES]
        table += np.bincount(np.repeat(np.arange(0, cells, 256), np.diff(np.clip(ends, at, at + len(part)))) + part, minlength=cells)
    of = np.flatnonzero(table)
    return of >> 8, table[of]


def _entropy(of: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = k / n[of]
    return np.bincount(of, -p * np.log2(p), len(n))


def _chi_square(of: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    # the sum of (k - n / 256)^2 / (n / 256) over all byte values, multiplied out
    return 256.0 * np.bincount(of, np.square(k, dtype=float), len(n)) / np.maximum(n, 1) - n


def _of_bytes(c: Column | str, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """A measure of the byte counts of each buffer; NULL for an empty one."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        texts, out = [x or b"" for x in s], [np.zeros(0)]
        for i in range(0, len(texts), _ROWS):
            part = texts[i : i + _ROWS]
            out.append(measure(*byte_counts(part), np.array(list(map(len, part)))))
        return pd.Series(np.concatenate(out))

    b = _c(c).cast("binary")
    return F.when(F.octet_length(b) > 0, run(b))


def entropy(c: Column | str) -> Column:
    """Shannon entropy of the bytes, in bits; NULL for an empty buffer."""
    return _of_bytes(c, _entropy)


def chi_square(c: Column | str) -> Column:
    """Chi-square of the bytes against an even distribution; NULL for an empty buffer."""
    return _of_bytes(c, _chi_square)


def percent_of(c: Column | str, pattern: str) -> Column:
    """Integer percentage of the bytes of a text whose characters match a one-character pattern of ASCII."""
    n = F.octet_length(_c(c))
    return F.when(n > 0, F.floor(100 * F.octet_length(F.regexp_replace(_c(c), f"[^{pattern}]", "")) / n).cast("int"))


def digest(c: Column | str, algorithm: str = "md5", binary: bool = False) -> Column:
    b = _c(c).cast("binary")
    out = {"md5": lambda: F.md5(b), "sha1": lambda: F.sha1(b), "sha256": lambda: F.sha2(b, 256), "sha512": lambda: F.sha2(b, 512)}[algorithm]()
    return F.unhex(out) if binary else out


def sed(c: Column | str, script: str) -> Column:
    """``s/a/b/`` (first), ``s/a/b/g`` (all), both literal, or ``y/abc/xyz/``."""
    c, kind, cut = _c(c), script[0], script[1]
    a, b, flags = script[2:].split(cut)
    if kind == "y":
        return F.translate(c, a, b)
    if "g" in flags:
        return F.replace(c, F.lit(a), F.lit(b))
    return F.when(F.instr(c, a) > 0, F.concat(F.substring_index(c, a, 1), F.lit(b), F.substring(c, F.instr(c, a) + len(a), F.length(c)))).otherwise(c)


def split(c: Column | str, separator: str, skip: int = 0, most: int | None = None, last: bool = False) -> Column:
    """The non-empty parts between literal separators: without the first ``skip``, at most ``most``; or the last one only."""
    parts = F.filter(F.split(_c(c), re.escape(separator)), lambda x: x != "")
    if last:
        return F.try_element_at(parts, F.lit(-1))
    if skip:
        parts = F.when(F.size(parts) > skip, F.slice(parts, skip + 1, 1_000_000)).otherwise(F.array().cast("array<string>"))
    return F.slice(parts, 1, most) if most else parts


def printable(c: Column | str, least: int = 4, separator: str = " ") -> Column:
    """Runs of at least so many printable ASCII characters, joined."""
    return F.array_join(F.regexp_extract_all(_c(c), F.lit(f"([ -~]{{{least},}})"), F.lit(1)), separator)


def length(c: Column | str) -> Column:
    """Length in bytes."""
    return F.octet_length(_c(c))


def substring(c: Column | str, offset: int, n: int, from_end: bool = False) -> Column:
    """``n`` characters at an offset from the start, or ending at one from the end; NULL if it lies outside."""
    c = _c(c)
    if from_end:
        start = F.length(c) - offset - n
        return F.when(F.length(c) > offset, F.substring(c, F.greatest(start, F.lit(0)) + 1, n + F.least(start, F.lit(0))))
    return F.when(F.length(c) > offset, F.substring(c, offset + 1, n))


def translate(c: Column | str, chars: str, to: str | None = None) -> Column:
    """Deletes the characters of a set, maps all to one character, or each to its counterpart."""
    if to is None:
        return F.translate(_c(c), chars, "")
    return F.translate(_c(c), chars, to * len(chars) if len(to) == 1 else to)


def lower_ascii(c: Column | str) -> Column:
    return F.translate(_c(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_values(c: Column | str, between: str = " ", equals: str = "=") -> Column:
    """A map of ``k=v k2="q v"`` pairs; the last value of a key stays; an empty value is 'NULL'."""
    b, e = re.escape(between), re.escape(equals)
    pairs = F.regexp_extract_all(_c(c), F.lit(rf'([^{b}{e}"]+{e}(?:"[^"]*"|[^{b}]*))'), F.lit(1))
    at = lambda p: F.instr(p, equals)
    entry = lambda p: F.struct(F.substring(p, F.lit(1), at(p) - 1).alias("key"), F.coalesce(F.nullif(F.regexp_replace(F.substring(p, at(p) + len(equals), F.length(p)), '^"|"$', ""), F.lit("")), F.lit("NULL")).alias("value"))
    entries = F.transform(pairs, entry)
    # a later pair of a key wins
    keys = F.transform(entries, lambda x: x["key"])
    kept = F.filter(entries, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), x["key"]))
    return F.map_from_entries(kept)


def bare_tokens(c: Column | str, between: str = " ", equals: str = "=") -> Column:
    """Tokens without a value."""
    plain = F.regexp_replace(_c(c), rf'[^{re.escape(between)}{re.escape(equals)}"]+{re.escape(equals)}(?:"[^"]*"|[^{re.escape(between)}]*)', "")
    return F.filter(F.split(plain, re.escape(between)), lambda x: x != "")


def line(members: list[str], separator: str = ",", labels: bool = False) -> Column:
    """A record as a line of text: values (with their labels) that are present, joined."""
    one = [F.concat(F.lit(f"{m}="), F.col(m).cast("string")) if labels else F.col(m).cast("string") for m in members]
    return F.concat_ws(separator, *one)


def hex_dump(c: Column | str) -> Column:
    """Bytes as pairs of hexadecimal digits with spaces between."""
    return F.trim(F.regexp_replace(F.hex(_c(c).cast("binary")), "(..)", "$1 "))
