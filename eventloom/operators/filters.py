"""Filters and predicates. Ports of a predicate: pass what matches, pass what doesn't, or tag every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shape import LABELS, _all, _any


def select(df: DataFrame, condition: Column, port: str = "", tag: str = "MATCH") -> DataFrame:
    """port '': rows where it holds; 'NOT' or 'INVERSE': the others (also where it is NULL); 'TAG': all, with a boolean."""
    c = F.coalesce(condition, F.lit(False))
    if port == "TAG":
        return df.withColumn(tag, c)
    return df.where(~c if port in ("NOT", "INVERSE") else c)


def has_label(df: DataFrame, labels: Sequence[str], any_of: bool = False, negate: bool = False, at_least: int | None = None) -> DataFrame:
    """Rows that have all (any) of the members or container labels, or at least so many of them."""
    have = [F.col(x).isNotNull() if x in df.columns or "." in x else F.array_contains(F.coalesce(F.col(LABELS), F.array().cast("array<string>")), x) if LABELS in df.columns else F.lit(False) for x in labels]
    c = sum((h.cast("int") for h in have), F.lit(0)) >= at_least if at_least is not None else _any(have) if any_of else _all(have)
    return select(df, c, "NOT" if negate else "")


def match_uint(df: DataFrame, member: str, eq: int | None = None, ne: int | None = None, greater: int | None = None, less: int | None = None, port: str = "") -> DataFrame:
    """An equality shadows an inequality, which shadows the range (both of whose ends must hold); negative values never match."""
    v = F.col(member)
    if eq is not None:
        c = v == eq
    elif ne is not None:
        c = v != ne
    else:
        c = (v > greater if greater is not None else F.lit(True)) & (v < less if less is not None else F.lit(True))
    return select(df, c & (v >= 0), port)


def equal(df: DataFrame, members: Sequence[str], port: str = "", name: str = "EQUALRESULT") -> DataFrame:
    """Rows whose present members are all equal; port TAGASMEMBER adds 0 or 1 instead."""
    c = F.size(F.array_distinct(F.array_compact(F.array(*[F.col(m).cast("string") for m in members])))) <= 1
    return df.withColumn(name, c.cast("int")) if port == "TAGASMEMBER" else df.where(c)


def match(df: DataFrame, members: Sequence[str], patterns: dict[str, str] | Sequence[str], nocase: bool = False, port: str = "", first_only: bool = False, tag: str = "MATCHES", unmatched: str | None = None) -> DataFrame:
    """Substring search for many patterns; pattern -> label. Port TAG gives the labels that match as an array."""
    labels = patterns if isinstance(patterns, dict) else {p: p for p in patterns}
    cols = [F.lower(F.col(m)) if nocase else F.col(m) for m in members]
    hit = {p: _any([F.coalesce(c.contains(p.lower() if nocase else p), F.lit(False)) for c in cols]) for p in labels}
    if port == "TAG":
        found = F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(labels[p])) for p, h in hit.items()])))
        if first_only:
            found = F.slice(found, 1, 1)
        if unmatched:
            found = F.when(F.size(found) == 0, F.array(F.lit(unmatched))).otherwise(found)
        return df.withColumn(tag, found)
    return select(df, _any(list(hit.values())), port)


def match_table(df: DataFrame, member: str, patterns: DataFrame, pattern: str = "pattern", name: str = "label", tag: str = "MATCHES", most: int = 100_000) -> DataFrame:
    """``match`` with a pattern table: an automaton over at most ``most`` patterns, in batches."""
    from ..session import ship

    ship(df.sparkSession)
    rows = patterns.select(pattern, name).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    words = [(r[0], r[1]) for r in rows if r[0]]

    @F.pandas_udf("array<string>")
    def search(texts):
        import ahocorasick
        import pandas as pd

        a = ahocorasick.Automaton()
        for p, lab in words:
            a.add_word(p, (*(a.get(p, ())), lab))
        if words:
            a.make_automaton()
        return pd.Series([None if t is None else list(dict.fromkeys(x for _, found in a.iter(t) for x in found)) if words else [] for t in texts])

    return df.withColumn(tag, search(F.col(member)))


def fixed_match(df: DataFrame, member: str, patterns: dict[str, str] | Sequence[tuple[str, str, int, bool]], offset: int = 0, from_end: bool = False, port: str = "", tag: str = "MATCH") -> DataFrame:
    """Patterns (-> label) at a fixed offset from the start, or ending at one from the end; TAG gives the first one's label.

    Patterns with places of their own are tuples: text, label, offset, whether from the end.
    """
    c = F.col(member)
    places = [(p, label, offset, from_end) for p, label in patterns.items()] if isinstance(patterns, dict) else list(patterns)

    def fits(p: str, at: int, end: bool) -> Column:
        own = F.substring(c, F.length(c) - at - len(p) + 1, F.lit(len(p))) if end else F.substring(c, at + 1, len(p))
        return (F.length(c) >= at + len(p)) & (own == p)

    if port == "TAG":
        return df.withColumn(tag, F.coalesce(*[F.when(fits(p, at, end), F.lit(label)) for p, label, at, end in places]))
    return select(df, _any([fits(p, at, end) for p, _, at, end in places]), port)


def exact_match(df: DataFrame, member: str, values: Sequence | DataFrame, port: str = "", tag: str = "MATCH") -> DataFrame:
    """Membership of a whole value in a list, or in the first column of a table (joined, so it may be large)."""
    if not isinstance(values, DataFrame):
        return select(df, F.col(member).isin(list(values)), port, tag)
    own = values.select(F.col(values.columns[0]).alias("_v")).distinct()
    if port == "TAG":
        return df.join(own.withColumn("_hit", F.lit(True)), F.col(member) == F.col("_v"), "left").withColumn(tag, F.coalesce("_hit", F.lit(False))).drop("_v", "_hit")
    return df.join(own, F.col(member) == F.col("_v"), "left_anti" if port in ("NOT", "INVERSE") else "left_semi")


def regex(df: DataFrame, member: str, pattern: str, groups: Sequence[str] = (), tag_all: bool = False, nest: str | None = None) -> DataFrame:
    """Rows that match (or all); capture groups become members, NULL where empty."""
    found = [F.nullif(F.regexp_extract(member, pattern, i + 1), F.lit("")).alias(g) for i, g in enumerate(groups)]
    out = df if tag_all else df.where(F.col(member).rlike(pattern))
    return out.withColumn(nest, F.struct(*found)) if nest else out.select("*", *found)


def first_pattern(df: DataFrame, member: str, patterns: Sequence[str], name: str = "PATTERN", pass_all: bool = False) -> DataFrame:
    """The number of the first regular expression of a set that matches."""
    c = F.coalesce(*[F.when(F.col(member).rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    out = df.withColumn(name, c)
    return out if pass_all else out.where(F.col(name).isNotNull())


def sample(df: DataFrame, probability: float | None = None, seed: int = 0, every_seconds: int | None = None, time: str = "ts", order: str = "event_id") -> DataFrame:
    """Each row with a probability, or the first row of every time bucket."""
    if every_seconds is None:
        return df.sample(probability, seed)
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (1_000_000 * every_seconds))
    first = df.groupBy(bucket.alias("_b")).agg(F.min(F.struct(order, F.struct(*df.columns).alias("row"))).alias("m"))
    return first.select("m.row.*")


def flush_epochs(df: DataFrame, order: str = "event_id", count: int | None = None, time: str = "ts", seconds: int | None = None, name: str = "epoch") -> DataFrame:
    """The number of the flush epoch: of every ``count`` rows along the order, whatever its gaps, or of hour-aligned buckets of time."""
    if count is not None:
        from .sorts import global_rank

        return global_rank(df, [order], "_place").withColumn(name, F.floor((F.col("_place") - 1) / count).cast("long")).drop("_place")
    return df.withColumn(name, F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (1_000_000 * seconds)).cast("long"))
