"""Projection and shaping of (nested) records.

A record's labels on the container are the column ``_labels`` (array of strings); a member is a column. Absent means NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import detect

LABELS = "_labels"


def add_label(df: DataFrame, label: str, when: Column | None = None) -> DataFrame:
    """Puts ``label`` on the container of every row (or of those where ``when`` holds)."""
    have = F.col(LABELS) if LABELS in df.columns else F.array().cast("array<string>")
    have = F.coalesce(have, F.array().cast("array<string>"))
    new = F.array_union(have, F.array(F.lit(label)))
    return df.withColumn(LABELS, new if when is None else F.when(when, new).otherwise(have))


def label(df: DataFrame, name: str, member: str | None = None, rename: bool = False, empty: bool = False) -> DataFrame:
    """A container label; with ``member`` a further name of a member (or its new name); with ``empty`` only on records without members."""
    if member:
        return df.withColumnRenamed(member, name) if rename else df.withColumn(name, F.col(member))
    if empty:
        none = [F.col(c).isNull() for c in df.columns if c != LABELS]
        return add_label(df, name, _all(none))
    return add_label(df, name)


def add_member(df: DataFrame, name: str, value: str = "UNKNOWN", typed: bool = True) -> DataFrame:
    """A constant member; its type is detected as at ingest unless ``typed`` is false."""
    return df.withColumn(name, F.lit(detect(value) if typed else value))


def label_multiple(df: DataFrame, array: str, prefix: str, most: int = 100) -> DataFrame:
    """One column prefix1, prefix2, ... for each of the first ``most`` values of an array member."""
    return df.select("*", *(F.get(array, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(most)))


def data_to_label(df: DataFrame, member: str, name: str | None = None) -> DataFrame:
    """The container label ``name=value`` from a member."""
    text = F.concat(F.lit(f"{name or member}="), F.col(member).cast("string"))
    have = F.coalesce(F.col(LABELS) if LABELS in df.columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    return df.withColumn(LABELS, F.when(text.isNotNull(), F.array_union(have, F.array(text))).otherwise(have))


def make_labelset(df: DataFrame, name: str, members: Sequence[str] = (), ignore: Sequence[str] = (), last_only: bool = False, as_string: str | None = None) -> DataFrame:
    """The names of the members that are present (or the container's labels if none are listed) as an array member or joined string."""
    if members:
        labels = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in members]))
    else:
        labels = F.coalesce(F.col(LABELS), F.array().cast("array<string>"))
    if ignore:
        labels = F.array_except(labels, F.array(*map(F.lit, ignore)))
    if last_only:
        labels = F.slice(labels, -1, 1) if not members else F.when(F.size(labels) > 0, F.slice(labels, -1, 1)).otherwise(labels)
    return df.withColumn(name, F.array_join(labels, as_string) if as_string is not None else labels)


def subtuple(df: DataFrame, members: Sequence[str], fill_empty: bool = False, keep_labels: bool = False, add: str | None = None) -> DataFrame:
    """Projection in the given order (dots reach into nested records); a row in which none is present is dropped."""
    cols = [F.col(m).alias(m.split(".")[-1]) for m in members]
    out = df.where(_any([F.col(m).isNotNull() for m in members]))
    if fill_empty:
        cols = [F.coalesce(F.col(m).cast("string"), F.lit("")).alias(m.split(".")[-1]) for m in members]
    if keep_labels and LABELS in df.columns:
        cols.append(F.col(LABELS))
    out = out.select(*cols)
    return add_label(out, add) if add else out


def remove_members(df: DataFrame, members: Sequence[str]) -> DataFrame:
    """Without the listed members; a row left without any is dropped."""
    out = df.drop(*members)
    left = [c for c in out.columns if c != LABELS]
    return out.where(_any([F.col(c).isNotNull() for c in left])) if left else out.limit(0)


def remove_nested(df: DataFrame, *paths: str) -> DataFrame:
    """Without the nested members at dotted paths (top-level names drop columns)."""
    by: dict[str, list[str]] = {}
    for p in paths:
        top, _, rest = p.partition(".")
        by.setdefault(top, []).append(rest)
    for top, rests in by.items():
        df = df.drop(top) if "" in rests else df.withColumn(top, F.col(top).dropFields(*rests))
    return df


def duplicate(df: DataFrame, add: str | None = None) -> DataFrame:
    """A copy of every record, with a label if asked for."""
    return add_label(df, add) if add else df.select("*")


def make_nest(df: DataFrame, members: Sequence[str], name: str, append_to: str | None = None) -> DataFrame:
    """Packs members into the nested record ``name`` (or into an existing one); NULL if all are absent."""
    if append_to:
        return df.withColumn(append_to, _with_fields(F.col(append_to), {m: F.col(m) for m in members}))
    return df.withColumn(name, F.when(_any([F.col(m).isNotNull() for m in members]), F.struct(*members)))


def _with_fields(base: Column, fields: dict[str, Column]) -> Column:
    for k, v in fields.items():
        base = base.withField(k, v)
    return base


def denest(df: DataFrame, member: str, append: bool = False, into: str | None = None, add: str | None = None) -> DataFrame:
    """The fields of a nested record as a record of their own (rows without it go), or next to the other members, or in another nested record."""
    fields = df.schema[member].dataType
    assert isinstance(fields, T.StructType), f"{member} is not nested"
    inner = [F.col(f"{member}.{f.name}").alias(f.name) for f in fields]
    if into:
        out = df.withColumn(into, F.struct(*inner))
    elif append:
        out = df.select("*", *inner)
    else:
        out = df.where(F.col(member).isNotNull()).select(*inner)
    return add_label(out, add) if add else out


def split_tuple(df: DataFrame, members: Sequence[str], carry: Sequence[str] = (), name: str = "value", with_label: str | None = None) -> DataFrame:
    """One row for each present member, with carried members; arrays of one type or members that share a type."""
    parts = F.array(*[F.struct(F.lit(m).alias("l"), F.col(m).alias("v")) for m in members])
    out = df.select(*carry, F.explode(parts).alias("_p")).where(F.col("_p.v").isNotNull())
    cols = [*carry, F.col("_p.v").alias(name)]
    return out.select(*cols, F.col("_p.l").alias(with_label)) if with_label else out.select(*cols)


def fill_missing(df: DataFrame, member: str, value=None, other: str | None = None) -> DataFrame:
    """A constant, or another member's value, where ``member`` is absent (dots reach into nested records)."""
    new = F.col(other) if other else F.lit(value)
    top, _, rest = member.partition(".")
    if rest:
        return df.withColumn(top, F.col(top).withField(rest, F.coalesce(F.col(member), new)))
    return df.withColumn(member, F.coalesce(F.col(member), new) if member in df.columns else new)


def count_labels(df: DataFrame, members: Sequence[str], name: str = "LABELCNT", eq: int | None = None, less: int | None = None, greater: int | None = None) -> DataFrame:
    """How many of the members are present; optionally only rows where that number fits."""
    n = sum((F.col(m).isNotNull().cast("int") for m in members), F.lit(0))
    df = df.withColumn(name, n)
    if eq is not None:
        df = df.where(F.col(name) == eq)
    if less is not None:
        df = df.where(F.col(name) < less)
    if greater is not None:
        df = df.where(F.col(name) > greater)
    return df


def duplicates(df: DataFrame, members: Sequence[str], dup: str = "DUPLICATE", first: str | None = None) -> DataFrame:
    """Arrays with the names of the members whose value occurred earlier in the same record (and of the first occurrences)."""
    seen: list[Column] = []
    dups, firsts = [], []
    for m in members:
        v = F.col(m).cast("string")
        old = _any([v == s for s in seen]) if seen else F.lit(False)
        dups.append(F.when(v.isNotNull() & F.coalesce(old, F.lit(False)), F.lit(m)))
        firsts.append(F.when(v.isNotNull() & ~F.coalesce(old, F.lit(False)), F.lit(m)))
        seen.append(v)
    df = df.withColumn(dup, F.array_compact(F.array(*dups)))
    return df.withColumn(first, F.array_compact(F.array(*firsts))) if first else df


def tuple_hash(df: DataFrame, members: Sequence[str], name: str = "TUPLEHASH", ordered: bool = False, as_base64: bool = False) -> DataFrame:
    """A 64-bit hash of the members: independent of their order, or not."""
    if ordered:
        h = F.xxhash64(*members)
    else:
        # XOR-free sum that wraps: through decimals, so that it holds with ANSI arithmetic too
        total = sum((F.when(F.col(m).isNotNull(), F.xxhash64(m)).otherwise(F.lit(0)).cast("decimal(38,0)") for m in members), F.lit(0).cast("decimal(38,0)"))
        modulus = F.lit("18446744073709551616").cast("decimal(38,0)")
        r = F.pmod(total, modulus)
        h = F.when(r >= F.lit("9223372036854775808").cast("decimal(38,0)"), r - modulus).otherwise(r).cast("long")
    return df.withColumn(name, F.base64(F.encode(F.hex(h), "UTF-8")) if as_base64 else h)


def load_balance(df: DataFrame, n: int, keys: Sequence[str] = (), name: str = "LB", order: str | None = None) -> DataFrame:
    """A channel 0 to n-1 for every row: by the keys (the value itself for one integer key, else a hash) or in turn along ``order``."""
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType):
        c = F.pmod(F.col(keys[0]), F.lit(n))
    elif keys:
        c = F.pmod(F.xxhash64(*keys), F.lit(n))
    else:
        c = F.pmod(F.col(order), F.lit(n)) if order else F.pmod(F.monotonically_increasing_id(), F.lit(n))
    return df.withColumn(name, c.cast("int"))


def spread(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Work dealt over n partitions (by the keys' hash, or evenly): scheduling only, the rows stay the same."""
    return df.repartition(n, *keys) if keys else df.repartition(n)


def unchanged(df: DataFrame, *_args, **_kw) -> DataFrame:
    """Bundling, unbundling and receiving work are the engine's business: the rows stay the same."""
    return df


def timestamp(df: DataFrame, name: str = "DATETIME", source: str | None = None, unit: str = "now", offset_seconds: float = 0, pattern: str | None = None) -> DataFrame:
    """A time member: now, or from epoch seconds ('s', 'double'), epoch milliseconds ('ms') or text ('iso', or by ``pattern``; UTC).

    'iso-z' reads +00:00 and Z alike; 'string' gives ISO text of a time member.
    """
    c = F.col(source) if source else None
    if unit == "now":
        ts = F.current_timestamp()
    elif unit == "ms":
        ts = F.timestamp_millis(c.cast("long"))
    elif unit in ("s", "double"):
        ts = F.timestamp_micros((c.cast("double") * 1e6).cast("long")) if unit == "double" else F.timestamp_seconds(c.cast("long"))
    elif pattern:
        ts = F.try_to_timestamp(c, F.lit(pattern))
    elif unit in ("iso", "iso-z"):
        ts = F.try_to_timestamp(F.regexp_replace(c, r"Z$", "+00:00") if unit == "iso-z" else c)
    elif unit == "string":
        return df.withColumn(name, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    else:
        raise ValueError(unit)
    if offset_seconds:
        ts = ts + F.make_dt_interval(secs=F.lit(offset_seconds))
    return df.withColumn(name, ts)


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
