"""Aggregations over keys and over the whole input. All combine within tasks before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _first(order: str | None, members: Sequence[str]) -> list[Column]:
    """Members of the first row of a key, its representative."""
    return [F.min_by(F.col(m), F.col(order)).alias(m) for m in members] if order else []


def key_count(df: DataFrame, key: str | Sequence[str], pct: bool = False, order: str | None = None, carry: Sequence[str] = (), name: str = "COUNT") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    out = df.where(F.greatest(*[F.col(k).isNotNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias(name), *_first(order, carry))
    if pct:
        # the total is a scalar subquery, not a window over all keys
        out = out.withColumn("PCT", F.col(name) / out.agg(F.sum(name)).scalar())
    return out


def key_add(df: DataFrame, key: str, values: Sequence[str], pct: bool = False, order: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """COUNT, and of each value its SUM (SUM_name for several)."""
    name = lambda v: "SUM" if len(values) == 1 else f"SUM_{v}"
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("COUNT"), *[F.sum(v).alias(name(v)) for v in values], *_first(order, carry))
    if pct:
        out = out.withColumn("PCT", F.col("COUNT") / out.agg(F.sum("COUNT")).scalar())
    return out


def key_average(df: DataFrame, key: str, value: str) -> DataFrame:
    """AVERAGE is the sum over the number of events, with or without a value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("COUNT"), F.coalesce(F.sum(value), F.lit(0)).alias("SUM")).withColumn("AVERAGE", F.col("SUM") / F.col("COUNT"))


def key_variance(df: DataFrame, key: str, value: str, full: bool = False, skew: bool = False, last: int | None = None, order: str = "event_id") -> DataFrame:
    """Sample variance (0 for one value), optionally mean and count, population skewness, or over the last ``last`` values."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    if last:
        rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
        rows = rows.withColumn("_rn", rn).where(F.col("_rn") <= last)
    aggs = [F.coalesce(F.var_samp(value), F.lit(0.0)).alias("VARIANCE")]
    if full:
        aggs += [F.avg(value).alias("MEAN"), F.count(value).alias("COUNT")]
    if skew:
        aggs.append(F.coalesce(F.skewness(value), F.lit(0.0)).alias("SKEWNESS"))
    return rows.groupBy(key).agg(*aggs)


def label_stat(df: DataFrame, members: Sequence[str] | None = None) -> DataFrame:
    """LABEL, COUNT: in how many records each member is present."""
    names = list(members or df.columns)
    counts = df.agg(*[F.count(F.col(m)).alias(f"c{i}") for i, m in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(m).alias("LABEL"), F.col(f"c{i}").alias("COUNT")) for i, m in enumerate(names)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("COUNT") > 0)


def heavy_hitters(df: DataFrame, key: str, n: int = 10, value: str | None = None, name: str = "ACC") -> DataFrame:
    """The n keys with the largest count (or sum); ties by key. Exact."""
    acc = F.sum(value) if value else F.count("*")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(acc.alias(name)).orderBy(F.desc(name), key).limit(n)


def heavy_hitters_approximate(df: DataFrame, key: str, n: int = 10, nodes: int = 25_000) -> DataFrame:
    """Space-saving in bounded state: key, ACC (an upper estimate of the count)."""
    return df.agg(F.expr(f"approx_top_k({key}, {n}, {nodes})").alias("t")).select(F.explode("t").alias("e")).select(F.col("e.item").alias(key), F.col("e.count").alias("ACC"))


def top(df: DataFrame, member: str, n: int = 10, lowest: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The n rows with the largest (lowest) value."""
    return df.where(F.col(member).isNotNull()).orderBy(F.col(member).asc() if lowest else F.col(member).desc(), *ties).limit(n)


def group_events(df: DataFrame, key: str, common: str, values: Sequence[str] = (), singles: Sequence[str] = (), n: int | None = None, order: str = "event_id") -> DataFrame:
    """Runs of equal ``common`` values of a key, in order: their values as arrays, the first row's singles, at most n events each."""
    w = W.partitionBy(key).orderBy(order)
    rows = df.where(F.col(key).isNotNull() & F.col(common).isNotNull())
    rows = rows.withColumn("_new", F.coalesce((F.lag(common).over(w) != F.col(common)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    by = [key, "_run"]
    if n:
        rows = rows.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(key, "_run").orderBy(order)) - 1) / n))
        by.append("_part")
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(v).alias("v")))), lambda x: x["v"]).alias(v)
    return rows.groupBy(*by).agg(F.min(order).alias("first"), F.first(common).alias(common), F.count("*").alias("COUNT"), *[ordered(v) for v in values], *[F.min_by(s, order).alias(s) for s in singles]).drop("_run", "_part")


def group_packets(df: DataFrame, key: str, seq: str, length: str, ack: str, content: str, flags: str | None = None, n: int | None = None, order: str = "event_id") -> DataFrame:
    """Consecutive segments of a direction joined: a new group where the sequence or acknowledgement number jumps, or after FIN or SYN."""
    w = W.partitionBy(key).orderBy(order)
    jump = (F.lag(F.col(seq) + F.col(length)).over(w) != F.col(seq)) | (F.lag(ack).over(w) != F.col(ack))
    if flags:
        jump = jump | (F.lag(F.col(flags).bitwiseAND(3)).over(w) > 0)  # FIN 1, SYN 2
    rows = df.withColumn("_new", F.coalesce(jump.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    by = [key, "_run"]
    if n:
        rows = rows.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(key, "_run").orderBy(order)) - 1) / n))
        by.append("_part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).cast("string").alias("v")))), lambda x: F.coalesce(x["v"], F.lit(""))), "")
    return rows.groupBy(*by).agg(F.min(order).alias("first"), F.count("*").alias("segments"), F.sum(length).alias("bytes"), text.alias("content")).drop("_run", "_part")


def bandwidth(df: DataFrame, time: str = "ts", size: str | None = None) -> DataFrame:
    """EVENT_CNT, EVENT_RATE (per second of event time) and BYTE_CNT, BANDWIDTH if a buffer is given."""
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    span = F.max(t) - F.min(t)
    aggs = [F.count("*").alias("EVENT_CNT"), F.try_divide(F.count("*"), span).alias("EVENT_RATE")]
    if size:
        aggs += [F.coalesce(F.sum(F.octet_length(size)), F.lit(0)).alias("BYTE_CNT"), F.try_divide(F.coalesce(F.sum(F.octet_length(size)), F.lit(0)), span).alias("BANDWIDTH")]
    return df.agg(*aggs)
