"""Per-key analytics along an order: filters, state machines and time series of each key.

``order`` is a total order of the rows (the arrival order); all of it runs in window functions partitioned by the key, but
for the recursive ones, which fold over a key's sorted array or go through ``eventloom.streaming.stateful``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = "event_id"


def _w(key: str | Sequence[str], order: str | Sequence[str] = ORDER):
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def _running(key, order: str = ORDER):
    return _w(key, order).rowsBetween(W.unboundedPreceding, 0)


def _before(key, order: str = ORDER):
    return _w(key, order).rowsBetween(W.unboundedPreceding, -1)


def _has(key) -> Column:
    out = F.lit(True)
    for k in [key] if isinstance(key, str) else key:
        out = out & F.col(k).isNotNull()
    return out


# ---- existence and rank filters ----


def counts(df: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """key, n: how many rows each key has had, those of an earlier table of counts (``seen``) included; the state of ``first_n`` and ``until_n``."""
    own = df.where(_has(key)).groupBy(key).agg(F.count("*").alias("n"))
    return own if seen is None else own.unionByName(seen.select(key, "n")).groupBy(key).agg(F.sum("n").alias("n"))


def _rank(df: DataFrame, key: str, seen: DataFrame | None, order: str) -> DataFrame:
    """_rn: the number of each row among its key's, after those counted in ``seen``."""
    rows = df.where(_has(key)).withColumn("_rn", F.row_number().over(_w(key, order)))
    if seen is None:
        return rows
    earlier = seen.select(key, F.col("n").alias("_seen"))
    return rows.join(earlier, key, "left").withColumn("_rn", F.col("_rn") + F.coalesce("_seen", F.lit(0))).select(*df.columns, "_rn")


def first_n(df: DataFrame, key: str, n: int = 10, count: str | None = None, order: str = ORDER, seen: DataFrame | None = None) -> DataFrame:
    """The first n rows of every key, optionally with their number; rows counted in ``seen`` (see ``counts``) came before."""
    out = _rank(df, key, seen, order).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", count) if count else out.drop("_rn")


def until_n(df: DataFrame, key: str, n: int = 10, order: str = ORDER, seen: DataFrame | None = None) -> DataFrame:
    """All but the first n rows of every key; rows counted in ``seen`` came before."""
    return _rank(df, key, seen, order).where(F.col("_rn") > n).drop("_rn")


def uniq(df: DataFrame, keys: Sequence[str], port: str = "", other: DataFrame | None = None, tag: str = "KNOWN", order: str = ORDER, seen: DataFrame | None = None) -> DataFrame:
    """'': first row of a key; DUPES: the others; TAG: all, with a boolean. With ``other`` (the SET rows): ISSET and ISNOTSET (INVQUERY, QUERY).

    Keys in ``seen`` (a table of them) are known from the beginning.
    """
    if port in ("ISSET", "INVQUERY", "ISNOTSET", "QUERY"):
        known = other.select(*keys) if seen is None else other.select(*keys).unionByName(seen.select(*keys))
        return df.join(known.distinct(), list(keys), "left_semi" if port in ("ISSET", "INVQUERY") else "left_anti")
    if port == "" and order is None and seen is None:
        return df.where(_has(keys)).dropDuplicates(list(keys))
    rn = df.where(_has(keys)).withColumn("_rn", F.row_number().over(_w(keys, order)))
    if seen is not None:
        rn = rn.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(1)), list(keys), "left").withColumn("_rn", F.col("_rn") + F.coalesce("_seen", F.lit(0))).select(*df.columns, "_rn")
    if port == "TAG":
        return rn.withColumn(tag, F.col("_rn") > 1).drop("_rn")
    return rn.where(F.col("_rn") > 1 if port == "DUPES" else F.col("_rn") == 1).drop("_rn")


def uniq_with_removals(df: DataFrame, removed: DataFrame, keys: Sequence[str], order: str = ORDER) -> DataFrame:
    """The first row of a key, and the first after each row of ``removed`` with that key (at the same place the removal comes first)."""
    own = df.select(*keys, F.col(order).alias("_o"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row"))
    gone = removed.select(*keys, F.col(order).alias("_o"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    before = F.lag("_side", 1, 0).over(W.partitionBy(*keys).orderBy("_o", "_side"))
    return own.unionByName(gone).where(_has(keys)).withColumn("_before", before).where("_side = 1 and _before = 0").select("_row.*")


def bloom_uniq(df: DataFrame, keys: Sequence[str], order: str = ORDER) -> DataFrame:
    """What a Bloom filter that never errs passes: the first row of every key."""
    return uniq(df, keys, order=order)


def arrival(df: DataFrame, key: str, name: str = "ARRIVAL", order: str = ORDER) -> DataFrame:
    """The rank in which a row's key was first seen, from 1. The ranks of keys are found without a window over all rows."""
    from ..operators.sorts import global_rank

    firsts = df.where(_has(key)).groupBy(key).agg(F.min(order).alias("_first"))
    ranked = global_rank(firsts, ["_first"], name).drop("_first")
    return df.join(ranked, key)


def only_after(df: DataFrame, key: str, condition: Column, exclude_trigger: bool = False, order: str = ORDER) -> DataFrame:
    """Rows of a key from the first one where the condition holds (or after it)."""
    seen = F.max(F.coalesce(condition, F.lit(False))).over(_before(key, order) if exclude_trigger else _running(key, order))
    return df.where(_has(key)).withColumn("_seen", seen).where("_seen").drop("_seen")


# ---- values of earlier rows ----


def append_first(df: DataFrame, key: str, value: str, port: str = "", order: str = ORDER) -> DataFrame:
    """FIRST: the key's first value, NEXT: the row's own; rows after the first (TAG: all rows)."""
    w = _w(key, order)
    rows = df.where(_has(key) & F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w))
    later = F.col("_rn") > 1
    out = rows.withColumn("FIRST", F.when(later, F.first(value).over(w))).withColumn("NEXT", F.when(later, F.col(value)))
    return (out if port == "TAG" else out.where(later)).drop("_rn")


def append_last(df: DataFrame, key: str, value: str, keep_all: bool = False, name: str = "LAST", order: str = ORDER) -> DataFrame:
    """The key's previous value; rows without one go unless ``keep_all``."""
    out = df.where(_has(key)).withColumn(name, F.last(value, True).over(_before(key, order)))
    return out if keep_all else out.where(F.col(name).isNotNull())


def last_n(df: DataFrame, key: str, value: str, n: int = 5, prefix: str = "LASTN", order: str = ORDER) -> DataFrame:
    """PREFIX_i_value: the i-th last earlier value (0: the newest)."""
    return df.where(_has(key)).select("*", *[F.lag(value, i + 1).over(_w(key, order)).alias(f"{prefix}_{i}_{value}") for i in range(n)])


def last_n_of(df: DataFrame, other: DataFrame, key: str, value: str, n: int = 5, prefix: str = "LASTN", filter_known: bool = False, order: str = ORDER) -> DataFrame:
    """``last_n`` of another stream at each row's place in the common order: both are merged, so no row meets all of a key's rows."""
    mine = df.select(key, order, F.lit(1).alias("_port"), F.struct(*df.columns).alias("_row"), F.lit(None).cast(other.schema[value].dataType).alias("_v"))
    theirs = other.select(key, order, F.lit(0).alias("_port"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = W.partitionBy(key).orderBy(order, "_port")
    held = mine.unionByName(theirs).withColumn("_n", F.sum(1 - F.col("_port")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # among the other stream's rows the last n values are carried forward from the newest one
    ring = F.when(F.col("_port") == 0, F.array(F.col("_v"), *[F.lag("_v", i).over(W.partitionBy(key, "_port").orderBy(order)) for i in range(1, n)]))
    out = held.withColumn("_ring", ring).withColumn("_ring", F.last("_ring", True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_port = 1")
    if filter_known:
        out = out.where("_n > 0")
    return out.select("_row.*", *[F.get("_ring", F.lit(i)).alias(f"{prefix}_{i}_{value}") for i in range(n)])


def keep_last(df: DataFrame, key: str, members: Sequence[str], order: str = ORDER) -> DataFrame:
    """The members of each key's last row."""
    return df.where(_has(key)).groupBy(key).agg(F.max_by(F.struct(*members), order).alias("_m")).select(key, "_m.*")


def keep_last_of(df: DataFrame, other: DataFrame, key: str, value: str, name: str = "KEPT", order: str = ORDER) -> DataFrame:
    """The value that another stream last had for the key at each row's place (NULL if none): an as-of join by merging."""
    out = last_n_of(df, other, key, value, 1, "_k", order=order)
    return out.withColumnRenamed(f"_k_0_{value}", name)


def keep_n(df: DataFrame, key: str, value: str, n: int = 5, first: bool = False, blocks: bool = False, count: bool = False, order: str = ORDER) -> DataFrame:
    """The last (first) n values of each key in order, or all full blocks of n (numbered)."""
    rows = df.where(_has(key) & F.col(value).isNotNull())
    by = [key]
    if blocks:
        rows = rows.withColumn("block", F.floor((F.row_number().over(_w(key, order)) - 1) / n).cast("long"))
        by.append("block")
    else:
        rn = F.row_number().over(_w(key, order) if first else W.partitionBy(key).orderBy(F.desc(order)))
        rows = rows.withColumn("_rn", rn).where(F.col("_rn") <= n)
    out = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))
    if blocks:
        out = out.where(F.size("values") == n)
    return out.withColumn("KEEPCOUNT", F.size("values")) if count else out


def merge(df: DataFrame, key: str, members: Sequence[str], carry: Sequence[str] = (), n: int = 2, distinct: bool = False, order: str = ORDER) -> DataFrame:
    """Every n events of a key as one record: carried members of the first, the members' values in order; incomplete ones go."""
    rows = df.where(_has(key)).withColumn("_part", F.floor((F.row_number().over(_w(key, order)) - 1) / n))
    values = lambda m: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(m).alias("v")))), lambda x: x["v"])
    one = (lambda m: F.get(F.array_compact(values(m)), F.lit(0)).alias(m)) if distinct else (lambda m: values(m).alias(m))
    out = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"), *[F.min_by(c, order).alias(c) for c in carry], *[one(m) for m in members])
    return out.where(F.col("_n") == n).drop("_n", "_part")


# ---- counters ----


def count_query(df: DataFrame, key: str, delta: Column, query: Column, least: int = 1, include_own: bool = True, name: str = "CNT", order: str = ORDER) -> DataFrame:
    """A signed counter of each key: rows where ``query`` holds pass if the sum of the deltas so far reaches ``least``."""
    total = F.sum(delta).over(_running(key, order) if include_own else _before(key, order))
    return df.where(_has(key)).withColumn(name, F.coalesce(total, F.lit(0)).cast("long")).where(query & (F.col(name) >= least))


def running_count(df: DataFrame, key: str, query: Column, name: str = "COUNT", order: str | Sequence[str] = ORDER) -> DataFrame:
    """Rows where ``query`` holds, with the count of the key's earlier rows where it doesn't; rows of unknown keys go."""
    n = F.sum(F.when(query, 0).otherwise(1)).over(_before(key, order))
    return df.where(_has(key)).withColumn(name, F.coalesce(n, F.lit(0)).cast("long")).where(query & (F.col(name) > 0))


def add_initial(df: DataFrame, key: str, value: str, at: int = 16, order: str = ORDER) -> DataFrame:
    """One row a key: COUNT and ACC at exactly its ``at``-th row with a value."""
    rows = df.where(_has(key) & F.col(value).isNotNull()).withColumn("COUNT", F.row_number().over(_w(key, order)).cast("long")).withColumn("ACC", F.sum(value).over(_running(key, order)))
    return rows.where(F.col("COUNT") == at)


def anomaly_benchmark(df: DataFrame, key: str, value: str, bias: str, at: int = 24, threshold: int = 5, order: str = ORDER) -> DataFrame:
    """Keys judged at their ``at``-th row: anomalous if the sum of values is below the threshold; the counts of true and false verdicts against the bias flag."""
    rows = df.where(_has(key)).withColumn("_rn", F.row_number().over(_w(key, order))).where(F.col("_rn") <= at)
    keys = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.max_by(bias, order).alias("b")).where(F.col("n") == at)
    said, true = F.col("s") < threshold, F.col("b") != 0
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return keys.agg(one(said & true).alias("TP"), one(said & ~true).alias("FP"), one(~said & ~true).alias("TN"), one(~said & true).alias("FN"))


# ---- time ----


def diff(df: DataFrame, key: str, value: str, order: str = ORDER) -> DataFrame:
    """value_DIFF: the distance to the key's previous value (NULL for the first)."""
    return df.where(_has(key)).withColumn(f"{value}_DIFF", F.abs(F.col(value) - F.last(value, True).over(_before(key, order))))


def seconds(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def transitions(df: DataFrame, key: str, time: str = "ts", value: str | None = None, since_start: bool = False, name: str = "TIMEDIFF", order: str = ORDER) -> DataFrame:
    """Seconds since the key's last row; with ``value`` only on a change of it (since its run began, if asked)."""
    w = _w(key, order)
    rows = df.where(_has(key) & F.col(time).isNotNull())
    last = F.lag(time).over(w)
    if value is None:
        return rows.withColumn("_last", last).withColumn(name, (micros(time) - micros("_last")) / 1_000_000).where(F.col("_last").isNotNull()).drop("_last")
    rows = rows.where(F.col(value).isNotNull()).withColumn("_old", F.lag(value).over(w)).withColumn("_change", F.col("_old").isNull() | (F.col("_old") != F.col(value)))
    if since_start:
        rows = rows.withColumn("_begin", F.last(F.when(F.col("_change"), F.col(time)), True).over(_before(key, order)))
    else:
        rows = rows.withColumn("_begin", last)
    out = rows.where(F.col("_change") & F.col("_old").isNotNull()).withColumn(name, (micros(time) - micros("_begin")) / 1_000_000)
    return out.drop("_old", "_change", "_begin")


def flow(df: DataFrame, key: str, time: str = "ts", gap: int = 60, most: int | None = None, name: str = "session", order: str = ORDER) -> DataFrame:
    """The session number of each row of a key, from 0: a new one when at least ``gap`` whole seconds passed (or after ``most`` rows)."""
    w = _w(key, order)
    rows = df.where(_has(key) & F.col(time).isNotNull()).withColumn("_s", F.floor(micros(time) / 1_000_000))
    out = rows.withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(w) >= gap).cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(w).cast("long"))
    if most:
        out = out.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(key, name).orderBy(order)) - 1) / most))
        new = (F.col("_part") != F.lag("_part", 1, 0).over(_w([key, name], order))).cast("int")
        out = out.withColumn("_new", F.greatest("_new", new)).withColumn(name, F.sum("_new").over(w).cast("long")).drop("_part")
    return out.drop("_s", "_new")


def key_time(df: DataFrame, key: str, time: str = "ts", recent: float = 0, old: float = 3600, name: str = "AGE", order: str = ORDER) -> DataFrame:
    """NEW (first seen at most ``recent`` seconds ago), RECENT, or OLD (over ``old`` seconds ago, and from then on)."""
    age = seconds(time) - F.min(seconds(time)).over(_running(key, order))
    first = F.row_number().over(_w(key, order)) == 1
    rows = df.where(_has(key) & F.col(time).isNotNull()).withColumn("_age", age).withColumn("_first", first)
    ever = F.max(F.col("_age") > old).over(_running(key, order))
    return rows.withColumn(name, F.when(ever, "OLD").when(F.col("_first") | (F.col("_age") <= recent), "NEW").otherwise("RECENT")).drop("_age", "_first")


def rate(df: DataFrame, key: str, time: str = "ts", period: int = 60, value: str | None = None, least: float = 3, most: float | None = None, order: str = ORDER) -> DataFrame:
    """COUNT, EPOCH, RATE of a key's last epoch, on its first row of a later one, if the count fits.

    Epochs are numbered 1, 2, ... over those in which anything happened (time rises along the order).
    """
    bucket = F.floor(micros(time) / (1_000_000 * period)).cast("long")
    rows = df.where(F.col(time).isNotNull()).withColumn("_b", bucket)
    from .sorts import global_rank

    epochs = global_rank(rows.select("_b").distinct(), ["_b"], "EPOCH")
    row = F.struct(*df.columns)
    own = rows.where(_has(key)).groupBy(key, "_b").agg((F.sum(value) if value else F.count("*")).alias("COUNT"), F.min_by(row, order).alias("_row"))
    w = W.partitionBy(key).orderBy("_b")
    # a row a key and epoch: the next epoch's first row is carried along, nothing is joined back
    told = own.withColumn("_next", F.lead("_row").over(w)).where(F.col("_next").isNotNull() & (F.col("COUNT") >= least))
    if most is not None:
        told = told.where(F.col("COUNT") <= most)
    told = told.drop(key)
    return told.join(epochs, "_b").select("_next.*", "COUNT", "EPOCH", (F.col("COUNT") / period).alias("RATE"))


def edit_distance(df: DataFrame, key: str, value: str, order: str = ORDER) -> DataFrame:
    """EDITDISTANCE of each row's value to the key's previous one, and EDITNORM, over the longer length."""
    before = F.last(value, True).over(_before(key, order))
    d = F.levenshtein(value, "_last").cast("long")
    out = df.where(_has(key)).withColumn("_last", before).withColumn("EDITDISTANCE", d)
    return out.withColumn("EDITNORM", F.col("EDITDISTANCE") / F.greatest(F.lit(1), F.length(value), F.length("_last"))).drop("_last")


def persist(df: DataFrame, key: str, time: str = "ts", bin_seconds: int = 3600, bins: int = 16, least: int = 4, order: str = ORDER) -> DataFrame:
    """On a key's first row of each new time bin: how many of the last ``bins`` bins it was seen in, if at least ``least``."""
    bucket = F.floor(micros(time) / (1_000_000 * bin_seconds)).cast("long")
    per = df.where(_has(key) & F.col(time).isNotNull()).withColumn("_b", bucket).groupBy(key, "_b").agg(F.min(order).alias(order))
    w = W.partitionBy(key).orderBy("_b")
    n = F.count("*").over(w.rangeBetween(-(bins - 1), 0))
    held = F.array_sort(F.transform(F.collect_list("_b").over(w.rangeBetween(-(bins - 1), 0)), lambda b: F.col("_b") - b))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(F.array_contains(held, i.cast("long")), "1").otherwise("0")), "")
    out = per.withColumn("_rn", F.row_number().over(w)).withColumn("PERSIST_COUNT", n).withColumn("PERSIST", bits)
    return out.where((F.col("_rn") > 1) & (F.col("PERSIST_COUNT") >= least)).select(key, order, "PERSIST_COUNT", "PERSIST")


def climb(df: DataFrame, key: str, weight: Column, threshold: float = 10, name: str = "SCORE", order: str = ORDER) -> DataFrame:
    """Rows where the key's running sum of weights exceeds the threshold (without clamping; with it see ``streaming.stateful``)."""
    return df.where(_has(key)).withColumn(name, F.sum(weight).over(_running(key, order))).where(F.col(name) > threshold)


def ewma(df: DataFrame, key: str, value: str, alpha: float = 0.05, order: str = ORDER) -> DataFrame:
    """EWMA and EWMVAR of each key's values: the first value seeds the mean. One fold over a key's sorted rows."""
    from ..streaming.stateful import run_keyed

    def start():
        return None

    def step(state, row):
        v = row[value]
        if v is None:
            return state, (None, None)
        if state is None:
            state = (float(v), 0.0)
        else:
            m, s = state
            d = v - m
            state = (alpha * v + (1 - alpha) * m, (1 - alpha) * (s + alpha * d * d))
        return state, state

    return run_keyed(df.where(_has(key)), key, start, step, "EWMA double, EWMVAR double", order, (value,))
