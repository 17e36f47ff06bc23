"""Joins and merges of streams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shape import LABELS


def union(*streams: DataFrame) -> DataFrame:
    """All rows of several streams; missing members are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def with_label(df: DataFrame, label: str) -> DataFrame:
    """The rows whose container has the label."""
    return df.where(F.array_contains(F.col(LABELS), label))


def join(left: DataFrame, right: DataFrame, key: str, left_members: Sequence[str] | None = None, right_members: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Equi-join where keys are unique on both sides; the key appears once."""
    a = left.select(key, *(left_members or [c for c in left.columns if c != key]))
    b = right.select(key, *(right_members or [c for c in right.columns if c != key]))
    return a.join(b, key, how)


def join_once(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """One-shot join of two streams in a common order.

    A row waits for one of the other side with its key; a match consumes both; a second waiting row of the same side
    replaces the first. So a row matches the key's directly preceding row, if that is of the other side and was not
    consumed itself: of each run of alternating sides, every second row meets the one before it.
    """
    a = left.select(key, order, F.lit(0).alias("_side"), F.struct(*[c for c in left.columns if c not in (key, order)]).alias("_l"), F.lit(None).alias("_r"))
    b = right.select(key, order, F.lit(1).alias("_side"), F.lit(None).alias("_l"), F.struct(*[c for c in right.columns if c not in (key, order)]).alias("_r"))
    a, b = a.withColumn("_r", F.lit(None).cast(b.schema["_r"].dataType)), b.withColumn("_l", F.lit(None).cast(a.schema["_l"].dataType))
    w = W.partitionBy(key).orderBy(order, "_side")
    rows = a.unionByName(b).where(F.col(key).isNotNull())
    rows = rows.withColumn("_run", F.sum(F.when(F.lag("_side").over(w) != F.col("_side"), 0).otherwise(1)).over(w))
    at = F.row_number().over(W.partitionBy(key, "_run").orderBy(order, "_side"))
    rows = rows.withColumn("_at", at).withColumn("_pl", F.lag("_l").over(w)).withColumn("_pr", F.lag("_r").over(w))
    out = rows.where(F.col("_at") % 2 == 0)
    return out.select(key, order, F.coalesce("_l", "_pl").alias("left"), F.coalesce("_r", "_pr").alias("right"))


def join_once_flat(left: DataFrame, right: DataFrame, key: str, order: str, left_members: Sequence[str] | None = None, right_members: Sequence[str] | None = None) -> DataFrame:
    """``join_once`` with the members of both sides beside the key and the order; what both have is the left one's, unless the right one's are named."""
    b = [c for c in (right_members or right.columns) if c not in (key, order) and (right_members or left_members is None and c not in left.columns or left_members is not None and c not in left_members)]
    a = [c for c in (left_members or left.columns) if c not in (key, order) and (left_members or c not in b)]
    # a struct needs a member
    side = lambda df, own: df.select(key, order, *own, F.lit(True).alias("_"))
    out = join_once(side(left, a), side(right, b), key, order)
    return out.select(key, order, *[F.col(f"left.`{c}`").alias(c) for c in a], *[F.col(f"right.`{c}`").alias(c) for c in b])


def lookup(df: DataFrame, store: DataFrame, key: str, value: str, name: str = "VALUE") -> DataFrame:
    """GET of a key-value store: the stored value or NULL."""
    return df.join(store.select(F.col(key), F.col(value).alias(name)), key, "left")


def put(store: DataFrame, new: DataFrame, key: str, value: str, order: str, only_new: bool = False) -> DataFrame:
    """SET (the last value of a key wins) or SETNX (the first one stays) on a stored table."""
    rows = store.select(key, value, F.lit(None).cast("long").alias("_o")).unionByName(new.select(key, value, F.col(order).cast("long").alias("_o")))
    rank = F.coalesce("_o", F.lit(-(2**62)))
    pick = F.min_by(value, rank) if only_new else F.max_by(value, rank)
    return rows.groupBy(key).agg(pick.alias(value))


def increment(store: DataFrame, deltas: DataFrame, key: str, value: str, delta: str) -> DataFrame:
    """INCR and DECR: the stored number plus all deltas of the key (0 if it was not stored)."""
    rows = store.select(key, F.col(value).alias("_v")).unionByName(deltas.select(key, F.col(delta).alias("_v")))
    return rows.groupBy(key).agg(F.sum("_v").alias(value))
