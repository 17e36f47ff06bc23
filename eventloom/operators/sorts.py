"""Sorting and global ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sort(df: DataFrame, member: str, ascending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """By a numeric member, descending unless told otherwise; rows without it go, other text counts as -1."""
    v = F.coalesce(F.col(member).try_cast("double"), F.lit(-1.0))
    return df.where(F.col(member).isNotNull()).orderBy(v.asc() if ascending else v.desc(), *ties)


def buffer_sort(df: DataFrame, member: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Ascending unless told otherwise; rows whose value is missing or no number go."""
    v = F.col(member).try_cast("double")
    return df.where(v.isNotNull()).orderBy(v.desc() if descending else v.asc(), *ties)


def key_sort(df: DataFrame, key: str, value: str, ties: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Each key's rows together and ascending, within partitions dealt by key."""
    parts = (n, key) if n else (key,)
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).repartition(*parts).sortWithinPartitions(key, value, *ties)


def global_rank(df: DataFrame, by: Sequence[str], name: str = "rank", descending: bool = False) -> DataFrame:
    """The place of every row in the order of ``by``, from 1, without moving all rows to one task.

    Rows are dealt by ranges and numbered within their range; the ranges' sizes, one row each, give the offsets. The dealt
    rows are written to the shared folder, as a later sampling might draw other ranges.
    """
    from ..session import materialise

    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in by]
    dealt = materialise(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*cols))
    ranked = dealt.withColumn("_in", inside).join(F.broadcast(offsets.select("_range", "_before")), "_range")
    return ranked.withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_before")


def placed(df: DataFrame, name: str = "rank") -> DataFrame:
    """The place of every row in the order in which ``df`` gives its rows, from 1."""
    from ..session import materialise

    rows = materialise(df.withColumn("_at", F.monotonically_increasing_id()))
    return global_rank(rows, ["_at"], name).drop("_at")


def running_total(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows up to each one in the order, by ranges with offsets as in ``global_rank``."""
    from ..session import materialise

    dealt = materialise(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_n"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    out = dealt.withColumn("_in", inside).join(F.broadcast(offsets.select("_range", "_before")), "_range")
    return out.withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")
