"""Streams over stored tables: replay, windows with watermarks, sessions, deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored Parquet table (a file or a folder) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    # a single file is named by a pattern that only it matches
    out = r.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    # watermarks need times with a zone: UTC
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def collect(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now; the rows it wrote (mode complete: at last), as a table in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/eventloom-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/" + ("all" if mode == "complete" else f"batch={number}"))

    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{base}/out/all" if mode == "complete" else f"{base}/out")
    return out.select(*df.columns)


def window_counts(df: DataFrame, size: str, time: str = "ts", by: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """start (epoch seconds), by, n of tumbling windows; in append mode a window comes out once the watermark has passed it."""
    w = df.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.unix_seconds("w.start").alias("start"), by, "n")


def sessions(df: DataFrame, key: str, gap: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Session windows of a key with their counts."""
    return df.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(df: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def join_streams(left: DataFrame, right: DataFrame, key: str, within: str, time: str = "ts") -> DataFrame:
    """Rows of both streams with the same key whose times are at most ``within`` apart."""
    a = left.withWatermark(time, within).select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.withWatermark(time, within).select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    near = F.expr(f"l_{key} = r_{key} AND r_{time} BETWEEN l_{time} - INTERVAL {within} AND l_{time} + INTERVAL {within}")
    return a.join(b, near)
