"""Sinks: text, JSON, buffers, brokers, sockets; rotation by time and size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import line


def text(df: DataFrame, path: str, members: Sequence[str] | None = None, separator: str = ",", labels: bool = False, compression: str = "none", mode: str = "error") -> None:
    """Records as lines."""
    df.select(line(list(members or df.columns), separator, labels).alias("value")).write.mode(mode).option("compression", compression).text(path)


def json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "error") -> None:
    """The engine's own exchange format: Parquet."""
    (df.write.partitionBy(*by) if by else df.write).mode(mode).parquet(path)


def rotated(df: DataFrame, path: str, time: str, seconds: int, members: Sequence[str] | None = None, most_records: int | None = None, separator: str = ",", mode: str = "error") -> None:
    """Lines in a folder for each period of time, files of at most ``most_records`` lines."""
    period = F.date_format(F.timestamp_seconds(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds), "yyyyMMdd-HHmmss")
    w = df.select(period.alias("period"), line(list(members or df.columns), separator).alias("value")).write.partitionBy("period").mode(mode)
    if most_records:
        w = w.option("maxRecordsPerFile", most_records)
    w.text(path)


def buffers(df: DataFrame, member: str, name: str, write: Callable[[str, bytes], None]) -> int:
    """Every non-empty buffer through ``write(name, bytes)`` on the executors, which must reach a shared store; the number written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for key, raw in zip(b.column("n").to_pylist(), b.column("v").to_pylist(), strict=True):
                if raw:
                    write(f"{key}.buffer", raw)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(F.col(name).cast("string").alias("n"), F.col(member).cast("binary").alias("v"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def buffer_files(df: DataFrame, member: str, name: str, folder: str, suffix: str = ".buffer") -> int:
    """``buffers`` as files in a folder that the executors share, a path or a URI that pyarrow knows."""

    def write(key: str, raw: bytes) -> None:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{key.removesuffix('.buffer').replace('/', '_')}{suffix}") as out:
            out.write(raw)

    return buffers(df, member, name, write)


def kafka(df: DataFrame, brokers: str, topic: str, value: str, key: str | None = None, options: dict[str, str] | None = None, checkpoint: str | None = None):
    """Publishes a member, with another one as key. Needs Spark's Kafka package. A stream needs a checkpoint folder and gives its query."""
    rows = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.col(value).cast("binary").alias("value"))
    w = (rows.writeStream if df.isStreaming else rows.write).format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    return w.option("checkpointLocation", checkpoint).start() if df.isStreaming else w.save()


def frames(df: DataFrame, member: str, host: str, port: int) -> None:
    """Every value as a frame (four-byte big-endian length first) to a server; one connection a partition."""

    def run(rows) -> None:
        import socket
        import struct

        with socket.create_connection((host, port), timeout=30) as s:
            for r in rows:
                raw = r[0]
                if raw is not None:
                    s.sendall(struct.pack(">I", len(raw)) + bytes(raw))

    df.select(F.col(member).cast("binary")).foreachPartition(run)


def observed(df: DataFrame, name: str = "bandwidth", size: str | None = None):
    """The rows unchanged, and an Observation that has EVENT_CNT (and BYTE_CNT) after an action."""
    from pyspark.sql import Observation

    o = Observation(name)
    cols = [F.count(F.lit(1)).alias("EVENT_CNT")] + ([F.sum(F.octet_length(size)).alias("BYTE_CNT")] if size else [])
    return df.observe(o, *cols), o
