"""Streaming sources for UDP datagrams and framed TCP, as Python data sources: register, then ``readStream.format(name)``."""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "DATETIME timestamp, MESSAGE binary, SOURCE_IP string, SOURCE_PORT int"


class _Reader(SimpleDataSourceStreamReader):
    """Rows that arrived since the last call; they are kept until committed, so that a failed batch is read again."""

    def __init__(self, options: dict):
        self.options, self.rows, self.at, self.sock = options, [], 0, None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def receive(self) -> list[tuple]:
        raise NotImplementedError

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.rows += self.receive()
        own = self.rows[start["n"] - self.at :]
        return iter(own), {"n": start["n"] + len(own)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.rows[start["n"] - self.at : end["n"] - self.at])

    def commit(self, end: dict) -> None:
        self.rows, self.at = self.rows[end["n"] - self.at :], end["n"]


def _now():
    import datetime as dt

    return dt.datetime.now(dt.timezone.utc)


class _UdpReader(_Reader):
    def receive(self) -> list[tuple]:
        if self.sock is None:
            self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.sock.bind((self.options.get("host", "0.0.0.0"), int(self.options["port"])))
            self.sock.setblocking(False)
        out, until = [], time.time() + float(self.options.get("wait", 0.2))
        while time.time() < until and len(out) < int(self.options.get("maxRows", 100_000)):
            try:
                data, (ip, port) = self.sock.recvfrom(65535)
                out.append((_now(), data, ip, port))
            except BlockingIOError:
                time.sleep(0.01)
        return out


class UdpSource(DataSource):
    """Options: port, host, wait (seconds a batch listens), maxRows. One row a datagram."""

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _UdpReader:
        return _UdpReader(self.options)


class _FrameReader(_Reader):
    held = b""

    def receive(self) -> list[tuple]:
        host, port = self.options.get("host", "127.0.0.1"), int(self.options["port"])
        if self.sock is None:
            self.sock = socket.create_connection((host, port), timeout=5)
            self.sock.setblocking(False)
        out, until = [], time.time() + float(self.options.get("wait", 0.2))
        while time.time() < until:
            try:
                data = self.sock.recv(1 << 20)
                if not data:
                    break
                self.held += data
            except BlockingIOError:
                time.sleep(0.01)
        frames, self.held = split_frames(self.held)
        return out + [(_now(), f, host, port) for f in frames]


def split_frames(data: bytes) -> tuple[list[bytes], bytes]:
    """Frames of a four-byte big-endian length and that many bytes; and what is left."""
    out, at = [], 0
    while len(data) - at >= 4:
        (n,) = struct.unpack_from(">I", data, at)
        if len(data) - at - 4 < n:
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, data[at:]


class FrameSource(DataSource):
    """A client of a server that sends frames (see ``split_frames``). Options: host, port, wait."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _FrameReader:
        return _FrameReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UdpSource)
    spark.dataSource.register(FrameSource)


def parse_benchmark_rows(df, member: str = "MESSAGE"):
    """KEY, VALUE, BIAS of datagrams that hold several ``key,value,bias`` lines."""
    from pyspark.sql import functions as F

    lines = df.select(F.explode(F.split(F.col(member).cast("string"), "\n")).alias("l")).where("l <> ''")
    parts = F.split("l", ",")
    return lines.select(F.get(parts, F.lit(0)).alias("KEY"), F.get(parts, F.lit(1)).try_cast("long").alias("VALUE"), F.get(parts, F.lit(2)).try_cast("long").alias("BIAS"))
