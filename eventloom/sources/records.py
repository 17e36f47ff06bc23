"""Container files of labelled records: length-framed protocol-buffer messages, optionally gzipped.

A file begins with a frame of four bytes (format, version); every further frame is one record. All numbers are little-endian,
a frame's length has eight bytes.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

# Fixed values of the format.
FORMAT, VERSION, EARLIEST = 2, 3, 2
TUPLE, STRING, BINARY, DOUBLE, UINT, UINT64, TIME, INT = 1, 2, 3, 6, 7, 8, 14, 16
TEXT_KINDS = (2, 4, 5, 13, 19, 20, 21)
UINT_KINDS = (7, 10, 11)
FIELD_KIND, FIELD_LABEL, FIELD_MEMBER, FIELD_TEXT, FIELD_BYTES, FIELD_DOUBLE, FIELD_UINT, FIELD_UINT64, FIELD_UINT64_2, FIELD_SINT = 1, 2, 3, 4, 5, 6, 7, 9, 10, 12


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        wire = tag & 7
        if wire == 0:
            v, at = _varint(b, at)
        elif wire == 1:
            v, at = b[at : at + 8], at + 8
        elif wire == 2:
            n, at = _varint(b, at)
            v, at = b[at : at + n], at + n
        elif wire == 5:
            v, at = b[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, v


def decode(message: bytes) -> tuple[list[str], object]:
    """Labels and value of a message; a tuple's value is a list of its members' labels and values."""
    kind, labels, members, got = None, [], [], {}
    for n, v in _fields(message):
        if n == FIELD_KIND:
            kind = v
        elif n == FIELD_LABEL:
            labels.append(v.decode())
        elif n == FIELD_MEMBER:
            members.append(decode(v))
        else:
            got[n] = v
    if kind == TUPLE:
        return labels, members
    if kind in TEXT_KINDS:
        return labels, got.get(FIELD_TEXT, b"").decode(errors="replace")
    if kind == DOUBLE:
        return labels, struct.unpack("<d", got[FIELD_DOUBLE])[0]
    if kind in UINT_KINDS:
        return labels, got.get(FIELD_UINT, 0)
    if kind == UINT64:
        return labels, got.get(FIELD_UINT64, 0)
    if kind == INT:
        z = got.get(FIELD_SINT, 0)
        return labels, (z >> 1) ^ -(z & 1)
    if kind == TIME:
        return labels, dt.datetime.fromtimestamp(got.get(FIELD_UINT64, 0), dt.timezone.utc).replace(microsecond=min(999_999, got.get(FIELD_UINT64_2, 0)))
    return labels, bytes(got.get(FIELD_BYTES, b""))


def _put_varint(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def _put(n: int, v) -> bytes:
    if isinstance(v, bytes):
        return _put_varint(n << 3 | 2) + _put_varint(len(v)) + v
    return _put_varint(n << 3) + _put_varint(v)


def encode(labels: list[str], value) -> bytes:
    """A message; dicts become tuples, None members are left out."""
    head = lambda kind: _put(FIELD_KIND, kind) + b"".join(_put(FIELD_LABEL, x.encode()) for x in labels)
    if isinstance(value, dict):
        return head(TUPLE) + b"".join(_put(FIELD_MEMBER, encode([k], v)) for k, v in value.items() if v is not None)
    if isinstance(value, bool):
        return head(UINT) + _put(FIELD_UINT, int(value))
    if isinstance(value, int):
        if value < 0:
            return head(INT) + _put(FIELD_SINT, (value << 1 ^ value >> 63) & (1 << 64) - 1)
        return head(UINT) + _put(FIELD_UINT, value) if value < 1 << 32 else head(UINT64) + _put(FIELD_UINT64, value)
    if isinstance(value, float):
        return head(DOUBLE) + _put_varint(FIELD_DOUBLE << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, dt.datetime):
        t = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return head(TIME) + _put(FIELD_UINT64, int(t.timestamp() // 1)) + _put(FIELD_UINT64_2, t.microsecond)
    if isinstance(value, bytes | bytearray):
        return head(BINARY) + _put(FIELD_BYTES, bytes(value))
    return head(STRING) + _put(FIELD_TEXT, str(value).encode())


def frames(data: bytes) -> Iterator[bytes]:
    """The records of a container's bytes; a cut last frame is left out."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < 12 or struct.unpack_from("<Q", data) != (4,):
        raise ValueError("no container header")
    kind, version = struct.unpack_from("<HH", data, 8)
    if kind != FORMAT or version < EARLIEST:
        raise ValueError(f"format {kind}, version {version}")
    at = 12
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 8 + n > len(data):
            return
        yield data[at + 8 : at + 8 + n]
        at += 8 + n


def _text(v) -> str:
    if isinstance(v, list):
        return json.dumps({(k[-1] if k else str(i)): _text(x) for i, (k, x) in enumerate(v)})
    if isinstance(v, bytes):
        return v.hex()
    return v.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if isinstance(v, dt.datetime) else str(v)


def read(files: DataFrame, data: str = "DATA", name: str = "FILENAME") -> DataFrame:
    """FILENAME, labels, members (label -> text; nested records as JSON, bytes in hexadecimal) of container files, one row a record."""
    ship(files.sparkSession)
    schema = pa.schema([("FILENAME", pa.string()), ("labels", pa.list_(pa.string())), ("members", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                for m in frames(raw):
                    labels, value = decode(m)
                    members = {label: _text(v) for k, v in (value if isinstance(value, list) else [(["VALUE"], value)]) for label in (k or ["VALUE"])}
                    rows.append({"FILENAME": f, "labels": labels, "members": list(members.items())})
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = files.select(F.col(name).cast("string") if name in files.columns else F.lit(""), F.col(data).cast("binary"))
    return own.mapInArrow(run, "FILENAME string, labels array<string>, members map<string, string>")


def containers(df: DataFrame, labels: str | None = None, most_bytes: int = 64 << 20, compress: bool = False) -> DataFrame:
    """FILE, DATA: the rows of ``df`` as containers of at most about ``most_bytes``, to be stored by ``writers.buffers``."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c != labels]
    nested = {f.name for f in df.schema if isinstance(f.dataType, T.StructType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        header = struct.pack("<QHH", 4, FORMAT, VERSION)
        held, size = [header], len(header)

        def made() -> pa.RecordBatch:
            raw = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}"]), pa.array([gzip.compress(raw) if compress else raw], pa.binary())], names=["FILE", "DATA"])

        for b in batches:
            for r in b.to_pylist():
                m = encode(list(r[labels] or []) if labels else [], {k: dict(r[k]) if k in nested and r[k] is not None else r[k] for k in names})
                held.append(struct.pack("<Q", len(m)) + m)
                size += 8 + len(m)
                if size >= most_bytes:
                    yield made()
                    held, size, n = [header], len(header), n + 1
        if len(held) > 1:
            yield made()

    return df.mapInArrow(run, "FILE string, DATA binary")
