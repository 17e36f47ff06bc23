"""Decoders of network captures: pcap files, Ethernet to TCP and UDP, DNS messages and TLS records."""

from __future__ import annotations

import hashlib
import ipaddress
import socket
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

PACKET = "DATETIME timestamp, LENGTH int, ETHERTYPE int, VLAN int, SRCIP string, DSTIP string, PROTO int, SRCPORT int, DSTPORT int, FLAGS int, TCPSEQ long, TCPACK long, WINDOW int, CONTENT binary"
_PACKET_NAMES = [c.split()[0] for c in PACKET.split(", ")]


def packets(data: bytes) -> Iterator[dict]:
    """Decoded packets of a pcap file of either byte order and time unit."""
    if len(data) < 24:
        return
    magic = data[:4]
    kinds = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
    if magic not in kinds:
        return
    order, scale = kinds[magic]
    (link,) = struct.unpack_from(order + "I", data, 20)
    at = 24
    while at + 16 <= len(data):
        sec, frac, kept, full = struct.unpack_from(order + "IIII", data, at)
        at += 16
        raw = data[at : at + kept]
        at += kept
        yield {"DATETIME": sec * 1_000_000 + frac // scale, "LENGTH": full, **_frame(raw, link)}


def _frame(raw: bytes, link: int) -> dict:
    out: dict = {}
    if link == 1:  # Ethernet
        if len(raw) < 14:
            return {"CONTENT": raw}
        (kind,) = struct.unpack_from(">H", raw, 12)
        at = 14
        while kind in (0x8100, 0x88A8) and len(raw) >= at + 4:
            tag, kind = struct.unpack_from(">HH", raw, at)
            out["VLAN"] = tag & 0xFFF
            at += 4
        out["ETHERTYPE"] = kind
    elif link in (101, 228, 229) and raw:  # raw IP
        at, kind = 0, 0x0800 if raw[0] >> 4 == 4 else 0x86DD
        out["ETHERTYPE"] = kind
    else:
        return {"CONTENT": raw}
    body = raw[at:]
    if kind == 0x0800 and len(body) >= 20:
        head = (body[0] & 15) * 4
        (total,) = struct.unpack_from(">H", body, 2)
        out |= {"SRCIP": socket.inet_ntoa(body[12:16]), "DSTIP": socket.inet_ntoa(body[16:20]), "PROTO": body[9]}
        body = body[head : total if head <= total <= len(body) else len(body)]
    elif kind == 0x86DD and len(body) >= 40:
        out |= {"SRCIP": str(ipaddress.IPv6Address(body[8:24])), "DSTIP": str(ipaddress.IPv6Address(body[24:40])), "PROTO": body[6]}
        body = body[40:]
        while out["PROTO"] in (0, 43, 60) and len(body) >= 8:  # extension headers
            out["PROTO"], body = body[0], body[(body[1] + 1) * 8 :]
    else:
        return out | {"CONTENT": body}
    if out["PROTO"] == 6 and len(body) >= 20:
        sp, dp, seq, ack, bits, win = struct.unpack_from(">HHIIHH", body)
        out |= {"SRCPORT": sp, "DSTPORT": dp, "TCPSEQ": seq, "TCPACK": ack, "FLAGS": bits & 0x1FF, "WINDOW": win}
        body = body[(bits >> 12) * 4 :]
    elif out["PROTO"] == 17 and len(body) >= 8:
        sp, dp, n = struct.unpack_from(">HHH", body)
        out |= {"SRCPORT": sp, "DSTPORT": dp}
        body = body[8 : n if 8 <= n <= len(body) else len(body)]
    return out | {"CONTENT": body}


def pcap(files: DataFrame, data: str = "DATA", name: str = "FILENAME", group_ports: bool = False) -> DataFrame:
    """The packets of capture files (one row a file), with DIRFLOW and BIFLOW (hashes of the directed and undirected 5-tuple)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for f, raw in zip(b.column("f").to_pylist(), b.column("d").to_pylist(), strict=True):
                for i, p in enumerate(packets(raw or b"")):
                    rows.append({"FILENAME": f, "N": i, **p})
                    if len(rows) == 5000:
                        yield _packet_batch(rows)
                        rows = []
        if rows:
            yield _packet_batch(rows)

    own = files.select(F.col(name).cast("string").alias("f") if name in files.columns else F.lit("").alias("f"), F.col(data).cast("binary").alias("d"))
    out = own.mapInArrow(run, f"FILENAME string, N int, {PACKET}")
    ends = [F.struct(F.col(f"{x}IP").alias("ip"), F.col(f"{x}PORT").alias("port")) for x in ("SRC", "DST")]
    out = out.withColumn("DIRFLOW", F.xxhash64("SRCIP", "SRCPORT", "DSTIP", "DSTPORT", "PROTO")).withColumn("BIFLOW", F.xxhash64(F.to_json(F.least(*ends)), F.to_json(F.greatest(*ends)), "PROTO"))
    if group_ports:
        lower = F.col("SRCPORT") < F.col("DSTPORT")
        out = out.withColumn("SERVER", F.when(lower, F.col("SRCIP")).otherwise(F.col("DSTIP"))).withColumn("CLIENT", F.when(lower, F.col("DSTIP")).otherwise(F.col("SRCIP")))
    return out


def _packet_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC")}
    fields = [("FILENAME", pa.string()), ("N", pa.int32())] + [(c.split()[0], kinds[c.split()[1]]) for c in PACKET.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


# ---- DNS ----

RECORD = "struct<SECTION: string, NAME: string, TYPE: int, CLASS: int, TTL: long, DATA: string>"
DNS = f"struct<ID: int, RESPONSE: boolean, OPCODE: int, AUTHORITATIVE: boolean, TRUNCATED: boolean, RCODE: int, QNAME: string, QTYPE: int, QCLASS: int, RECORDS: array<{RECORD}>>"


def _name(m: bytes, at: int) -> tuple[str, int]:
    parts, end, hops = [], None, 0
    while True:
        n = m[at]
        if n & 0xC0 == 0xC0:
            if end is None:
                end = at + 2
            at = (n & 0x3F) << 8 | m[at + 1]
            hops += 1
            if hops > 64:
                raise ValueError("names point in circles")
        elif n == 0:
            return ".".join(parts), end if end is not None else at + 1
        else:
            parts.append(m[at + 1 : at + 1 + n].decode("latin-1"))
            if len(m) < at + 1 + n:
                raise ValueError("short name")
            at += 1 + n


def _rdata(m: bytes, kind: int, at: int, n: int) -> str:
    raw = m[at : at + n]
    if kind == 1 and n == 4:
        return str(ipaddress.IPv4Address(raw))
    if kind == 28 and n == 16:
        return str(ipaddress.IPv6Address(raw))
    if kind in (2, 5, 12):
        return _name(m, at)[0]
    if kind == 15:
        return f"{struct.unpack_from('>H', m, at)[0]} {_name(m, at + 2)[0]}"
    if kind == 6:
        mname, p = _name(m, at)
        rname, p = _name(m, p)
        return " ".join([mname, rname, *map(str, struct.unpack_from(">IIIII", m, p))])
    if kind == 16:
        out, p = [], 0
        while p < n:
            out.append(raw[p + 1 : p + 1 + raw[p]].decode("latin-1"))
            p += 1 + raw[p]
        return "".join(out)
    if kind == 257 and n >= 2:
        t = raw[1]
        return f"{raw[0]} {raw[2 : 2 + t].decode('latin-1')} {raw[2 + t :].decode('latin-1')}"
    return raw.hex()


def dns_message(m: bytes, tcp: bool = False) -> dict | None:
    """A decoded DNS message; None if it is none."""
    try:
        if tcp:
            m = m[2 : 2 + struct.unpack_from(">H", m)[0]]
        ident, flags, nq, *counts = struct.unpack_from(">HHHHHH", m)
        out = {"ID": ident, "RESPONSE": bool(flags >> 15), "OPCODE": flags >> 11 & 15, "AUTHORITATIVE": bool(flags >> 10 & 1), "TRUNCATED": bool(flags >> 9 & 1), "RCODE": flags & 15, "QNAME": None, "QTYPE": None, "QCLASS": None, "RECORDS": []}
        at = 12
        for i in range(nq):
            name, at = _name(m, at)
            kind, cls = struct.unpack_from(">HH", m, at)
            at += 4
            if i == 0:
                out |= {"QNAME": name, "QTYPE": kind, "QCLASS": cls}
        for section, n in zip(("ANSWER", "AUTHORITY", "ADDITIONAL"), counts, strict=True):
            for _ in range(n):
                name, at = _name(m, at)
                kind, cls, ttl, size = struct.unpack_from(">HHIH", m, at)
                at += 10
                if at + size > len(m):
                    raise ValueError("short record")
                out["RECORDS"].append({"SECTION": section, "NAME": name, "TYPE": kind, "CLASS": cls, "TTL": ttl, "DATA": _rdata(m, kind, at, size)})
                at += size
        return out
    except (struct.error, IndexError, ValueError):
        return None


def dns(c: Column | str, tcp: bool = False) -> Column:
    """A DNS message as a nested record (``DNS``), NULL where the bytes are none."""

    @F.pandas_udf(DNS)
    def run(s: pd.Series) -> pd.DataFrame:
        names = [x.split(":")[0].strip() for x in ("ID:", "RESPONSE:", "OPCODE:", "AUTHORITATIVE:", "TRUNCATED:", "RCODE:", "QNAME:", "QTYPE:", "QCLASS:", "RECORDS:")]
        got = [dns_message(bytes(m), tcp) if m is not None else None for m in s]
        return pd.DataFrame({n: pd.Series([None if g is None else g[n] for g in got], dtype=object) for n in names})

    out = run(F.col(c) if isinstance(c, str) else c)
    return F.when(out["ID"].isNotNull(), out)


# ---- TLS ----

TLS = "struct<RECORD: int, RECORD_VERSION: int, HANDSHAKE: int, VERSION: int, CIPHERS: array<int>, EXTENSIONS: array<int>, SNI: string, ALPN: array<string>, JA3: string, JA3_HASH: string>"


def _grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


def tls_record(m: bytes) -> dict | None:
    """The first handshake of a TLS record; None if it is none."""
    try:
        kind, version, n = struct.unpack_from(">BHH", m)
        if kind not in (20, 21, 22, 23) or version >> 8 != 3:
            return None
        out: dict = {"RECORD": kind, "RECORD_VERSION": version, "HANDSHAKE": None, "VERSION": None, "CIPHERS": [], "EXTENSIONS": [], "SNI": None, "ALPN": [], "JA3": None, "JA3_HASH": None}
        if kind != 22:
            return out
        body = m[5 : 5 + n]
        out["HANDSHAKE"] = body[0]
        if body[0] not in (1, 2):
            return out
        at = 4
        (out["VERSION"],) = struct.unpack_from(">H", body, at)
        at += 34
        at += 1 + body[at]
        groups: list[int] = []
        formats: list[int] = []
        if body[0] == 1:
            (k,) = struct.unpack_from(">H", body, at)
            out["CIPHERS"] = list(struct.unpack_from(f">{k // 2}H", body, at + 2))
            at += 2 + k
            at += 1 + body[at]
        else:
            out["CIPHERS"] = [struct.unpack_from(">H", body, at)[0]]
            at += 3
        if at + 2 <= len(body):
            (k,) = struct.unpack_from(">H", body, at)
            at += 2
            end = min(at + k, len(body))
            while at + 4 <= end:
                ext, size = struct.unpack_from(">HH", body, at)
                data = body[at + 4 : at + 4 + size]
                at += 4 + size
                out["EXTENSIONS"].append(ext)
                if ext == 0 and len(data) > 5:
                    out["SNI"] = data[5 : 5 + struct.unpack_from(">H", data, 3)[0]].decode("latin-1")
                elif ext == 10 and len(data) >= 2:
                    groups = list(struct.unpack_from(f">{(len(data) - 2) // 2}H", data, 2))
                elif ext == 11 and data:
                    formats = list(data[1 : 1 + data[0]])
                elif ext == 16 and len(data) > 2:
                    p = 2
                    while p < len(data):
                        out["ALPN"].append(data[p + 1 : p + 1 + data[p]].decode("latin-1"))
                        p += 1 + data[p]
        plain = lambda xs: "-".join(str(x) for x in xs if not _grease(x))
        if body[0] == 1:
            out["JA3"] = ",".join([str(out["VERSION"]), plain(out["CIPHERS"]), plain(out["EXTENSIONS"]), plain(groups), "-".join(map(str, formats))])
            out["JA3_HASH"] = hashlib.md5(out["JA3"].encode()).hexdigest()
        return out
    except (struct.error, IndexError):
        return None


def tls(c: Column | str) -> Column:
    """A TLS record as a nested record (``TLS``), NULL where the bytes are none."""
    names = [x.split(":")[0].strip() for x in TLS[7:-1].split(", ")]

    @F.pandas_udf(TLS)
    def run(s: pd.Series) -> pd.DataFrame:
        got = [tls_record(bytes(m)) if m is not None else None for m in s]
        return pd.DataFrame({n: pd.Series([None if g is None else g[n] for g in got], dtype=object) for n in names})

    out = run(F.col(c) if isinstance(c, str) else c)
    return F.when(out["RECORD"].isNotNull(), out)
