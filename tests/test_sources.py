"""Sources, sinks, decoders and streams."""

import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from eventloom.functions import decode
from eventloom.plans import graph
from eventloom.sources import datagrams, readers, records, writers
from eventloom.streaming import replay, stateful


def test_csv_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x,2.5\n2,,7\n3,z\n")
    got = readers.csv_lines(spark, str(tmp_path / "a.csv"), ["A", "B", "C"])
    assert sorted((int(r.A.i), r.B.s, r.C.d) for r in got.collect()) == [(1, "x", 2.5), (2, None, None), (3, "z", None)]
    assert sorted(r.B or "" for r in readers.csv_lines(spark, str(tmp_path / "a.csv"), ["A", "B", "C"], detect=False).collect()) == ["", "x", "z"]
    assert readers.csv_table(spark, str(tmp_path / "a.csv"), "A int, B string, C double").agg(F.sum("A")).first()[0] == 6


def test_files_and_processes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"hello")
    r = readers.files(spark, str(tmp_path)).first()
    assert (bytes(r.DATA), r.LENGTH) == (b"hello", 5)
    assert [r[0] for r in readers.process(spark, ["printf", "a\\nb\\n"]).collect()] == ["a", "b"]
    assert sorted(r[0] for r in readers.through_process(spark.range(3), "id", ["sed", "s/^/n/"]).collect()) == ["n0", "n1", "n2"]
    # one program a partition, whatever the batches
    assert [r[0].strip() for r in readers.through_process(spark.range(0, 25_000, 1, 1), "id", ["wc", "-l"]).collect()] == ["25000"]
    assert readers.through_process(spark.range(0, 200_000, 1, 2), "id", ["cat"]).count() == 200_000
    with pytest.raises(ValueError, match="more than 10 bytes"):
        readers.process(spark, ["yes"], most_bytes=10)


def test_generators(spark):
    assert [r[0].minute for r in readers.clock(spark, "2024-01-01 00:01:00", "2024-01-01 01:00:00", 900).orderBy("DATETIME").collect()] == [15, 30, 45, 0]
    a, b = (readers.key_generator(spark, 50, 15, seed=1).collect() for _ in range(2))
    assert a == b and {r.KEY for r in a} <= set(range(16))
    assert readers.biased_keys(spark, 100, 5).where("VALUE not in (0, 1)").count() == 0


def test_syslog(spark):
    df = spark.createDataFrame([("<34>Oct 11 22:14:15 box su[12]: failed",), ("<165>1 2003-10-11T22:14:15Z host app 1 ID - text here",), ("junk",)], "MESSAGE string")
    got = [(r.FACILITY, r.SEVERITY, r.HOST, r.TAG, r.TEXT) for r in readers.syslog_fields(df).collect()]
    assert got == [(4, 2, "box", "su", "failed"), (20, 5, "host", "app", "text here"), (None, None, None, None, None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 4000)], "i int, s string, t long").withColumn("ts", F.timestamp_seconds("t"))
    writers.text(df, str(tmp_path / "t"), ["i", "s"], "|")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1|a", "2|b"]
    writers.rotated(df, str(tmp_path / "r"), "ts", 3600, ["s"])
    assert sorted((str(r.period), r.value) for r in spark.read.text(str(tmp_path / "r")).collect()) == [("19700101-000000", "a"), ("19700101-010000", "b")]
    folder = str(tmp_path)

    def put(name, raw):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(raw)

    assert writers.buffers(df, "s", "i", put) == 2
    assert (tmp_path / "2.buffer").read_bytes() == b"b"
    out, seen = writers.observed(df, "o1", "s")
    out.count()
    assert seen.get["EVENT_CNT"] == 2


def test_frames_to_a_server(spark):
    got, server = [], socket.create_server(("127.0.0.1", 0))

    def serve():
        while len(got) < 3:
            c, _ = server.accept()
            data = b""
            while chunk := c.recv(4096):
                data += chunk
            got.extend(datagrams.split_frames(data)[0])

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    writers.frames(spark.createDataFrame([("a",), ("bb",), ("ccc",)], "s string").coalesce(1), "s", "127.0.0.1", server.getsockname()[1])
    t.join(10)
    assert sorted(got) == [b"a", b"bb", b"ccc"]


def test_split_frames():
    data = struct.pack(">I", 3) + b"abc" + struct.pack(">I", 5) + b"de"
    assert datagrams.split_frames(data) == ([b"abc"], data[7:])


def test_udp_reader_keeps_rows_until_committed():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    r = datagrams._UdpReader({"port": str(port), "host": "127.0.0.1", "wait": "0.3"})
    start = r.initialOffset()
    rows, _ = r.read(start)
    assert list(rows) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"k,1,0\n", ("127.0.0.1", port))
    time.sleep(0.1)
    rows, end = r.read(start)
    assert [x[1] for x in rows] == [b"k,1,0\n"]
    assert [x[1] for x in r.readBetweenOffsets(start, end)] == [b"k,1,0\n"]
    r.commit(end)
    assert r.rows == []


def test_benchmark_rows(spark):
    df = spark.createDataFrame([(bytearray(b"a,1,0\nb,0,1\n"),)], "MESSAGE binary")
    assert [tuple(r) for r in datagrams.parse_benchmark_rows(df).collect()] == [("a", 1, 0), ("b", 0, 1)]


def _pcap():
    payload = b"GET / HTTP/1.1"
    tcp = struct.pack(">HHIIHHHH", 40000, 80, 1000, 2000, 5 << 12 | 0x18, 512, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0, socket.inet_aton("10.0.0.1"), socket.inet_aton("10.0.0.2")) + tcp
    back = struct.pack(">HHIIHHHH", 80, 40000, 2000, 1014, 5 << 12 | 0x10, 512, 0, 0)
    ip2 = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(back), 1, 0, 64, 6, 0, socket.inet_aton("10.0.0.2"), socket.inet_aton("10.0.0.1")) + back
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, x in enumerate((ip, ip2)):
        frame = b"\0" * 12 + struct.pack(">H", 0x0800) + x
        out += struct.pack("<IIII", 100 + i, 5, len(frame), len(frame)) + frame
    return out, payload


def test_pcap(spark):
    raw, payload = _pcap()
    got = decode.pcap(spark.createDataFrame([(bytearray(raw), "f"), (bytearray(b"junk"), "g"), (None, "h")], "DATA binary, FILENAME string"), group_ports=True).orderBy("N").collect()
    assert [(r.SRCIP, r.SRCPORT, r.DSTPORT, r.FLAGS, bytes(r.CONTENT)) for r in got] == [("10.0.0.1", 40000, 80, 0x18, payload), ("10.0.0.2", 80, 40000, 0x10, b"")]
    assert got[0].BIFLOW == got[1].BIFLOW and got[0].DIRFLOW != got[1].DIRFLOW
    assert {r.SERVER for r in got} == {"10.0.0.2"}


def test_dns(spark):
    q = struct.pack(">HHHHHH", 7, 0x8180, 1, 1, 0, 0) + b"\3www\7example\3org\0" + struct.pack(">HH", 1, 1)
    m = q + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    df = spark.createDataFrame([(bytearray(m),), (bytearray(b"xx"),), (None,)], "b binary").select(decode.dns("b").alias("d"))
    a, b, c = (r.d for r in df.collect())
    assert (a.ID, a.RESPONSE, a.QNAME, a.QTYPE) == (7, True, "www.example.org", 1)
    assert [(x.SECTION, x.NAME, x.TTL, x.DATA) for x in a.RECORDS] == [("ANSWER", "www.example.org", 60, "1.2.3.4")]
    assert b is None and c is None
    loop = struct.pack(">HHHHHH", 7, 0, 1, 0, 0, 0) + b"\xc0\x0c" + struct.pack(">HH", 1, 1)
    assert decode.dns_message(loop) is None


def test_tls(spark):
    name = b"example.org"
    sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    ext = struct.pack(">HH", 0x0A0A, 0) + struct.pack(">HH", 0, len(sni)) + sni + struct.pack(">HHHH", 10, 4, 2, 29) + struct.pack(">HHBB", 11, 2, 1, 0)
    hello = struct.pack(">H", 0x0303) + b"\0" * 32 + b"\0" + struct.pack(">HHH", 4, 0x1301, 0x1A1A) + b"\1\0" + struct.pack(">H", len(ext)) + ext
    body = b"\1" + struct.pack(">I", len(hello))[1:] + hello
    m = struct.pack(">BHH", 22, 0x0301, len(body)) + body
    r = spark.createDataFrame([(bytearray(m),)], "b binary").select(decode.tls("b").alias("t")).first().t
    assert (r.HANDSHAKE, r.SNI, r.JA3) == (1, "example.org", "771,4865,0-10-11,29,0")
    assert decode.tls_record(b"GET / HTTP") is None


def test_streams(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", i * 10) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(1).write.parquet(str(tmp_path / "e.parquet"))
    s = replay.stream(spark, str(tmp_path / "e.parquet"))
    got = replay.collect(stateful.apply(s, "k", stateful.uniq_expire(50)).select("event_id"))
    want = stateful.apply(df, "k", stateful.uniq_expire(50)).select("event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counts = replay.collect(replay.window_counts(replay.stream(spark, str(tmp_path / "e.parquet")), "1 minute", by="k"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 20


def test_state_of_streams_expires(spark, tmp_path):
    """With a watermark the store forgets keys whose time is over; the rows that pass stay the same."""
    path = str(tmp_path / "e")
    for n in range(4):
        rows = [(100 * n + i, f"k{n}{i}", 10_000 + 1000 * n + i) for i in range(20)]
        spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    s = replay.stream(spark, path, files_per_trigger=1).withWatermark("ts", "1 second")
    q = stateful.apply(s, "k", stateful.uniq_expire(50)).select("event_id").writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("expiring").count() == 80
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 40  # of 80 keys


@pytest.mark.parametrize("make", [lambda s: replay.sessions(s, "k", "30 seconds"), lambda s: replay.distinct_within(s, ["k"])])
def test_stream_plans(spark, tmp_path, make):
    spark.createDataFrame([("a", 1)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "t.parquet"))
    assert make(replay.stream(spark, str(tmp_path / "t.parquet"))).isStreaming


def test_containers(spark, tmp_path):
    df = spark.createDataFrame([(1, -5, 2.5, "é", bytearray(b"\x01"), ("in", None)), (1 << 40, None, None, None, None, None)], "a long, b long, c double, s string, raw binary, n struct<x: string, y: int>")
    df = df.withColumn("t", F.timestamp_millis(F.lit(1234567)))
    folder = str(tmp_path)

    def put(name, raw):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(raw)

    for compress in (False, True):
        assert writers.buffers(records.containers(df.coalesce(1), compress=compress), "DATA", "FILE", put) == 1
        got = sorted((r.members for r in records.read(readers.files(spark, folder, pattern="*.buffer")).collect()), key=len)
        assert got == [{"a": str(1 << 40), "t": "1970-01-01T00:20:34.567000Z"}, {"a": "1", "b": "-5", "c": "2.5", "s": "é", "raw": "01", "n": '{"x": "in"}', "t": "1970-01-01T00:20:34.567000Z"}]
    with pytest.raises(ValueError, match="header"):
        list(records.frames(b"something else"))


def test_sources_in_pipelines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,1\nb,2\na,3\n")
    got = graph.run(f"csv_in K V -r {tmp_path}/a.csv -N | keycount K", {})
    assert sorted((r.K, r.COUNT) for r in got.collect()) == [("a", 2), ("b", 1)]
    (tmp_path / "list").write_text(f"{tmp_path}/a.csv\n{tmp_path}/b.csv\n")
    (tmp_path / "b.csv").write_text("z:5;6\n")
    got = graph.run(f"csv_in V -F {tmp_path}/list -l -N -d , -s \":;\"", {})
    assert sorted((r._labels[0], r.V) for r in got.collect()) == [("a", "1"), ("a", "3"), ("b", "2"), ("z", "5")]
    (tmp_path / "i.csv").write_text("BOX\t[A]1\t[B]x\n[B]y\t[C]\n")
    got = graph.run(f"csv_in A B -r {tmp_path}/i.csv -I -N", {})
    assert sorted(((r._labels, r.A, r.B) for r in got.collect()), key=str) == [(None, None, "y"), (["BOX"], "1", "x")]
    assert sorted(map(str, (r.fields for r in graph.run(f"csv_in -r {tmp_path}/i.csv -I", {}).collect()))) == ["{'A': '1', 'B': 'x'}", "{'B': 'y', 'C': ''}"]
    for name in ("list", "b.csv", "i.csv"):
        (tmp_path / name).unlink()
    assert graph.run("source_keygen -c 20 -m 0xF -s 3", {}).count() == 20
    assert graph.run("exec_in printf x | strlen BUFFER", {}).first().STRLEN == 1
    assert graph.run(f"file_in -F {tmp_path} -m", {}).first().LENGTH == 12
    store = spark.createDataFrame([("a", 5)], "K string, N long")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "K string, event_id long")
    assert sorted((r.K, r.VALUE) for r in graph.run("rows -> $r\nstore -> $s\n$r, $s:STORE | redis K -V N", {"rows": rows, "store": store}).collect()) == [("a", 5), ("b", None)]
