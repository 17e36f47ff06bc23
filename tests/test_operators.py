"""Operators on small hand-made inputs: absent members, ports, ties."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.functions import magic, strings, structured, types
from eventloom.operators import aggregates, filters, joins, keyed, shape, sorts
from eventloom.streaming import stateful


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


@pytest.fixture
def e(spark):
    data = [(1, "a", 5.0, 0), (2, "a", 7.0, 30), (3, "b", None, 31), (4, "a", 1.0, 95), (5, "b", 2.0, 96), (6, None, 3.0, 97)]
    return spark.createDataFrame(data, "event_id long, k string, v double, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_subtuple_drops_rows_without_members(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, b int, c string")
    assert rows(shape.subtuple(df, ["a", "b"])) == [(1, None)]
    assert rows(shape.subtuple(df, ["a"], fill_empty=True)) == [("1",)]


def test_remove_members_drops_empty_rows(spark):
    df = spark.createDataFrame([(1, 2), (3, None)], "a int, b int")
    assert rows(shape.remove_members(df, ["a"])) == [(2,)]
    assert shape.remove_members(df, ["a", "b"]).count() == 0


def test_nesting_round_trip(spark):
    df = spark.createDataFrame([(1, "x", 2), (None, None, 3)], "a int, b string, c int")
    nested = shape.make_nest(df, ["a", "b"], "N")
    assert nested.where("N is null").count() == 1
    assert rows(shape.denest(nested, "N")) == [(1, "x")]
    assert shape.remove_nested(nested, "N.a").schema["N"].dataType.names == ["b"]
    assert "z" in shape.denest(shape.make_nest(df, ["a"], "N").withColumnRenamed("a", "z"), "N", append=True).columns


def test_labels(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "a int, b int")
    big = shape.add_label(df, "BIG", F.col("b") > 3)
    assert rows(joins.with_label(big, "BIG"), "a") == [(1,)]
    assert rows(filters.has_label(big, ["BIG"], negate=True), "a") == [(2,)]
    assert rows(shape.make_labelset(df, "L", ["a", "b"]), "L") == [(["a", "b"],), (["a"],)]
    assert rows(shape.data_to_label(df, "b"), "_labels") == [(["b=5"],), ([],)]


def test_duplicates_and_count(spark):
    df = spark.createDataFrame([("x", "x", "y"), (None, "q", "q")], "a string, b string, c string")
    out = shape.duplicates(df, ["a", "b", "c"], first="F")
    assert rows(out, "DUPLICATE", "F") == [(["b"], ["a", "c"]), (["c"], ["b"])]
    assert rows(shape.count_labels(df, ["a", "b", "c"], eq=2), "b") == [("q",)]


def test_fill_missing_nested(spark):
    df = spark.createDataFrame([((1, None),), ((2, "z"),)], "s struct<a: int, b: string>")
    assert rows(shape.fill_missing(df, "s.b", "none").select("s.b")) == [("none",), ("z",)]


def test_predicate_ports(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "n int")
    assert rows(filters.match_uint(df, "n", greater=2)) == [(5,)]
    assert rows(filters.match_uint(df, "n", greater=2, port="INVERSE")) == [(1,), (None,)]
    assert rows(filters.match_uint(df, "n", eq=1, greater=2)) == [(1,)]
    assert rows(filters.match_uint(df, "n", ne=1, port="TAG"), "MATCH") == [(False,), (False,), (True,)]


def test_fixed_match_from_end(spark):
    df = spark.createDataFrame([("file.txt",), ("file.csv",), ("txt",)], "s string")
    assert rows(filters.fixed_match(df, "s", {".txt": "t"}, from_end=True)) == [("file.txt",)]


def test_match_table(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, "dog")], "i int, t string")
    words = spark.createDataFrame([("cat", "C"), ("at s", "S"), ("cow", "W")], "pattern string, label string")
    assert rows(filters.match_table(texts, "t", words), "i", "MATCHES") == [(1, ["C", "S"]), (2, None), (3, [])]


def test_first_last(e):
    assert rows(keyed.first_n(e, "k", 1), "event_id") == [(1,), (3,)]
    assert rows(keyed.until_n(e, "k", 2), "event_id") == [(4,)]
    assert rows(keyed.append_last(e, "k", "v"), "event_id", "LAST") == [(2, 5.0), (4, 7.0)]
    assert rows(keyed.append_first(e, "k", "v"), "event_id", "FIRST", "NEXT") == [(2, 5.0, 7.0), (4, 5.0, 1.0)]


def test_flow_counts_and_gaps(e):
    assert rows(keyed.flow(e, "k", gap=60), "event_id", "session") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert rows(keyed.flow(e, "k", gap=60, most=1), "event_id", "session") == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 1)]


def test_average_divides_by_events(e):
    assert rows(aggregates.key_average(e, "k", "v")) == [("a", 3, 13.0, 13 / 3), ("b", 2, 2.0, 1.0)]


def test_variance_of_one_value(e):
    assert rows(aggregates.key_variance(e, "k", "v"), "k", "VARIANCE")[1] == ("b", 0.0)


def test_keep_and_merge(e):
    assert rows(keyed.keep_n(e, "k", "v", 2)) == [("a", [7.0, 1.0]), ("b", [2.0])]
    assert rows(keyed.keep_n(e, "k", "v", 2, blocks=True)) == [("a", 0, [5.0, 7.0])]
    assert rows(keyed.merge(e, "k", ["v"], ["event_id"], 2), "k", "event_id", "v") == [("a", 1, [5.0, 7.0]), ("b", 3, [None, 2.0])]


def test_as_of_values(e, spark):
    other = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0)], "k string, event_id long, w double")
    got = keyed.keep_last_of(e.select("k", "event_id"), other, "k", "w")
    assert rows(got, "event_id", "KEPT") == [(1, 1.0), (2, 1.0), (3, None), (4, 2.0), (5, None), (6, None)]


def test_one_shot_join(spark):
    left = spark.createDataFrame([("k", 1, "l1"), ("k", 2, "l2"), ("k", 5, "l5")], "k string, o long, x string")
    right = spark.createDataFrame([("k", 3, "r3"), ("k", 4, "r4")], "k string, o long, y string")
    # l2 replaces l1 and meets r3; r4 waits and meets l5
    assert rows(joins.join_once(left, right, "k", "o").select("left.x", "right.y")) == [("l2", "r3"), ("l5", "r4")]


def test_store(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 9, 1), ("c", 3, 2), ("c", 4, 3)], "k string, v long, o long")
    assert rows(joins.put(store, new, "k", "v", "o")) == [("a", 1), ("b", 9), ("c", 4)]
    assert rows(joins.put(store, new, "k", "v", "o", only_new=True)) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(joins.increment(store, new, "k", "v", "v")) == [("a", 1), ("b", 11), ("c", 7)]


def test_expiring_uniqueness(e):
    got = stateful.apply(e.select("event_id", "k", "ts"), "k", stateful.uniq_expire(60))
    assert rows(got, "event_id") == [(1,), (3,), (4,), (5,)]


def test_clamped_climb(spark):
    df = spark.createDataFrame([(i, "a") for i in range(1, 8)], "event_id long, k string")
    got = stateful.apply(df, "k", stateful.clamped_climb(lambda r: 4.0, 10, 11, 0, reset=True))
    assert rows(got, "event_id") == [(3,), (6,)]


def test_rank_and_running_total(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("event_id"), F.lit(2).alias("v"))
    ranked = sorts.global_rank(df, ["event_id"])
    assert ranked.where(F.col("rank") != F.col("event_id") + 1).count() == 0
    total = sorts.running_total(df, "v", "event_id", "t")
    assert total.where(F.col("t") != 2 * (F.col("event_id") + 1)).count() == 0


def test_type_detection(spark):
    cases = {"12": "uint", "1234567890": "uint64", "-3": "int", "-123456789": "int64", "1.5": "double", "2e5": "double", "1:2": "string", "2024-01-02T03:04:05Z": "time", " 7": "uint", "1.2.3": "string", "abc": "string"}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", types.detected_kind(F.col("c")).alias("k"))
    assert {r.c: r.k for r in df.collect()} == cases == {c: types.kind(c) for c in cases}


def test_text_functions(spark):
    df = spark.createDataFrame([("a,b,,c", "k=1 q=\"x y\" k=2 bare", "zz")], "a string, b string, c string")
    one = df.select(
        strings.split("a", ",").alias("s"), strings.split("a", ",", skip=1, most=1).alias("t"), strings.split("a", ",", last=True).alias("u"), strings.key_values("b").alias("kv"), strings.bare_tokens("b").alias("bare"),
        strings.sed("a", "s/b/BB/").alias("sed"), strings.entropy("c").alias("e"), strings.from_hex(F.lit("4a4B")).cast("string").alias("h"), strings.substring("a", 10, 2).alias("none"), strings.hex_dump("c").alias("x"),
    ).first()
    assert (one.s, one.t, one.u, one.kv, one.bare) == (["a", "b", "c"], ["b"], "c", {"k": "2", "q": "x y"}, ["bare"])
    assert (one.sed, one.e, one.h, one.none, one.x) == ("a,BB,,c", 0.0, "JK", None, "7A 7A")


def test_byte_measures(spark):
    """Of every length in one pass, long buffers included; equal to counting one by one."""
    cases = [b"", None, b"zz", "äöü €".encode(), bytes(range(256)), bytes(i * i % 251 for i in range(4000)), b"ab" * 700_000, *(b"large ring %d" % i for i in range(2100))]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    start = time.monotonic()
    got = {r.i: (r.e, r.x) for r in df.select("i", strings.entropy("c").alias("e"), strings.chi_square("c").alias("x")).collect()}
    assert time.monotonic() - start < 60
    for i, c in enumerate(cases):
        n, counts = len(c or b""), Counter(c or b"")
        want = (-sum(k / n * math.log2(k / n) for k in counts.values()), sum((counts[v] - n / 256) ** 2 / (n / 256) for v in range(256))) if n else (None, None)
        assert got[i] == (pytest.approx(want) if n else want)


def test_json_and_magic(spark):
    df = spark.createDataFrame([(1, [1, 2], bytearray(b"\x89PNG\r\n\x1a\n.."), None)], "i int, a array<int>, b binary, n string")
    assert structured.quoted_json(df, ["i", "a", "n"]).first().JSON == '{"i":"1","a":["1","2"]}'
    assert df.select(magic.file_type("b").alias("t")).first().t == "PNG image"
    assert spark.createDataFrame([(bytearray(b"hello"),), (bytearray(b""),), (bytearray(bytes(range(8))),)], "b binary").select(magic.file_type("b", mime=True).alias("t")).collect() == [("text/plain",), ("application/x-empty",), ("application/octet-stream",)]


def test_empty_inputs(e):
    none = e.limit(0)
    for df in (keyed.first_n(none, "k", 2), keyed.flow(none, "k"), keyed.ewma(none.select("event_id", "k", "v"), "k", "v"), aggregates.key_count(none, "k", pct=True), sorts.global_rank(none, ["event_id"])):
        assert df.count() == 0


def test_counts_of_the_anomaly_benchmark(spark):
    """Against a plain count over the generated rows."""
    from eventloom.sources import readers

    made = readers.biased_keys(spark, 4000, 100).withColumnRenamed("id", "event_id")
    by: dict = {}
    for r in made.orderBy("event_id").collect():
        by.setdefault(r.KEY, []).append(r)
    want = {"TP": 0, "FP": 0, "TN": 0, "FN": 0}
    for own in by.values():
        if len(own) >= 24:
            said, true = sum(r.VALUE for r in own[:24]) < 7, own[23].BIAS != 0
            want[("T" if said == true else "F") + ("P" if said else "N")] += 1
    assert keyed.anomaly_benchmark(made, "KEY", "VALUE", "BIAS", 24, 7).first().asDict() == want and sum(want.values()) > 50


def test_periods_are_found(spark):
    rows = [(i, "a", 100 * i) for i in range(8)] + [(100 + i, "b", i * i * 37) for i in range(8)]
    t = spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = stateful.apply(t, "k", stateful.periodic(4, 3, 0.05)).collect()
    assert [(r.event_id, r.PERIOD, r.PERIOD_COUNT) for r in sorted(got, key=lambda r: r.event_id)] == [(i, 100.0, i) for i in range(3, 8)]


def test_edit_distance_forms_agree(spark):
    rows = [(1, "a", "kitten"), (2, "a", None), (3, "a", "sitting"), (4, "b", "x"), (5, "a", ""), (6, "b", "x"), (7, None, "y")]
    t = spark.createDataFrame(rows, "event_id long, k string, v string")
    cols = ("event_id", "EDITDISTANCE", "EDITNORM")
    assert [r for r in globals()["rows"](keyed.edit_distance(t, "k", "v"), *cols)] == [r for r in globals()["rows"](stateful.apply(t, "k", stateful.edit_distance_of_key("v")), *cols)]


def test_one_document_has_a_bound(spark):
    assert structured.one_document(spark.range(3), ["id"], 3).first()[0] == '[{"id":"0"},{"id":"1"},{"id":"2"}]'
    with pytest.raises(Exception, match="more than 2 records"):
        structured.one_document(spark.range(3), ["id"], 2).collect()


def test_places_follow_the_order(spark):
    t = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(5)
    got = {r.id: r["rank"] for r in sorts.placed(sorts.sort(t, "v", ties=["id"])).collect()}
    want = sorted(range(500), key=lambda i: (-(i * 37 % 101), i))
    assert [got[i] for i in want] == list(range(1, 501))
