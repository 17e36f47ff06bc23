"""The expression language and the pipeline language."""

import pytest
from pyspark.sql import functions as F

from eventloom.plans import graph
from eventloom.plans.calc import CalcError, calc, tokens
from eventloom.plans.registry import ENTRIES, duration


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a", 7, 2.5), (2, "b", -3, None), (3, "a", 4, 1.0)], "event_id long, k string, n long, x double")


def col(df, c):
    return [r[c] for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize(
    ("script", "want"),
    [
        ("R = n / 2;", [3, -1, 2]), ("R = n % 4;", [3, -3, 0]), ("R = 2 + 3 * n;", [23, -7, 14]), ("R = x + 1;", [3.5, 1.0, 2.0]), ("R = missing + 5;", [5, 5, 5]), ("R = n / 0;", [None] * 3),
        ('R = k + "-" + n;', ["a-7", "b--3", "a-4"]), ('R = strfind("abc", k);', [0, 1, 0]), ("R = n > 3 && n < 6;", [False, False, True]), ("R = !(n > 3);", [False, True, False]), ("R = exists(x);", [True, False, True]),
        ("R = (n << 2) | 1;", [29, -11, 17]), ("R = ~n;", [-8, 2, -5]), ("R = cast(int, x);", [2, 0, 1]), ("R = 0x10;", [16] * 3), ("R = 1; R += n;", [8, -2, 5]), ('R = "no"; if n > 3 then R = "yes"; endif;', ["yes", "no", "yes"]),
        ("#t = n * 2; R = #t + 1;", [15, -5, 9]), ("#s += n; R = #s;", [7, 4, 8]), ("#s[k] += n; R = #s[k];", [7, -3, 11]), ("#c[k]++; R = #c[k];", [1, 1, 2]),
        ("enqueue(#w[k], 2, n); R = qsum(#w[k]);", [7, -3, 11]), ("R = abs(n);", [7, 3, 4]), ('R = substr("hello", 1, 3);', ["ell"] * 3),
    ],
)
def test_calc(df, script, want):
    assert col(calc(df, script), "R") == want


def test_calc_filters_and_labels(df):
    assert col(calc(df, "#PASS = n > 0;"), "event_id") == [1, 3]
    assert col(calc(df, "#FAIL = n > 0;"), "event_id") == [2]
    assert col(calc(df, "if n > 5 then label(BIG); endif;"), "_labels") == [["BIG"], [], []]


@pytest.mark.parametrize("script", ["R = ;", "R = 1 2;", "1 = R;", "R = nofn(1);", 'R = "a" * 2;', "enqueue(#w, 2, n); R = qsum(#w);", "if n then R = 1;"])
def test_calc_errors(df, script):
    with pytest.raises(CalcError):
        calc(df, script)


def test_calc_comments():
    assert [t for _, t in tokens("a = 1; // x\n/* y */ b = 2.5;")] == ["a", "=", "1", ";", "b", "=", "2.5", ";"]


def test_graph_union_ports_and_labels(df):
    text = """
    t | match k -R a -> $x          # a comment
    t | match k -R b -> $x
    $x | calc "if n < 0 then label(NEG); endif;" -> $y
    $y.NEG | subtuple event_id
    """
    assert col(graph.run(text, {"t": df}), "event_id") == [2]
    assert graph.Graph({"t": df}).run(text, "x").count() == 3


def test_graph_macro_and_environment(df):
    text = "%func big($in -> $out) { $in | match_uint n -g ${LEAST} -> $tmp; $tmp | subtuple event_id n -> $out }\nt -> $s\n%big($s -> $a)\n%big($s -> $b)\n$a, $b | keycount event_id"
    got = graph.run(text, {"t": df}, env={"LEAST": "3"})
    assert sorted((r.event_id, r.COUNT) for r in got.collect()) == [(1, 2), (3, 2)]


def test_graph_ports(df):
    got = graph.run("t | match k -R a -> $l\nt | calc \"event_id = event_id + 10;\" -> $r\n$l:LEFT, $r:RIGHT | join -K k -L n -R x", {"t": df})
    assert sorted(got.columns) == ["event_id", "k", "n", "x"]
    assert [(r.event_id, r.n, r.x) for r in got.collect()] == [(11, 4, 2.5)]  # once: the second left row waits, the first right one takes it


def test_one_shot_join_of_repeated_keys(spark):
    l, r = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (5, "a", 3)], "event_id long, k string, x int"), spark.createDataFrame([(3, "a", 10), (4, "a", 20)], "event_id long, k string, y int")
    got = graph.run("l -> $l\nr -> $r\n$l:LEFT, $r:RIGHT | jointuple -K k", {"l": l, "r": r})
    assert sorted((q.event_id, q.x, q.y) for q in got.collect()) == [(3, 2, 10), (5, 3, 20)]


def test_pattern_files(spark, df, tmp_path):
    (tmp_path / "p").write_text('# comment\n"ha" (GREET)\n"\\x77orld" (PLACE) offset=6\n{6162} (HEX)\n"ye" (END) atend\nnot a pattern\n')
    (tmp_path / "v").write_text("# comment\nhallo world\n\nz\\x7a\n")
    (tmp_path / "bare").write_text("^b.e$\no w\n")
    t = spark.createDataFrame([(1, "hallo world"), (2, "abc"), (3, "bye"), (4, "zz"), (5, None), (6, "None")], "event_id long, k string")
    ids = lambda text: sorted(r.event_id for r in graph.run(text, {"t": t}).collect())
    assert ids(f"t | match k -F {tmp_path}/p") == [1, 2, 3] and ids(f"t | match -F {tmp_path}/p") == [1, 2, 3]
    assert ids(f"t | match k -F {tmp_path}/p -R zz") == [1, 2, 3, 4]
    assert ids(f"t | fixedmatch k -F {tmp_path}/p") == [1, 2, 3]
    assert ids(f"t | exactmatch k -F {tmp_path}/v") == [1, 4] and ids(f"t | exactmatch k -F {tmp_path}/v -R abc") == [1, 2, 4]
    assert ids(f"t | dpu k -F {tmp_path}/bare -B") == [1, 3] and ids(f"t | dpu k -F {tmp_path}/p") == [1, 2, 3]
    tagged = graph.run(f"t -> $t\n$t:TAG | match k -F {tmp_path}/p", {"t": t})
    assert {r.event_id: r.MATCHES for r in tagged.collect()}[1] == ["GREET", "PLACE"]
    for text in ("t | match k", "t | fixedmatch k", "t | exactmatch k"):
        with pytest.raises(ValueError, match="-F"):
            graph.run(text, {"t": t})


@pytest.mark.parametrize("text", ["t | uniq k -p 0.1", "t | keytime k -L state", "t | keysort k -V n -n 3", "t | bloom k -O state"])
def test_options_that_would_change_the_result_are_refused(df, text):
    with pytest.raises(graph.GraphError, match="not available"):
        graph.run(text, {"t": df})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tue, 04 May 2010 04:31:27 GMT", 1272947487), ("Tue 04 May 2010 04:31:27 GMT", 1272947487), ("Tue May 04 2010 04:31:27 GMT", 1272947487), ("Tue, 04-May-2010 04:31:27 GMT", 1272947487), ("04 May 2010 04:31:27 GMT", 1272947487),
        ("Tue May 04 04:31:27 GMT 2010", 1272947487), ("Tue May  4 04:31:27 2010", 1272947487), ("Tuesday May 4, 2010, 04:31:27", 1272947487), ("2010-05-04 04:31:27 AM", 1272947487), ("2010-05-04 04:31:27", 1272947487),
        ("2010-05-04 04:31 pm", 1272990660), ("05/04/10 04:31 AM", 1272947460), ("05/04/2010 12:31:27 PM", 1272976287), ("2010-05-04 12:00:00 AM", 1272931200), ("2010-05-04", 1272931200), ("2010-05-04T04:31:27Z", 1272947487), ("no date", None), ("2010-13-04 04:31:27", None),
    ],
)
def test_dates(spark, text, want):
    t = spark.createDataFrame([(1, text)], "event_id long, s string")
    assert calc(t, "T = parseDate(s); N = cast(int, T);").first()["N"] == want


def test_epochs_and_last_values(spark, df, tmp_path):
    (tmp_path / "s").write_text("#c[k]++;\n")
    assert col(graph.run('t | calc "if n < 0 then flush; endif;"', {"t": df}), "epoch") == [0, 0, 1]
    got = graph.run(f't | calc -S {tmp_path}/s -N "#s[k] += n;"', {"t": df})
    assert sorted(map(tuple, got.select("k", "c", "s").collect())) == [("a", 2, 11), ("b", 1, -3)]
    assert col(graph.run("t | match k -R a | flush -C 1", {"t": df}), "epoch") == [0, 1]


def test_state_tables(spark, df, tmp_path):
    """What a run has stored, the next one begins with; also where both name the same table."""
    for _ in range(2):
        first = graph.run(f"t | firstn k -N 1 -O {tmp_path}/a", {"t": df})
    assert col(first, "event_id") == [1, 2] and {r.k: r.n for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {"a": 2, "b": 1}
    assert col(graph.run(f"t | firstn k -N 2 -F {tmp_path}/a -O {tmp_path}/a", {"t": df}), "event_id") == [2]
    assert {r.k: r.n for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {"a": 4, "b": 2}
    assert col(graph.run(f"t | untiln k -N 4 -F {tmp_path}/a", {"t": df}), "event_id") == [1, 3]
    assert col(graph.run(f"t | match k -R a | uniq k -O {tmp_path}/u", {"t": df}), "event_id") == [1]
    assert col(graph.run(f"t | uniq k -L {tmp_path}/u", {"t": df}), "event_id") == [2]
    assert col(graph.run(f"t -> $t\n$t:TAG | uniq k -L {tmp_path}/u -T SEEN -S yes", {"t": df}), "SEEN") == ["yes", None, "yes"]


def test_removed_keys_are_new_again(spark, df):
    gone = spark.createDataFrame([(2, "a"), (9, "a")], "event_id long, k string")
    text = "t -> $t\ngone -> $g\n$t, $g:REMOVE | uniq k"
    assert col(graph.run(text, {"t": df, "gone": gone}), "event_id") == [1, 2, 3]
    assert col(graph.run(text, {"t": df, "gone": gone.limit(0)}), "event_id") == [1, 2]


def test_printed_lines(spark, df, tmp_path):
    lines = lambda text: [r.line for r in graph.run(text, {"t": df.coalesce(1)}).collect()]
    assert lines("t | print event_id k -s ;".replace(";", '";"')) == ["1;a", "2;b", "3;a"]
    assert lines("t | print k x -V") == ["k=a,x=2.5", "k=b", "k=a,x=1.0"] and lines("t | print k x -L") == ["k,x", "k", "k,x"]
    assert lines("t | print k n -H")[0] == "k,n" and lines("t | print k n -TV")[0] == "  k: a\n  n: 7"
    binary = df.select(F.encode("k", "UTF-8").alias("b"))
    assert [r.line for r in graph.run("t | print -X", {"t": binary}).collect()] == ["61", "62", "61"]
    lines(f"t | print k -O {tmp_path}/o")
    lines(f"t | metadice k -w {tmp_path}/o")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/o").collect()) == ["a", "a", "b"]
    graph.run(f"t | print k -A {tmp_path}/r -t 1m", {"t": df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 40))})
    assert sorted(map(tuple, spark.read.text(f"{tmp_path}/r").select("value", "period").collect())) == [("a", "19700101-000000"), ("a", "19700101-000200"), ("b", "19700101-000100")]


def test_sinks_in_pipelines(df, tmp_path):
    import os

    assert graph.run(f"t | writebuffer k -o {tmp_path}/b | subtuple n", {"t": df}).count() == 3
    assert sorted(os.listdir(tmp_path / "b")) == ["1.buffer", "2.buffer", "3.buffer"] and (tmp_path / "b" / "2.buffer").read_bytes() == b"b"
    graph.run(f"t | subtuple event_id k | wsproto_out -w {tmp_path}/c", {"t": df})
    assert graph.run(f"wsproto_in -r {tmp_path}/c", {}).count() == 3


@pytest.mark.parametrize("text", ["nosource | top n", "t | nokid", "t | top n -Z 3", "$never | top n", "t | | top n", "%none($a -> $b)", "t | keycount k -L"])
def test_graph_errors(df, text):
    with pytest.raises(graph.GraphError):
        graph.run(text, {"t": df})


def test_aliases_and_durations():
    assert ENTRIES["countkey"] is ENTRIES["keycount"]
    assert len({e.name for e in ENTRIES.values()}) >= 85
    assert [duration(x) for x in ("90", "2m", "1h", "1d")] == [90, 120, 3600, 86400]


def test_every_simple_operator_runs(df):
    df = df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 100))
    for text in (
        "t | sort n", "t | rbsort x -r", "t | keyadd k -V n -P", "t | keyaverage k -V n", "t | keyvariance k -V x -F", "t | labelstat", "t | heavyhitters k -N 2", "t | groupevents k -C n -V x", "t | bandwidth",
        "t | firstn k -N 1", "t | untiln k -N 1", "t | uniq k", "t | bloom k", "t | uniqexpire k -t 1m", "t | keyarrival k", "t | keydiff k -V n", "t | keyEWMA k -V n -a 0.5", "t | keyrate k -t 60 -m 1", "t | keytrans k", "t | keyflow k -t 1m",
        "t | keytime k", "t | keysort k -V n", "t | periodic k", "t | persist k -c 1", "t | onlyafter k -A x", "t | keyadd_initial k -V n -l 2", "t | countfilter k", "t | stateclimb k x=5 -T 3", "t | lastn k -V n -N 2", "t | keeplast k -V n",
        "t | keepn k -V n -n 2", "t | mergetuple n -K k", "t | appendlast k -V n -A", "t | strlen k -g 0", "t | hmac k -A sha256", "t | tr k -f a -t b", "t | splitstring k -R a", "t | editdistance k -S abc", "t | tuple2json k n", "t | print -V", "t | metadice",
        "t | editdistance k -K k", "t | flush -C 2", "t | sample -p 1.0", "t | label L", "t | mknest k n -L N | denest N", "t | fillmissing x -V 0.5", "t | addlabelmember SITE -V here", "t | loadbalance n -N 3", "t | timestamp -L NOW", "t | filemagic k -m", "t | entropy k",
        "t | bundle | unbundle | noop", "t | cntquery k",
    ):
        graph.run(text, {"t": df}).count()


def test_describe():
    from eventloom.plans.registry import describe

    assert any(x.startswith("operator keycount (countkey)") and "-P" in x for x in describe())
    assert describe("levenshtein")[0].startswith("operator editdistance") and describe("no such thing") == []


def test_command_line(spark, df, tmp_path, capsys):
    from eventloom.__main__ import main

    df.write.parquet(str(tmp_path / "t.parquet"))
    assert main(["run", "t | top n -N 1 | subtuple event_id n", "--table", f"t={tmp_path}/t.parquet"]) == 0
    assert "|1       |7  |" in capsys.readouterr().out
    assert main(["run", "t | keycount k -> $c", "--table", f"t={tmp_path}/t.parquet", "--stream", "c", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    assert main(["describe", "keyflow"]) == 0 and "keyflow" in capsys.readouterr().out


def test_counts_with_epochs_and_expiry(spark):
    rows = [(i, "a", i * 50) for i in range(1, 7)]
    t = spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    text = "t -> $a\nt -> $b\n$a:INCREMENT, $b | cntquery k -m 2 -E 2m"
    assert sorted((r.event_id, r.CNT) for r in graph.run("t -> $a\n$a:ADDQUERY | cntquery k -m 2 -E 2m", {"t": t}).collect()) == [(2, 2), (4, 2), (6, 2)]
    assert graph.run(text, {"t": t}).count() > 0
    assert sorted(r.event_id for r in graph.run("t | untiln k -N 1 -E 2m", {"t": t}).collect()) == [2, 3, 5, 6]
