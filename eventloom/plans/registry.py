"""Names, aliases and options of the operators of the pipeline language (fixed values, so that pipelines keep working).

Every entry turns a parsed call (inputs by port, arguments, options) into a DataFrame by calling the library's functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, magic, strings, structured
from ..operators import aggregates, filters, joins, keyed, shape, sorts
from ..session import materialise
from ..sources import datagrams, patterns, readers, records, writers
from ..streaming import stateful


@dataclass
class Call:
    """One operator in a pipeline: its inputs by port ('' is the main one), arguments and options."""

    inputs: dict[str, DataFrame]
    args: list[str]
    opts: dict[str, str | bool]
    order: str = "event_id"
    time: str = "ts"
    env: dict = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        if "" not in self.inputs:
            raise ValueError("the operator has no input on its main port")
        return self.inputs[""]

    @property
    def port(self) -> str:
        """The one port in use, '' for the main one."""
        return next((p for p in self.inputs if p), "")

    @property
    def any(self) -> DataFrame:
        return self.inputs.get("", next(iter(self.inputs.values())))

    def has(self, o: str) -> bool:
        return o in self.opts

    def get(self, o: str, default=None):
        return self.opts.get(o, default)

    def int(self, o: str, default: int | None = None) -> int | None:
        return int(self.opts[o]) if o in self.opts else default

    def float(self, o: str, default: float | None = None) -> float | None:
        return float(self.opts[o]) if o in self.opts else default

    @property
    def key(self) -> str:
        return str(self.opts.get("K") or self.args[0])


def duration(text: str) -> int:
    """Seconds of 90, 90s, 5m, 2h or 1d."""
    m = re.fullmatch(r"(\d+)([smhd]?)", str(text))
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


@dataclass
class Entry:
    name: str
    options: str  # letters; a colon follows those that take a value
    run: Callable[[Call], DataFrame]
    aliases: tuple[str, ...] = ()
    refused: str = ""  # options that would change the result and aren't available

    def takes_value(self, letter: str) -> bool | None:
        """None for an unknown option."""
        i = self.options.find(letter)
        return None if i < 0 else self.options[i + 1 : i + 2] == ":"


ENTRIES: dict[str, Entry] = {}


def entry(names: str, options: str = "", refused: str = ""):
    name, *aliases = names.split()

    def put(run: Callable[[Call], DataFrame]):
        e = Entry(name, options, run, tuple(aliases), refused)
        for n in (name, *aliases):
            ENTRIES[n] = e
        return run

    return put


def _column(make, options: str, names: str):
    """An operator that adds one member (-L, or the operator's default name) computed from its argument."""

    def run(c: Call) -> DataFrame:
        return c.df.withColumn(str(c.get("L", names.split()[0].upper())), make(c))

    entry(names, options)(run)


# shaping
entry("addlabelmember alm addlabelm", "E:V:")(lambda c: shape.add_member(c.df, c.args[0], c.env.get(str(c.get("E")), "") if c.has("E") else str(c.get("V", "UNKNOWN"))))
entry("label labeler metalabel namer", "m:RPe")(lambda c: shape.label(c.df, c.args[0], c.get("m"), c.has("R") or c.has("P"), c.has("e")))
entry("labelmultiple", "L:pM:")(lambda c: shape.label_multiple(c.df, c.args[0], str(c.get("L", c.args[0])), c.int("M", 10)))
entry("data2label")(lambda c: shape.data_to_label(c.df, c.args[0]))
entry("mklabelset", "lL:I:S:C")(lambda c: shape.make_labelset(c.df, str(c.get("L", "LABELSET")), [] if c.has("C") else c.args, str(c.get("I", "")).split() if c.has("I") else (), c.has("l"), c.get("S")))
entry("subtuple stuple subtup tupsub", "1NRL:q")(lambda c: shape.subtuple(c.df, c.args, c.has("N"), c.has("R"), c.get("L")))
entry("removefromtuple tupledelete tupleremove", "L:")(lambda c: shape.remove_members(c.df, c.args))
entry("removenest nestdelete nestremove")(lambda c: shape.remove_nested(c.df, *c.args))
entry("dupetuple dtuple duptup tupdup", "d:L:")(lambda c: shape.duplicate(c.df, c.get("L")))
entry("mknest renest", "A:L:")(lambda c: shape.make_nest(c.df, c.args, str(c.get("L", "NEST")), c.get("A")))
entry("denest unnest flatten", "AS:L:")(lambda c: shape.denest(c.df, c.args[0], c.has("A"), c.get("S"), c.get("L")))
entry("splittuple tsplit tuplesplit", "C:L:")(lambda c: shape.split_tuple(c.df, c.args, str(c.get("C", "")).split(), str(c.get("L", "value"))))
entry("fillmissing", "V:R:S")(lambda c: shape.fill_missing(c.df, c.args[0], None if c.has("R") else str(c.get("V", "")) if c.has("S") else shape.detect(str(c.get("V", ""))), c.get("R")))
entry("countlabels", "me:l:g:L:")(lambda c: shape.count_labels(c.df, c.args, str(c.get("L", "MEMBERCNT" if c.has("m") else "LABELCNT")), c.int("e"), c.int("l"), c.int("g")))
entry("duplicates dupes duplicate innerdupe innerdupes tupledupes", "L:U:")(lambda c: shape.duplicates(c.df, c.args, str(c.get("L", "DUPLICATE")), c.get("U")))
entry("tuplehash hashtuple tuplehasher metatuplehash thash", "oL:k:BI1")(lambda c: shape.tuple_hash(c.df, c.args or c.df.columns, str(c.get("L", "TUPLEHASH")), c.has("o"), c.has("B")))
entry("loadbalance", "N:L:o")(lambda c: shape.load_balance(c.df, c.int("N", 1), c.args, str(c.get("L", "LB")), c.order))
entry("workbalance wbalance", "J:N:L:")(lambda c: shape.spread(c.df, c.int("N", 1), c.args))
entry("workreceive wreceive", "J:")(lambda c: c.df)
entry("bundle", "N:n:")(lambda c: c.df)
entry("unbundle")(lambda c: c.df)
entry("noop", "S")(lambda c: c.df)


@entry("timestamp addtime time_add datetime add_time timeadd", "Uo:L:SzeuP:")
def _timestamp(c: Call) -> DataFrame:
    unit = "now" if not c.args else "ms" if c.has("U") else "double" if c.has("e") else "s" if c.has("u") else "iso-z"
    return shape.timestamp(c.df, str(c.get("L", "DATETIME")), c.args[0] if c.args else None, unit, c.float("o", 0), c.get("P"))


# filters
entry("haslabel order", "ANm:")(lambda c: filters.has_label(c.any, [a for a in c.args if a != "NOT"], c.has("A"), c.has("N") or c.port == "NOT" or "NOT" in c.args, c.int("m")))
entry("match_uint matchu uintmatch uintcmp cmpuint", "e:n:g:l:L:")(lambda c: filters.match_uint(c.any, c.args[0], c.int("e"), c.int("n"), c.int("g"), c.int("l"), c.port))
entry("equal", "L:")(lambda c: filters.equal(c.any, c.args, c.port))
def _given(c: Call, default: str, escapes: bool = True) -> list[patterns.Pattern]:
    """The patterns of -R and of the file -F; there must be one."""
    label = str(c.get("L", default))
    out = [patterns.Pattern(patterns.unescape(str(c.get("R"))), label, c.int("O", c.int("o", 0)), c.has("e") or c.has("E"))] if c.has("R") else []
    if c.has("F"):
        out += [patterns.Pattern(p.text, p.label or label, p.offset, p.at_end) for p in patterns.labelled(_spark(), str(c.get("F")), escapes)]
    if not out:
        raise ValueError("no pattern: give one with -R or a file with -F")
    return out


@entry("match stringmatch aho", "IL:U:F:R:t:B:S:1", refused="BS")
def _match(c: Call) -> DataFrame:
    given = {p.text: p.label for p in _given(c, "MATCH")}
    return filters.match(c.any, c.args or [f.name for f in c.any.schema if f.dataType.simpleString() == "string"], given, c.has("I"), c.port, c.has("1"), "MATCHES", c.get("U"))


@entry("fixedmatch fmatch rightmatch", "L:F:R:PeEo:O:")
def _fixedmatch(c: Call) -> DataFrame:
    return filters.fixed_match(c.any, c.args[0], [(p.text, p.label, p.offset, p.at_end) for p in _given(c, "FMATCH")], port=c.port)


@entry("exactmatch ematch", "F:L:M:R:U:O:E:J:", refused="OE")
def _exactmatch(c: Call) -> DataFrame:
    values = [patterns.unescape(str(c.get("R")))] if c.has("R") else []
    if c.has("F"):
        values += [patterns.unescape(x) for x in patterns.lines(_spark(), str(c.get("F")))]
    if not values:
        raise ValueError("no value: give one with -R or a file with -F")
    return filters.exact_match(c.any, c.args[0], values if len(values) <= 1000 else _spark().createDataFrame([(v,) for v in values], "v string"), c.port, str(c.get("L", "MATCH")))


@entry("dpu tdpu tpu", "L:F:BPD:")
def _dpu(c: Call) -> DataFrame:
    """-F: a file of labelled regular expressions, of bare ones with -B."""
    path = str(c.get("F"))
    found = patterns.lines(_spark(), path) if c.has("B") else [p.text for p in patterns.labelled(_spark(), path, False)]
    if not found:
        raise ValueError(f"no pattern in {path}")
    return filters.first_pattern(c.df, c.args[0], found, str(c.get("L", "PATTERN")), c.has("P"))


entry("re2 rex", "R:L:TSN:")(lambda c: filters.regex(c.df, c.args[0], str(c.get("R")), str(c.get("L", "")).split(), c.has("T"), c.get("N")))
entry("sample", "Fp:t:")(lambda c: filters.sample(c.df, c.float("p"), 0, duration(str(c.get("t"))) if c.has("t") else None, c.time, c.order))
entry("flush", "t:C:N")(lambda c: filters.flush_epochs(c.df, c.order, c.int("C"), c.time, duration(str(c.get("t"))) if c.has("t") else None))

# joins
entry("jointuple join jointuples", "J:j:K:L:R:M:")(lambda c: joins.join_once_flat(c.inputs["LEFT"], c.inputs["RIGHT"], c.key, c.order, str(c.get("L")).split() if c.has("L") else None, str(c.get("R")).split() if c.has("R") else None))
entry("mergetuple", "J:K:DC:N:M:")(lambda c: keyed.merge(c.df, c.key, c.args, str(c.get("C", "")).split(), c.int("N", 2), c.has("D"), c.order))
entry("appendfirstitem appendfirst", "J:V:N:")(lambda c: keyed.append_first(c.any, c.args[0], str(c.get("V")), c.port, c.order))
entry("appendlast appendlastitem", "J:V:AL:N:")(lambda c: keyed.append_last(c.df, c.args[0], str(c.get("V")), c.has("A"), str(c.get("L", "LAST")), c.order))


@entry("lastn appendlastn lastn_shared appendlastn_shared", "J:F:L:lM:N:n:V:E:O:", refused="FEO")
def _lastn(c: Call) -> DataFrame:
    key, value, n, prefix = c.args[0], str(c.get("V") or c.args[1]), c.int("N", c.int("n", 1)), str(c.get("L", "LASTN"))
    for port in ("QUERY", "FILTER"):
        if port in c.inputs:
            return keyed.last_n_of(c.inputs[port], c.df, key, value, n, prefix, port == "FILTER", c.order)
    return keyed.last_n(c.any, key, value, n, prefix, c.order)


@entry("keeplast lastvalue", "J:V:N:")
def _keeplast(c: Call) -> DataFrame:
    value = str(c.get("V", c.args[-1]))
    if "QUERYAPPEND" in c.inputs:
        return keyed.keep_last_of(c.inputs["QUERYAPPEND"], c.df, c.args[0], value, value + "_KEPT", c.order)
    return keyed.keep_last(c.df, c.args[0], value.split(), c.order)


entry("keepn", "J:fcn:N:V:M:")(lambda c: keyed.keep_n(c.df, c.args[0], str(c.get("V")), c.int("N", c.int("n", 5)), c.has("f"), c.has("N"), c.has("c"), c.order))
@entry("keycount countkey", "J:PM:L:R")
def _keycount(c: Call) -> DataFrame:
    """On port QUERY: rows with the count that the main port's earlier rows have given their key."""
    name = str(c.get("L", "COUNT"))
    if "QUERY" not in c.inputs:
        return aggregates.key_count(c.df, c.args[0], c.has("P"), name=name)
    tagged = joins.union(c.df.withColumn("_port", F.lit(1)), c.inputs["QUERY"].withColumn("_port", F.lit(0)))
    return keyed.running_count(tagged, c.args[0], F.col("_port") == 0, name, [c.order, "_port"]).drop("_port")


entry("keyadd", "V:PM:L:C:R")(lambda c: aggregates.key_add(c.df, c.args[0], str(c.get("V")).split(), c.has("P")))
entry("keyaverage", "V:M:L:S:C:R")(lambda c: aggregates.key_average(c.df, c.args[0], str(c.get("V"))))
entry("keyvariance varkey", "J:K:V:L:M:FW:S")(lambda c: aggregates.key_variance(c.df, c.key, str(c.get("V")), c.has("F"), c.has("S"), c.int("W"), c.order))
entry("labelstat statlabel", "J:F:O:M:o", refused="FO")(lambda c: aggregates.label_stat(c.df))
entry("heavyhitters", "1V:L:RN:M:S")(lambda c: aggregates.heavy_hitters(c.df, c.args[0], c.int("N", 10), c.get("V"), str(c.get("L", "ACC"))))
entry("top", "N:r")(lambda c: aggregates.top(c.df, c.args[0], c.int("N", 10), c.has("r")))
entry("groupevents", "n:C:V:L:1:M:G")(lambda c: aggregates.group_events(c.df, c.args[0], str(c.get("C")), str(c.get("V", "")).split(), str(c.get("1", "")).split(), c.int("n"), c.order))
entry("bandwidth bw", "t")(lambda c: aggregates.bandwidth(c.df, c.time))


@entry("cntquery metacntquery cntquery_shared metacntquery_shared", "J:m:L:C:M:E:F:O:")
def _cntquery(c: Call) -> DataFrame:
    tagged = joins.union(*[df.withColumn("_port", F.lit(p)) for p, df in c.inputs.items()])
    delta = F.when(F.col("_port").isin("INCREMENT", "ADDQUERY"), 1).when(F.col("_port") == "DECREMENT", -1).otherwise(0)
    key: str | list[str] = c.args[0]
    if c.has("E"):  # counts start again in every epoch
        tagged, key = filters.flush_epochs(tagged, time=c.time, seconds=duration(str(c.get("E"))), name="_epoch"), [c.args[0], "_epoch"]
    return keyed.count_query(tagged, key, delta, F.col("_port").isin("", "ADDQUERY"), c.int("m", 1), name=str(c.get("C", "CNT")), order=c.order).drop("_port", "_epoch")


# keyed analytics
def _state(c: Call, option: str) -> DataFrame | None:
    """The state table that an option names; copied if another one is to be written, maybe in its place."""
    if not c.has(option):
        return None
    stored = _spark().read.parquet(str(c.get(option)))
    return materialise(stored) if c.has("O") else stored


def _save(c: Call, option: str, state: Callable[[], DataFrame]) -> None:
    """Writes the state where an option says, when the pipeline is built; it may be where the earlier state was read."""
    if c.has(option):
        materialise(state()).write.mode("overwrite").parquet(str(c.get(option)))


@entry("firstn first firstn_shared first_shared", "J:F:O:n:N:M:E:C:")
def _firstn(c: Call) -> DataFrame:
    """-F: a table of counts (Parquet) to begin with; -O: where to write the counts."""
    n, seen = c.int("N", c.int("n", 10)), _state(c, "F")
    if c.has("E"):
        if seen is not None or c.has("O"):
            raise ValueError("counts that expire are not stored")
        return stateful.apply(c.df, c.args[0], stateful.first_n_expire(n, duration(str(c.get("E"))), c.time), c.order)
    out = keyed.first_n(c.df, c.args[0], n, c.get("C"), c.order, seen)
    _save(c, "O", lambda: keyed.counts(c.df, c.args[0], seen))
    return out


@entry("untiln until", "J:F:O:n:N:M:E:")
def _untiln(c: Call) -> DataFrame:
    """-F: a table of counts (Parquet) to begin with; -O: where to write the counts."""
    n, seen = c.int("N", c.int("n", 10)), _state(c, "F")
    if c.has("E"):
        if seen is not None or c.has("O"):
            raise ValueError("counts that expire are not stored")
        return stateful.apply(c.df, c.args[0], stateful.until_n_expire(n, duration(str(c.get("E"))), c.time), c.order)
    out = keyed.until_n(c.df, c.args[0], n, c.order, seen)
    _save(c, "O", lambda: keyed.counts(c.df, c.args[0], seen))
    return out


@entry("uniq unique uniq_shared unique_shared", "J:p:M:ok:iO:L:T:S:", refused="p")
def _uniq(c: Call) -> DataFrame:
    """-L: a table of keys (Parquet) known from the beginning; -O: where to write the keys; -T: the member that port TAG adds, -S: its text."""
    seen, keys = _state(c, "L"), list(c.args)
    rows = c.inputs.get("SET", c.any)
    _save(c, "O", lambda: (rows.select(*keys) if seen is None else rows.select(*keys).unionByName(seen.select(*keys))).dropna().distinct())
    for port in ("ISSET", "ISNOTSET", "QUERY", "INVQUERY"):
        if port in c.inputs:
            return keyed.uniq(c.inputs[port], keys, port, c.inputs.get("SET", c.inputs.get("")), seen=seen)
    if "REMOVE" in c.inputs:
        return keyed.uniq_with_removals(c.df, c.inputs["REMOVE"], keys, c.order)
    out = keyed.uniq(c.any, keys, c.port, tag=str(c.get("T", "KNOWN")), order=c.order, seen=seen)
    if c.has("S") and c.port == "TAG":
        out = out.withColumn(str(c.get("T", "KNOWN")), F.when(F.col(str(c.get("T", "KNOWN"))), F.lit(str(c.get("S")))))
    return out


entry("bloom bloomuniq", "p:L:M:R:O:F:", refused="OF")(lambda c: keyed.bloom_uniq(c.df, c.args, c.order))
entry("uniqexpire expireuniq", "J:F:O:t:L:M:", refused="FO")(lambda c: stateful.apply(c.df, c.args[0], stateful.uniq_expire(duration(str(c.get("t", "60"))), c.time), c.order))
entry("keyarrival arrival keyseq keysequence", "L:F:O:M:", refused="FO")(lambda c: keyed.arrival(c.df, c.args[0], str(c.get("L", "ARRIVAL")), c.order))
entry("keydiff keyabsolutediff diff absolutediff adiff keyabsdiff", "V:M:L:")(lambda c: keyed.diff(c.df, c.args[0], str(c.get("V")), c.order))
entry("keyEWMA keyEMA keyewma keyema exponentialmovingaverage keyexpmovavg", "V:a:M:L:Q:")(lambda c: keyed.ewma(c.df, c.args[0], str(c.get("V")), c.float("a", 0.05), c.order))
entry("keyrate", "t:m:x:M:L:V:")(lambda c: keyed.rate(c.df, c.args[0], c.time, duration(str(c.get("t", "60"))), c.get("V"), c.float("m", 10000 if c.has("V") else 3), c.float("x"), c.order))
entry("keytrans", "V:M:L:fF")(lambda c: keyed.transitions(c.df, c.args[0], c.time, c.get("V"), c.has("f") or c.has("F"), str(c.get("L", "TIMEDIFF")), c.order))
entry("keyflow", "J:t:s:L:M:F:O:", refused="FO")(lambda c: keyed.flow(c.df, c.args[0], c.time, duration(str(c.get("t", "60"))), c.int("s"), str(c.get("L", "session")), c.order))
entry("keytime keyoccur", "J:j:o:r:O:L:M:N:F:P:", refused="OLFP")(lambda c: keyed.key_time(c.df, c.args[0], c.time, c.float("r", 0), c.float("o", 3600), order=c.order))
entry("keysort sortkey groupsort sortgroup", "V:n:M:", refused="n")(lambda c: sorts.key_sort(c.df, c.args[0], str(c.get("V"))))
entry("periodic", "b:c:t:T:x:y:M:L:")(lambda c: stateful.apply(c.df, c.args[0], stateful.periodic(c.int("b", 4), c.int("c", 4), c.float("x", 0.1), c.float("t", 1000) / 1000, c.time), c.order))
entry("persist", "b:c:t:T:L:")(lambda c: keyed.persist(c.df, c.args[0], c.time, max(1, int(c.float("t", 3_600_000) / 1000)), c.int("b", 16), c.int("c", 4), c.order))
entry("onlyafter afteronly", "A:nxM:")(lambda c: keyed.only_after(c.df, c.args[0], F.array_contains(F.coalesce(F.col(shape.LABELS), F.array().cast("array<string>")), str(c.get("A"))) if shape.LABELS in c.df.columns else F.col(str(c.get("A"))).isNotNull(), c.has("n"), c.order))
entry("keyadd_initial", "V:l:L:M:")(lambda c: keyed.add_initial(c.df, c.args[0], str(c.get("V")), c.int("l", 16), c.order))
entry("countfilter freqfilter probfilter heavyfilter", "P:M:")(lambda c: stateful.apply(c.df, c.args[0], stateful.thinning(c.float("P", 2.0), 0, c.args[0], c.order), c.order))


@entry("stateclimb", "J:T:C:c:RsM:F:O:", refused="FO")
def _stateclimb(c: Call) -> DataFrame:
    """Arguments: the key, then MEMBER=weight: the weight counts when the member is present."""
    weights = dict((m, float(w)) for m, _, w in (a.partition("=") for a in c.args[1:]))
    op = stateful.clamped_climb(lambda r: sum(w for m, w in weights.items() if r.get(m) is not None), c.float("T", 10), c.float("C", 100), c.float("c", -100), c.has("R"), c.port == "TAG")
    return stateful.apply(c.any, c.args[0], op, c.order)


# sorts
entry("sort", "rM:")(lambda c: sorts.sort(c.df, c.args[0], c.has("r")))
entry("rbsort", "rM:")(lambda c: sorts.buffer_sort(c.df, c.args[0], c.has("r")))

# members from members
_column(lambda c: strings.count_chars(c.args[0], bytes.fromhex(str(c.get("X"))).decode("latin-1")), "X:L:", "charcnt")
_column(lambda c: strings.from_hex(c.args[0], str(c.get("s", "")), c.has("X")), "s:L:XA:p", "asciihex")
_column(lambda c: strings.from_base64(c.args[0], c.has("u")), "L:u", "base64 unbase64")
_column(lambda c: strings.to_base64(c.args[0]), "L:", "encodebase64")
_column(lambda c: strings.combine(list(c.args), str(c.get("S", " "))), "S:L:", "combinestrings")
_column(lambda c: F.col(c.args[0]), "L:", "dupestring")
_column(lambda c: strings.entropy(c.args[0]), "L:e", "entropy ent chisqr")
_column(lambda c: magic.file_type(c.args[0], c.has("m")), "f:mL:", "filemagic")
_column(lambda c: strings.digest(c.args[0], str(c.get("A", "md5")), c.has("B")), "A:BL:", "hmac md5 sha")
_column(lambda c: strings.sed(c.args[0], str(c.get("e"))), "e:L:", "sed")
_column(lambda c: strings.split(c.args[0], str(c.get("R", ",")), c.int("s", 0), c.int("N"), c.has("E")), "TC:R:N:s:EL:F", "splitstring")
_column(lambda c: strings.printable(c.args[0], c.int("r", 4), str(c.get("s", " "))), "r:s:L:", "strings")
_column(lambda c: strings.substring(c.args[0], c.int("o", 0), c.int("l", 1), c.has("e")), "o:l:eL:", "substring")
_column(lambda c: strings.lower_ascii(c.args[0]) if c.has("U") else strings.translate(c.args[0], bytes.fromhex(str(c.get("x"))).decode("latin-1") if c.has("x") else str(c.get("f")), c.get("t")), "Uf:x:t:L:", "tr")
_column(lambda c: strings.key_values(c.args[0], str(c.get("R", " ")), str(c.get("k", "="))), "R:k:N:XE:A:I:L:", "log_keyvalue_parse kvparse kvlog kvp syslog")


@entry("strlen", "e:g:l:L:")
def _strlen(c: Call) -> DataFrame:
    out = c.df.withColumn(str(c.get("L", "STRLEN")), strings.length(c.args[0]))
    n = F.col(str(c.get("L", "STRLEN")))
    for o, cond in (("e", lambda v: n == v), ("g", lambda v: n > v), ("l", lambda v: n < v)):
        if c.has(o):
            out = out.where(cond(c.int(o)))
    return out


@entry("editdistance levenshtein editdist", "S:K:L:B:M:")
def _edit(c: Call) -> DataFrame:
    if c.has("K"):
        if not c.df.isStreaming:
            return keyed.edit_distance(c.df, c.key, c.args[0], c.order)
        return stateful.apply(c.df, c.key, stateful.edit_distance_of_key(c.args[0]), c.order)
    return c.df.withColumn("EDITDISTANCE", strings.edit_distance(c.args[0], F.lit(str(c.get("S"))))).withColumn("EDITNORM", strings.edit_norm(c.args[0], F.lit(str(c.get("S")))))


# structured members
entry("decodejson json jsondecode", "L:s:")(lambda c: c.df.withColumn(str(c.get("L", "JSON")), structured.decode_json(c.args[0], str(c.get("s"))) if c.has("s") else structured.decode_json_free(c.args[0])))
entry("tuple2json tojson outputjson tupletojson mkjson", "12L:")(lambda c: structured.quoted_json(c.df, c.args or [x for x in c.df.columns if x != shape.LABELS], str(c.get("L", "JSON"))))
entry("parsexml xmlparse xml xml2tuple xmlparser xml_in", "N:s:L:")(lambda c: c.df.withColumn(str(c.get("L", "XML")), structured.parse_xml_record(c.args[0], str(c.get("s")))))
entry("print2json pmetajson pjson", "O:s")(lambda c: structured.one_document(c.df, c.args or c.df.columns))
def _lines(c: Call, separator: str) -> DataFrame:
    """Records as lines, and where -O, -A or -w says so, written as text when the pipeline is built."""
    members = c.args or c.df.columns
    if c.has("J"):
        out = structured.quoted_json(c.df, c.df.columns, "line").select("line")
    else:
        binary = {f.name for f in c.df.schema if f.dataType.simpleString() == "binary"}
        shown = c.df.withColumns({m: F.hex(m) if c.has("X") else F.decode(m, "ISO-8859-1") for m in members if m in binary})
        text = strings.line(members, str(c.get("s", separator)), c.has("V"))
        if c.has("L"):
            text = F.concat_ws(str(c.get("s", separator)), *[F.when(F.col(m).isNotNull(), F.lit(m)) for m in members])
        elif c.has("T") and c.has("V"):
            text = F.concat_ws("\n", *[F.concat(F.lit(f"  {m}: "), F.col(m).cast("string")) for m in members])
        out = shown.select(text.alias("line"))
    if c.has("H"):
        out = c.df.sparkSession.createDataFrame([(str(c.get("s", separator)).join(members),)], "line string").unionByName(out)
    path = c.get("O") or c.get("A") or c.get("w")
    if path and c.has("t"):
        writers.rotated(c.df, str(path), c.time, duration(str(c.get("t"))), members, c.int("m"), str(c.get("s", separator)), "append" if c.has("A") else "overwrite")
    elif path:
        w = out.write.mode("append" if c.has("A") else "overwrite")
        (w.option("maxRecordsPerFile", c.int("m")) if c.has("m") else w).text(str(path))
    return out


entry("print pmeta p", "s:SXO:w:A:LHVTJ12bE:t:v:Dm:d:f", refused="bv")(lambda c: _lines(c, ","))
entry("metadice metaout metaprint printmeta", "s:m:t:v:Vw:E:", refused="v")(lambda c: _lines(c, "|"))


@entry("calc math icalc mathwscalc", "FM:NRS:")
def _calc(c: Call) -> DataFrame:
    """-S: a script file, run before the script that is given; -N: only the last values of keyed variables."""
    from .calc import calc

    scripts = ["\n".join(r[0] for r in _spark().read.text(str(c.get("S")), wholetext=True).collect())] if c.has("S") else []
    return calc(c.df, "\n".join([*scripts, " ".join(c.args)]), c.order, c.has("N"))


# decoders and packets
_column(lambda c: decode.dns(c.args[0], c.has("T")), "L:tT", "dns")
_column(lambda c: decode.tls(c.args[0]), "L:EJ", "tls tlsrec")
entry("grouppackets", "J:fcn:N:V:M:")(lambda c: aggregates.group_packets(c.df.withColumn("_len", F.octet_length(str(c.get("V", "CONTENT")))), c.args[0], "TCPSEQ", "_len", "TCPACK", str(c.get("V", "CONTENT")), "FLAGS", c.int("n"), c.order))
entry("keyadd_initial_custom trackbkey keyadd_initial_custom_shared trackbkey_shared", "J:j:2m:b:M:F:O:L:P:")(lambda c: keyed.anomaly_benchmark(c.df, *c.args[:3], c.int("m", 24), c.int("b", 5), c.order))


@entry("redis hiredis", "V:h:p:P:S:L:x:", refused="xPS")
def _redis(c: Call) -> DataFrame:
    """The store is the input on port STORE; GET is the main port, SET, SETNX, INCR and DECR give the new store."""
    key, value, store = c.args[0], str(c.get("V", "VALUE")), c.inputs["STORE"]
    if "SET" in c.inputs or "SETNX" in c.inputs:
        return joins.put(store, c.inputs.get("SET", c.inputs.get("SETNX")), key, value, c.order, "SETNX" in c.inputs)
    if "INCR" in c.inputs or "DECR" in c.inputs:
        by = c.inputs.get("INCR", c.inputs.get("DECR")).withColumn("_by", F.lit(1 if "INCR" in c.inputs else -1).cast("long"))
        return joins.increment(store, by, key, value, "_by")
    return joins.lookup(c.inputs.get("GET", c.inputs.get("")), store, key, value, str(c.get("L", "VALUE")))


# sinks: they write when the pipeline is built and pass their input on
@entry("kafka_out", "b:t:p:K:L:o:")
def _kafka_out(c: Call) -> DataFrame:
    """Publishes the member that is named, with -K as key, to the topic -t of the brokers -b (a stream: -o names its checkpoint folder)."""
    writers.kafka(c.df, str(c.get("b")), str(c.get("t")), c.args[0], c.get("K"), checkpoint=c.get("o"))
    return c.df


@entry("writebuffer", "o:N:L:")
def _writebuffer(c: Call) -> DataFrame:
    """Every value of the member that is named as a file in the folder -o, called by -N (default: the order)."""
    writers.buffer_files(c.df, c.args[0], str(c.get("N", c.order)), str(c.get("o")))
    return c.df


@entry("tcpthrow", "h:p:")
def _tcpthrow(c: Call) -> DataFrame:
    """Every value of the member that is named as a frame to a server."""
    writers.frames(c.df, c.args[0], str(c.get("h", "127.0.0.1")), c.int("p"))
    return c.df


@entry("wsproto_out", "o:w:")
def _wsproto_out(c: Call) -> DataFrame:
    """The records as container files in the folder -w."""
    writers.buffer_files(records.containers(c.df, shape.LABELS if shape.LABELS in c.df.columns else None), "DATA", "FILE", str(c.get("w", c.get("o"))), ".pb2")
    return c.df


# sources: operators without an input
SOURCES: dict[str, Entry] = {}


def source(names: str, options: str = "", refused: str = ""):
    def put(run: Callable[[Call], DataFrame]):
        name, *aliases = names.split()
        for n in (name, *aliases):
            SOURCES[n] = Entry(name, options, run, tuple(aliases), refused)
        return run

    return put


def _spark() -> SparkSession:
    return SparkSession.getActiveSession()


@source("csv_in", "d:F:r:iIlP:ps:t:NX", refused="ip")
def _csv_in(c: Call) -> DataFrame:
    """-r: a file; -F: a file of paths; -P: a folder that is followed as a stream (-t, the interval, is the trigger's); -l: the first field is the container's label; -I: fields are ``[LABEL]value``; -N: values stay text."""
    paths = patterns.lines(_spark(), str(c.get("F"))) if c.has("F") else [str(c.get("P") if c.has("P") else c.get("r"))]
    marks = (str(c.get("d", "")) + str(c.get("s", ""))).replace("\\t", "\t") or ("\t" if c.has("I") else ",")
    return readers.csv_lines(_spark(), paths, c.args, marks, not c.has("N"), stream=c.has("P"), container_label=c.has("l"), inline=c.has("I"))


source("file_in", "F:mL:")(lambda c: readers.files(_spark(), str(c.get("F")), c.has("m")))
source("exec_in", "R:ISL:", refused="I")(lambda c: readers.process(_spark(), c.args, str(c.get("R", "\n")), str(c.get("L", "BUFFER"))))
source("time_in", "o:s:e:")(lambda c: readers.clock(_spark(), str(c.get("s")), str(c.get("e")), duration(c.args[0]) if c.args else 60, c.int("o", 0)) if c.has("s") else readers.ticks(_spark(), duration(c.args[0]) if c.args else 60))
source("source_keygen", "a:flm:c:s:u:")(lambda c: readers.key_generator(_spark(), c.int("c", 1000), int(str(c.get("m", (1 << 63) - 1)), 0), c.int("s", 0), c.int("a", 0)))
source("pcapin pcap pcap_in", "i:r:g", refused="i")(lambda c: decode.pcap(readers.files(_spark(), str(c.get("r"))), group_ports=c.has("g")))
source("kafka_in kafka_multi_in", "b:p:L:g:SX:V")(lambda c: readers.kafka(_spark(), str(c.get("b")), ",".join(c.args)))
source("pb2in pb2_filein wsproto_in", "ims:Br:", refused="ims")(lambda c: records.read(readers.files(_spark(), str(c.get("r")))))


@source("syslog_udp_in syslogudp syslog_udp udp_syslog udpsyslog udpgen_in udpgen_in_buf", "U:Bbn:")
def _udp(c: Call) -> DataFrame:
    datagrams.register(_spark())
    return _spark().readStream.format("udp").option("port", str(c.get("U"))).load()


@source("tcpcatch", "s:h:p:wbP:B:I:", refused="wbB")
def _tcpcatch(c: Call) -> DataFrame:
    """Length-prefixed frames of a TCP peer."""
    datagrams.register(_spark())
    return _spark().readStream.format("frames").option("host", str(c.get("h", "127.0.0.1"))).option("port", str(c.get("p", c.get("P")))).load()


@source("syslog_tcp_in syslog_tcp syslogtcp tcp_in tls_in syslog_tls", "s:h:p:wbP:B:I:")
def _tcp(c: Call) -> DataFrame:
    return readers.socket_lines(_spark(), str(c.get("h", "127.0.0.1")), int(str(c.get("p", c.get("P")))))


def describe(word: str = "") -> list[str]:
    """A line for each operator: its names and options (those with a value have a colon), sources apart; matching a word."""
    out = []
    for kind, table in (("source", SOURCES), ("operator", ENTRIES)):
        for e in dict.fromkeys(map(id, table.values())):
            entry_ = next(x for x in table.values() if id(x) == e)
            options = " ".join(f"-{c}" + (" value" if entry_.takes_value(c) else "") for c in entry_.options if c != ":")
            doc = (entry_.run.__doc__ or "").strip()
            line = f"{kind} {entry_.name}" + (f" ({', '.join(entry_.aliases)})" if entry_.aliases else "") + (f": {options}" if options else "") + (f" - {doc}" if doc else "")
            if word.lower() in line.lower():
                out.append(line)
    return out
