"""Sources: delimited text, files, processes, clocks, generators and message brokers."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import typed
from ..operators.shape import LABELS


def csv_lines(
    spark: SparkSession, path: str | Sequence[str], labels: Sequence[str], delimiters: str = ",", detect: bool = True, stream: bool = False, quote: bool = False,
    container_label: bool = False, inline: bool = False,
) -> DataFrame:
    """Delimited lines with positional labels; empty and missing fields are NULL.

    With ``detect`` every field is a struct of the kinds (see ``functions.types.typed``), otherwise text. With quotes the
    built-in reader parses the lines. ``stream`` follows a folder for new files. With ``container_label`` the first field is
    the container's label. With ``inline`` the fields are ``[LABEL]value``, a first one without a label is the container's; the
    labels asked for become members, all are in the map ``fields`` if none is.
    """
    reader = spark.readStream if stream else spark.read
    paths = [path] if isinstance(path, str) else list(path)
    if stream and len(paths) > 1:
        raise ValueError("a stream follows one folder")
    source = paths[0] if len(paths) == 1 else paths
    labelled = [LABELS] if container_label or inline else []
    if inline:
        parts = F.split("value", "[" + "".join("\\" + d for d in delimiters) + "]")
        of = F.filter(F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("k"), F.regexp_replace(x, r"^\[[^\]]*\]", "").alias("v"))), lambda x: x["k"] != "")
        first = F.get(parts, F.lit(0))
        rows = reader.text(source).select(F.when(~first.startswith("["), F.array(first)).alias(LABELS), F.map_from_entries(F.array_distinct(of)).alias("fields"))
        if not labels:
            return rows
        rows = rows.select(LABELS, *[F.nullif(F.col("fields")[x], F.lit("")).alias(x) for x in labels])
    elif quote:
        rows = reader.schema(", ".join(f"`{x}` string" for x in labels)).option("sep", delimiters[0]).csv(source)
    else:
        parts = F.split("value", "[" + "".join("\\" + d for d in delimiters) + "]")
        held = [F.array(F.get(parts, F.lit(0))).alias(LABELS)] if container_label else []
        rows = reader.text(source).select(*held, *[F.nullif(F.get(parts, F.lit(i + len(held))), F.lit("")).alias(x) for i, x in enumerate(labels)])
    return rows.select(*labelled, *[typed(F.col(x)).alias(x) for x in labels]) if detect else rows


def csv_table(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = False, stream: bool = False) -> DataFrame:
    """Delimited text with a declared schema."""
    r = (spark.readStream if stream else spark.read).schema(schema).option("sep", delimiter).option("header", header).option("nullValue", "")
    return r.csv(path)


def inline_labelled(lines: DataFrame, line: str = "value", delimiter: str = ",", equals: str = "=") -> DataFrame:
    """Lines of ``label=value`` fields as a map member."""
    return lines.select("*", F.expr(f"str_to_map({line}, '{delimiter}', '{equals}')").alias("fields"))


def files(spark: SparkSession, path: str, metadata: bool = True, pattern: str | None = None, stream: bool = False) -> DataFrame:
    """One row a file: DATA, and FILENAME, LENGTH, LAST_MODIFICATION."""
    r = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    cols = [F.col("content").alias("DATA")]
    if metadata:
        cols += [F.col("path").alias("FILENAME"), F.col("length").alias("LENGTH"), F.col("modificationTime").alias("LAST_MODIFICATION")]
    return r.load(path).select(*cols)


def process(spark: SparkSession, command: Sequence[str], separator: str = "\n", name: str = "BUFFER", most_bytes: int = 64 << 20) -> DataFrame:
    """The output of a program run on the driver, split into rows; for outputs of at most ``most_bytes``."""
    with subprocess.Popen(list(command), stdout=subprocess.PIPE) as p:
        out = p.stdout.read(most_bytes + 1)
        if len(out) > most_bytes:
            p.kill()
            raise ValueError(f"the program wrote more than {most_bytes} bytes; let tasks read a file instead")
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, list(command))
    parts = out.decode(errors="replace").split(separator)
    if parts and parts[-1] == "":
        parts.pop()
    return spark.createDataFrame([(p,) for p in parts], f"{name} string")


def through_process(df: DataFrame, member: str, command: Sequence[str], name: str = "BUFFER") -> DataFrame:
    """Every partition's values as lines through a program; its output lines as rows."""
    from collections.abc import Iterator

    import pyarrow as pa

    argv = list(command)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import threading

        failed: list[BaseException] = []

        def feed(p: subprocess.Popen) -> None:
            try:
                for b in batches:
                    p.stdin.writelines(f"{v}\n".encode() for v in b.column(0).to_pylist() if v is not None)
            except BrokenPipeError:  # the program has read enough
                pass
            except BaseException as e:  # told to the reader below
                failed.append(e)
            finally:
                try:
                    p.stdin.close()
                except BrokenPipeError:
                    pass

        # one program a partition: what it reads and writes passes through, neither is held
        with subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            feeder = threading.Thread(target=feed, args=(p,), daemon=True)
            feeder.start()
            held: list[str] = []
            for line in p.stdout:
                held.append(line.decode(errors="replace").rstrip("\n"))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=[name])
                    held = []
            feeder.join()
            if failed:
                raise failed[0]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=[name])
        if p.returncode:
            raise subprocess.CalledProcessError(p.returncode, argv)

    return df.select(F.col(member).cast("string")).mapInArrow(run, f"{name} string")


def clock(spark: SparkSession, start: str, end: str, seconds: int = 60, offset: int = 0, name: str = "DATETIME") -> DataFrame:
    """The aligned ticks of a clock between two times, made by tasks (no list on the driver)."""
    first = F.ceil((F.unix_seconds(F.lit(start).cast("timestamp")) - offset) / seconds)
    last = F.floor((F.unix_seconds(F.lit(end).cast("timestamp")) - offset) / seconds)
    ends = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    return spark.range(ends["a"], ends["b"] + 1).select(F.timestamp_seconds(F.col("id") * seconds + offset).alias(name))


def ticks(spark: SparkSession, seconds: int = 60, name: str = "DATETIME") -> DataFrame:
    """The clock as a stream: a row whenever an aligned boundary has passed."""
    r = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return r.where(F.unix_seconds("timestamp") % seconds == 0).select(F.timestamp_seconds(F.unix_seconds("timestamp")).alias(name))


def key_generator(spark: SparkSession, count: int, mask: int = (1 << 63) - 1, seed: int = 0, ascension: int = 0, name: str = "KEY") -> DataFrame:
    """Pseudo-random keys, the same for a seed: a hash of the number, masked; ``ascension`` adds a base that grows by row."""
    key = F.xxhash64(F.col("id"), F.lit(seed)).bitwiseAND(F.lit(mask))
    return spark.range(count).select("id", (key + F.col("id") * ascension if ascension else key).alias(name))


def biased_keys(spark: SparkSession, count: int, keys: int, anomalous: float = 0.1, seed: int = 0) -> DataFrame:
    """KEY, VALUE, BIAS rows of the anomaly benchmark: values of biased keys are mostly 0, those of others mostly 1."""
    # 32 bits of a digest, the same in any engine
    drawn = lambda c, n: F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{n}"))), 1, 8), 16, 10).cast("long")
    key = drawn(F.col("id"), seed) % keys
    biased = drawn(key, seed + 1) % 1000 < int(1000 * anomalous)
    coin = drawn(F.col("id"), seed + 2) % 100
    return spark.range(count).select("id", key.alias("KEY"), F.when(biased, (coin < 10).cast("int")).otherwise((coin < 50).cast("int")).alias("VALUE"), biased.cast("int").alias("BIAS"))


def kafka(spark: SparkSession, brokers: str, topics: str, options: dict[str, str] | None = None, stream: bool = True) -> DataFrame:
    """BUF, KAFKA (key), TOPIC, PARTITION, OFFSET, DATETIME. Needs Spark's Kafka package; ``topics`` may hold ``topic:partition``."""
    r = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", brokers)
    parts = [t.partition(":") for t in topics.split(",")]
    if any(p for _, _, p in parts):
        by: dict[str, list[int]] = {}
        for t, _, p in parts:
            by.setdefault(t, []).append(int(p or 0))
        import json

        r = r.option("assign", json.dumps(by))
    else:
        r = r.option("subscribe", topics)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load().select(F.col("value").alias("BUF"), F.col("key").alias("KAFKA"), F.col("topic").alias("TOPIC"), F.col("partition").alias("PARTITION"), F.col("offset").alias("OFFSET"), F.col("timestamp").alias("DATETIME"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP server as a stream, with the time of arrival (no replay after a failure)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load().select(F.col("timestamp").alias("DATETIME"), F.col("value").alias("MESSAGE"))


def syslog_fields(df: DataFrame, member: str = "MESSAGE") -> DataFrame:
    """FACILITY, SEVERITY, HOST, TAG, TEXT of a syslog line of the classic or the newer layout."""
    pri = F.regexp_extract(member, r"^<(\d{1,3})>", 1).try_cast("int")
    new = r"^<\d{1,3}>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|\[.*?\]) ?(.*)$"
    old = r"^<\d{1,3}>(\w{3} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[]+)(?:\[\d+\])?: ?(.*)$"
    is_new = F.col(member).rlike(new)
    pick = lambda a, b: F.nullif(F.when(is_new, F.regexp_extract(member, new, a)).otherwise(F.regexp_extract(member, old, b)), F.lit(""))
    return df.select("*", F.floor(pri / 8).cast("int").alias("FACILITY"), (pri % 8).alias("SEVERITY"), pick(2, 2).alias("HOST"), pick(3, 3).alias("TAG"), pick(6, 4).alias("TEXT"))
