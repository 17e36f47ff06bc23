"""Command line: runs pipelines over tables and describes operators.

    python -m eventloom run 'events | keycount event_type -P' --table events=/data/events.parquet
    python -m eventloom run -f pipeline.txt --table e=/data/e.parquet --stream s --out /data/result
    python -m eventloom describe [operator or word]
"""

from __future__ import annotations

import argparse

from .plans import graph, registry
from .session import get_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="eventloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline")
    run.add_argument("pipeline", nargs="?", help="its text")
    run.add_argument("-f", "--file", help="a file with its text")
    run.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table as a source")
    run.add_argument("--stream", help="the named stream to give (default: the last pipeline's result)")
    run.add_argument("--order", default="event_id", help="the column of the arrival order")
    run.add_argument("--time", default="ts", help="the column of the event time")
    run.add_argument("--out", help="write the result there as Parquet instead of showing it")
    run.add_argument("--rows", type=int, default=20, help="how many rows to show")
    run.add_argument("--explain", action="store_true", help="show the plan only")
    describe = sub.add_parser("describe", help="list operators, or those that match a word")
    describe.add_argument("word", nargs="?", default="")
    a = p.parse_args(argv)
    if a.command == "describe":
        found = registry.describe(a.word)
        print("\n".join(found) or "none")
        return int(not found)
    text = open(a.file).read() if a.file else a.pipeline
    if not text:
        p.error("a pipeline or a file is needed")
    spark = get_session()
    tables = {n: spark.read.parquet(path) for n, _, path in (t.partition("=") for t in a.table)}
    df = graph.run(text, tables, a.stream, order=a.order, time=a.time)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
