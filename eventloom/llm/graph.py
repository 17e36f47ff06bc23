"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, ship

#: So many links fit into one task with ease.
FEW = 200_000


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links: a, b (long) -> node, label: the smallest node of each node's component, for the nodes of links.

    Contraction: every node with a smaller neighbour goes to the smallest one, chains of these are followed to their ends,
    and the links between different ends are the next round's. Each round at least halves the nodes that it can join, so
    the rounds together handle little more than the links once. The end with many links comes first in the joins (after
    equal links have met), so a hub does not gather its links in one task. When at most ``few`` links are left, one task
    finishes. Each round is written to the shared folder.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(ordered(links))
    rounds: list[DataFrame] = []
    while edges.count() > few:
        moves = _ends(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
        rounds.append(moves)
        # b has moved in any case; what its neighbours and it share now is one link
        half = edges.hint("merge").join(moves, edges["b"] == moves["node"]).select("a", F.col("label").alias("b")).where("a <> b").distinct()
        both = half.hint("merge").join(moves, half["a"] == moves["node"], "left").select(F.coalesce("label", "a").alias("a"), "b")
        after = materialise(ordered(both))
        discard(edges)
        edges = after
    out = _finished(edges)
    while rounds:
        # the ends of a round are the nodes of the next ones
        out = rounds.pop().transform(moved, out).unionByName(out)
    return materialise(out.unionByName(out.select(F.col("label").alias("node"), "label").distinct()))


def moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """``labels`` (node, label) with each label replaced by where ``moves`` (node, label) takes it, if anywhere."""
    to = moves.select(F.col("node").alias("label"), F.col("label").alias("end"))
    return labels.hint("merge").join(to, "label", "left").select("node", F.coalesce("end", "label").alias("label"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``links`` (a, b) between labels; a node without a label yet is its own."""
    moves = components(links)
    alone = moves.hint("merge").join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti")
    return materialise(moved(labels, moves).unionByName(alone))


def _ends(moves: DataFrame) -> DataFrame:
    """``moves`` (node, label below it) with chains followed to their ends, by doubling: as many steps as the logarithm of their length."""
    while True:
        moves = materialise(moves)
        # only labels that move on themselves are looked up
        further = materialise(moves.hint("merge").join(moves.select(F.col("label").alias("node")).distinct(), "node", "left_semi"))
        if further.isEmpty():
            return moves
        moves = moved(moves, further)


def _finished(edges: DataFrame) -> DataFrame:
    """node, label of all nodes of at most FEW links but the smallest of each component."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: dict[int, int] = {}

        def end(x: int) -> int:
            last = x
            while (up := to.get(last, last)) != last:
                last = up
            while x != last:
                to[x], x = last, to.get(x, x)
            return last

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = end(a), end(b)
                if x != y:
                    to[max(x, y)] = min(x, y)
        nodes = list(to)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([end(x) for x in nodes], pa.int64())], names=["node", "label"])

    return edges.coalesce(1).mapInArrow(run, "node long, label long")
