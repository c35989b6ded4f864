"""Connected components of an edge table by contraction, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelog.llm.store import discard, spread_join, written


#: Links (16 bytes each) that are left when one task finishes.
LAST_LINKS = 500_000


class Forest:
    """Disjoint sets of labels."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = self.top
        while top.setdefault(x, x) != x:
            top[x] = x = top.setdefault(top[x], top[x])
        return x

    def join(self, x: int, y: int) -> bool:
        """False if they were joined before."""
        x, y = self.find(x), self.find(y)
        self.top[max(x, y)] = min(x, y)
        return x != y


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last links, at most LAST_LINKS in one task, to (node, to)."""
    known = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            known.join(a, b)
    nodes = list(known.top)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([known.find(x) for x in nodes], pa.int64())], names=["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b); nodes that reach each other share a label, which is one of them.

    Each round every node moves to the neighbour of least hashed id (and to that
    one's own choice), and edges are rewritten to where their ends moved.
    Hashing makes chains of choices short whatever the ids, so rounds grow with
    the logarithm of the nodes. When a count shows that few links are left, one
    task joins them.
    """
    links = written(edges.select("a", "b").where("a <> b").distinct())
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    held: list[DataFrame] = []
    while left := links.count():
        if left <= LAST_LINKS:
            move = written(links.coalesce(1).mapInArrow(_tops, "node long, to long"))
            labels = written(_moved(labels, move, move.count()))
            discard(links, move, *held)
            break
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        ends = links.select(F.col("a").alias("node"), rank("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), rank("a").alias("to")))
        near = written(ends.groupBy("node").agg(F.least(F.min("to"), rank("node")).alias("to")).select("node", F.col("to.id").alias("to")))
        n = near.count()
        far = near.select(F.col("node").alias("to"), F.col("to").alias("top"))
        move = written(spread_join(near, far, "to", n=n).select("node", F.col("top").alias("to")))
        at_a, at_b = move.select(F.col("node").alias("a"), F.col("to").alias("x")), move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        after = written(spread_join(spread_join(links, at_a, "a", n=n), at_b, "b", n=n).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = written(_moved(labels, move, n))
        discard(links, near, move, *held)
        links, held = after, [labels]
    return labels


def _moved(labels: DataFrame, move: DataFrame, n: int) -> DataFrame:
    return spread_join(labels, move.select(F.col("node").alias("label"), "to"), "label", "left", n).select("node", F.coalesce("to", "label").alias("label"))
