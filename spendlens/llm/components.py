"""Connected components of a graph given as edges, in shuffles of edges only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm import common

FOREST_EDGES = 1_000_000
EDGES = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, reduced to one edge from each node to the least node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def out() -> pa.RecordBatch:
        found = [(x, root(x)) for x in parent]
        found = [(x, r) for x, r in found if x != r]
        parent.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()),
                                           "b": pa.array([r for _, r in found], pa.int64())})

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= FOREST_EDGES:
            yield out()
    yield out()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reached.

    ``edges`` has longs ``a`` and ``b``, in any direction, repeats and self-loops allowed.
    Rounds of large-star and small-star steps; each round's edges are cut into
    the shared folder.  A node with very many neighbours only sends and gets
    pre-aggregated minima and joins, which Spark can split.
    """
    edges = common.cut(edges.select("a", "b").where("a != b").mapInArrow(_forest, EDGES).distinct())
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())  # every edge now points to a smaller node
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = (large.join(down, F.col("a") == F.col("of")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(down.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct())
        edges = common.cut(small)
        now = _state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
