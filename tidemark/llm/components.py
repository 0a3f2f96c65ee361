"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed, joined_on_hot
from .worker import begin

#: Edges that a task contracts, about.
TASK_EDGES = 1 << 18


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars around the least node that they reach there: the same components with fewer edges and shorter ways, without a shuffle."""
    kind = edges.schema["a"].dataType.simpleString()

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("components")
        parent: dict = {}

        def root(node):
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        if schema is not None:
            ends = [(root(node), node) for node in parent if parent[node] != node]
            a, b = zip(*ends, strict=True) if ends else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, schema.field(0).type), pa.array(b, schema.field(1).type)], names=["a", "b"])

    return edges.mapInArrow(stars, f"a {kind}, b {kind}")


def _stars(edges: DataFrame, count: int) -> bool:
    """Whether every component is a star around its least node: no node hangs on two, and none that others hang on hangs itself."""
    hung = edges.select(F.col("b").alias("a")).distinct()
    return hung.count() == count and edges.select("a").distinct().join(hung, "a", "left_semi").isEmpty()


def _hang(edges: DataFrame, count: int, upward: bool) -> DataFrame:
    """One step of alternating stars: each node's neighbours on one side, and itself, are hung on its least neighbour."""
    # (node, other): upward, the others above a node move; else the node itself and those below do
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))) if upward else edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    least = both.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("_n")).withColumn("least", F.least("node", "least"))
    joined = joined_on_hot(both, least, "node", "_n", 2 * count)
    moved = joined.filter("other > node") if upward else joined
    hung = moved.select(F.col("least").alias("a"), F.col("other").alias("b"))
    if not upward:
        hung = hung.union(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return hung.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b); the root is the component's least node.  Edges with a null end are ignored.

    Each partition's edges are contracted, then stars above and below each node are
    drawn together, in turn until every component is a star.  Only counts of the edges
    reach the driver.  A node of very many edges isn't gathered in one task.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = checkpointed(_contracted(pairs).distinct())
    count = now.count()
    while count:
        tasks = -(-count // TASK_EDGES)
        now = now.coalesce(tasks)  # few edges make few tasks, which have more to contract
        if tasks == 1:
            now = checkpointed(_contracted(now))
            break
        if _stars(now, count):
            break
        now = checkpointed(_contracted(_hang(_hang(_contracted(now), count, True).coalesce(tasks), count, False).coalesce(tasks)).distinct())
        count = now.count()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
