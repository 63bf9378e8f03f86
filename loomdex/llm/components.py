"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined map-side) and a join whose skewed keys
Spark may split, written to the shared folder; no component is ever gathered.
Published as "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import staged, unstage


class Forest:
    """Union-find over hashable nodes; a root is the least node of its tree."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.parent[y] = x
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def contracted(limit: int):
    """Edges of a task as stars of a spanning forest, emptied at ``limit`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def stars() -> pa.RecordBatch:
            nodes = list(forest.parent)  # a node with a loop only is its own root
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, kind), pa.array([forest.root(x) for x in nodes], kind)], ["u", "v"]
            )

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not forest.join(x, y) and x == y:
                    forest.parent.setdefault(x, x)
            if len(forest.parent) > limit:
                yield stars()
                forest = Forest()
        if forest.parent:
            yield stars()

    return run


def connected_components(edges: DataFrame, limit: int = 300_000) -> DataFrame:
    """(node, component) of every node of the edges (first two columns), where
    ``component`` is the least node reachable. Edges with a null end are ignored;
    loops and repeated edges change nothing."""
    u, v = edges.columns[:2]
    kind = edges.schema[u].dataType.simpleString()
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna()
    # Loops pass through the forest too, so the input is computed once.
    edges = staged(edges.mapInArrow(contracted(limit), f"u {kind}, v {kind}").distinct(), "edges")
    loops = staged(edges.filter("u = v").select("u").distinct(), "loops")
    first, edges = edges, edges.filter("u <> v")
    seen = None
    while True:
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.min("v").alias("least"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = staged(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")
        unstage(first, large)
        first = edges
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    alone = loops.withColumnRenamed("u", "node").join(stars, "node", "left_anti")
    return stars.union(alone.select("node", F.col("node").alias("component")))
