"""Connected components of a graph whose edges are a DataFrame.

Every task first shrinks its own edges to a forest. Then large-star and small-star
steps alternate until each component is a star around its smallest node; every
step is an aggregate and a join, written to the shared folder, so nothing depends
on one machine and no component meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import attach
from tallyscope.llm.common import lean, ready
from tallyscope.session import settle


class Forest:
    """Union-find over hashable nodes; the root is the smallest node of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a > b:
            a, b = b, a
        if a != b:
            self.parent[b] = a
        return a

    def edges(self) -> tuple[list[int], list[int]]:
        """(node, root) of every node that is not a root."""
        nodes = list(self.parent)
        return nodes, [self.find(x) for x in nodes]


def edge_batch(nodes: list[int], roots: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def contract_locally(edges: DataFrame, rows: int = 500_000) -> DataFrame:
    """A spanning forest of every ``rows`` edges of a task, as edges (a, b) with b < a."""

    @lean
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, seen = Forest(), 0
        for batch in batches:
            pairs = np.unique(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]), axis=1)
            for a, b in pairs.T.tolist():
                if a != b:
                    forest.union(a, b)
            seen += batch.num_rows
            if seen >= rows:
                yield edge_batch(*forest.edges())
                forest, seen = Forest(), 0
        yield edge_batch(*forest.edges())

    return edges.select("a", "b").mapInArrow(shrink, "a bigint, b bigint")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node without any."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("all"))
    return nodes.where("ups > 1 OR (ups = 1 AND all > 1)").isEmpty()


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another one.

    ``edges`` has two long columns a and b, in any direction, with repetitions and
    loops; rows with a NULL count for nothing. The component is its smallest node.
    Without edges the result is empty.
    """
    ready(edges.sparkSession)
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = settle(contract_locally(edges))
    for _ in range(max_rounds):
        if _only_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        now = settle(_small_star(settle(_large_star(now))))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = attach(both.where("b > a"), least, "a")
    out = larger.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = attach(down, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
