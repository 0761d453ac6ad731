"""Connected components of a graph in a table, by rounds of contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): each id that has an edge with the least id that it reaches.

    Each round points every vertex at its least neighbour or itself, follows the pointer once more, and
    replaces the vertices of all edges by what they point at. The edges and vertices left shrink from round to
    round and are written as tables; the pointers of all rounds, joined one after another, give the result.
    Aggregates are minima, so a vertex with very many edges meets them in partial sums; joins on it are ones
    that Spark can split.
    """
    steps = []
    edges = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("to")))
        far = near.select(F.col("id").alias("to"), F.col("to").alias("next"))
        to = stored(near.join(far, "to").select("id", F.col("next").alias("to")))
        steps.append(to)
        a, b = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = stored(edges.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = steps[0].select("id", F.col("to").alias("component"))
    for to in steps[1:]:
        out = out.join(to.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return out


class Forest:
    """Union of few vertices inside one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)
