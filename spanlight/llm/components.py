"""Connected components of an edge list, by alternating stars over checkpointed tables.

Edges are pairs of numbers, in any order and any number of times; loops are left out, and nodes
without an edge to another get no row. Edges with a null on either side join nothing and are
left out. An empty list gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, staged: Staged, name: str) -> DataFrame:
    """One round: every node hands its smallest neighbour to its larger ones, then to its smaller ones.

    The smallest neighbour is a partial aggregate and a table of its own; so it comes back by a
    join of plain exchanges, which Spark may split, and a node with very many neighbours fills
    no task.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = staged.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}low", tidy=False)
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    large = staged.put(large, f"{name}large", tidy=False)
    low = staged.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}least", tidy=False)
    small = large.join(low, "u")
    down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return down.filter("u != v").distinct()


def components(edges: DataFrame, staged: Staged, most_rounds: int = 60, name: str = "edges") -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component."""
    edges = staged.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), f"{name}0")
    size = _size(edges)
    for k in range(1, most_rounds + 1):
        following = staged.put(_stars(edges, staged, f"{name}{k}"), f"{name}{k}")
        now = _size(following)
        for part in ("low", "large", "least"):
            staged.drop(f"{name}{k}{part}")
        staged.drop(f"{name}{k - 1}")
        edges = following
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
