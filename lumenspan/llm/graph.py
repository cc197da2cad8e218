"""Connected components of an edge table, without ever holding it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each round points the neighbours of
    a node at the smallest of them, until every edge leads from a component's smallest
    node. A node's neighbours are only ever aggregated to their minimum and joined
    back, never gathered, so a component of any size is dealt over many tasks. Every
    round is a table in the shared folder. Null ends and loops are ignored.
    """
    stars = materialise(_normal(edges), "edges")
    for _ in range(max_rounds):
        large = _star(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        small = _star(large, False)
        following = materialise(_normal(small), "edges")
        # the same edges again: each node then hangs from its component's smallest
        if following.exceptAll(stars).isEmpty() and stars.exceptAll(following).isEmpty():
            break
        stars = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _normal(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    pairs = edges.where(F.col("a") != F.col("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """For each node a with neighbours b: edges from them to the smallest of a and its neighbours.

    The large star moves the neighbours greater than a, the small star all smaller ones and a.
    """
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))
