"""Groups of rows that links connect, directly or by way of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.llm.storage import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least neighbour of that node."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.join(least, "a").filter("b > a").selectExpr("b as a", "m as b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the least of them."""
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").selectExpr("b as a", "m as b")
    return moved.unionByName(least.selectExpr("a", "m as b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the links (a, b), b < a, are stars: each a has one link, and none leads to another a."""
    ends = edges.selectExpr("a as node", "1 as down", "0 as up").unionByName(
        edges.selectExpr("b as node", "0 as down", "1 as up")
    )
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down > 1 or down = 1 and up = 1").count() == 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its group.

    Alternating large and small stars: the links are rewritten until each node points to its root, in a number of
    rounds that grows with the logarithm of the longest chain. The links are written to the shared folder after either
    step, so that the driver holds plans of one step; only a count of the nodes that don't point to a root comes to it.
    """
    stars = written(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").filter("a <> b").distinct(), "links")
    while not _settled(stars):
        stars = written(_small_star(written(_large_star(stars), "links")), "links")
    roots = stars.select("b").distinct().selectExpr("b as node", "b as root")
    return stars.selectExpr("a as node", "b as root").unionByName(roots)
