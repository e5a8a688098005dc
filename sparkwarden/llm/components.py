"""Connected components by alternating stars, each round a grouped minimum and a join, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import staged

c = F.col


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.unionByName(edges.select(c("b").alias("a"), c("a").alias("b")))
    # Written first, so that the join reads plain shuffles and a hot node's rows can be split.
    least = staged(both.groupBy("a").agg(F.least(c("a"), F.min("b")).alias("least")), "least")
    return both.where("b > a").join(least, "a").select(c("b").alias("a"), c("least").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = down.join(least, "a").select(c("b").alias("a"), c("least").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", c("least").alias("b"))).distinct()


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable. Loops are ignored."""
    now = staged(edges.where("a <> b").distinct(), "edges")
    before = mark(now)
    while before[0]:
        now = staged(small_star(large_star(now)), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(c("a").alias("node"), c("b").alias("root"))
    return roots.unionByName(roots.select(c("root").alias("node"), "root").distinct())
