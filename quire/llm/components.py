"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut

DEAL = 16


def dealt(edges: DataFrame, nodes: DataFrame, side: str, how: str) -> DataFrame:
    """edges (a, b) with the m of nodes (node, m) for their end `side`. The edges of one node are dealt over DEAL
    tasks by their other end, and nodes, which must be few beside the edges, go to all of these."""
    part = F.pmod(F.xxhash64("a" if side == "b" else "b"), F.lit(DEAL)).alias("part")
    copies = nodes.select(F.col("node").alias(side), "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))).alias("part"))
    return edges.select("a", "b", part).join(copies, [side, "part"], how)


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour; a > b in each edge.

    A node without smaller neighbours leaves its edges as they are, and that holds for most hubs:
    only nodes that have both smaller and larger neighbours are joined.
    """
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    between = least.join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    return dealt(edges, between, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them; a > b in each edge."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.max("b").alias("most"))
    moved = dealt(edges, least.where("m <> most").select("node", "m"), "a", "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of the edges (columns a, b: longs) that isn't the least of its component.

    Each round is checkpointed; rounds go on until the edges no longer change. Least neighbours are
    aggregated before the shuffle, and a hub's edges are never in one task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, mark = None, print_of(now)
    while mark != was:
        now = cut(small_star(large_star(now)))
        was, mark = mark, print_of(now)
    return now.select("a", F.col("b").alias("root"))
