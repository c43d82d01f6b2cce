"""Connected components by alternating large and small stars.

Links of a node to itself are dropped, repeated links count once; no links make no rows.  Ids must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import remove, written


def _least(edges: DataFrame, least) -> DataFrame:
    """(a, m) of each node, written: a join with a table, unlike one with an aggregate, can split a hub's rows over tasks."""
    return written(edges.groupBy("a").agg(least.alias("m")), "least").hint("merge")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = _least(both, F.least(F.min("b"), F.first("a")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, F.min("b"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the least node of the component.

    ``edges`` has two columns a and b of one orderable type.  Each round halves the
    depth of the trees or better; every round is written to the shared folder (the one
    before is removed), and the driver sees two numbers a round."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        large = written(_large_star(edges), "edges")
        small = written(_small_star(large), "edges")
        remove(edges, large)
        edges = small
