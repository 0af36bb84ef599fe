"""Connected components of link tables, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links that one task takes.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, label): each node that has a link, and the least node that it is connected with.

    Large-star and small-star steps in turn, each a minimum by node and a join, until only stars are left; the number of
    rounds grows with the logarithm of the longest chain. Loops and repeated links are harmless; null ends are ignored.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # a round never adds links, so that their number tells how many tasks are of use
    tasks = max(1, -(-edges.count() // TASK_LINKS))
    edges = edges.coalesce(tasks)
    while not _is_forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).coalesce(tasks)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _is_forest(edges: DataFrame) -> bool:
    """Whether each node has one lesser neighbour, and that has none: then the lesser end is the component's least."""
    torn = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("__b")).distinct(), F.col("a") == F.col("__b"), "left_semi").select("a")
    return torn.isEmpty() and chained.isEmpty()
