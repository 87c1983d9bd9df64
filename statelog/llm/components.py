"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.common import stored


def _largest(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller neighbours and to itself."""
    down = edges.where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).where("a != b")


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one, and that one has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node it reaches.

    ``links`` has two long columns ``a`` and ``b`` in any order. A node with a link to a third of
    all nodes is no single group: minima combine before the shuffle and joins may split. Every
    round is written, so none is computed twice.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b").distinct(), "component-links")
    while not _settled(edges):
        edges = stored(_smallest(_largest(edges)).distinct(), "component-round")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
