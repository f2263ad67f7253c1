"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the component is its smallest node.

    Null ends and links of a node with itself are left out; no link gives no row. Each step writes a checkpoint in
    the cluster's shared folder, so that neither lineage nor lost executors matter; a node with many links is
    summed up before the shuffle. The number of steps grows with the logarithm of the number of nodes.
    """
    links = links.select("a", "b").where("a <> b")
    while True:
        links = _small_star(_large_star(links)).checkpoint()
        # done where each node has one link, and none that has a link is another one's end
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("n")), F.struct(F.col("b").alias("x"), F.lit(0).alias("n")))).alias("e")).select("e.*")
        both = ends.groupBy("x").agg(F.sum("n").alias("up"), F.min("n").alias("below"))
        if both.where("up > 1 OR (up = 1 AND below = 0)").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
