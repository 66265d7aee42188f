"""Connected components of a graph that is given by its links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, join_narrow


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least node around it."""
    around = _both(edges)
    least = cut(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return join_narrow(around.where("v > u"), least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    joined = join_narrow(down, least, ["u"])
    pulled = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pulled.where("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link down, or only links from above."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    return sums.where("ups > 1 or (ups = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node of each linked node's component; ``links`` has long columns a and b.

    Nodes without links are not listed. Every round keeps the links as a table in the checkpoint
    folder; a hub's links are dealt out by the joins, and only its least neighbour is aggregated. While
    the nodes are few, their least neighbours are broadcast and links are shuffled only to be grouped.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _all_stars(edges):
        edges = cut(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
