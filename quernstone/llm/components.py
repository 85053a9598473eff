"""Connected components of an edge table, distributed, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """For each node, links its neighbours to the least id around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u")


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node that points to a lesser one has one edge, and that edge ends at a root."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.where("up > 0 AND n > 1").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its least node.

    Each round makes large stars (a node's greater neighbours move to its least
    one), then small stars (the lesser ones and itself do), until stars are all there is.
    Rounds grow with the logarithm of the longest path, and the edge count never
    grows. Minima are combined before the shuffle, so a hub costs no single task;
    AQE splits its join. Nulls and loops among edges are ignored."""
    u, v = F.col(left), F.col(right)
    edges = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    edges = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "components")
    while not _only_stars(edges):
        large = _stars(edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every edge now points from greater to lesser; a small star needs lesser neighbours only.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
