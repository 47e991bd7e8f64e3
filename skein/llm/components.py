"""Connected components of a graph of any size: alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """Written, so that both sides of the join with it are plain shuffles, which Spark can split at a node of many edges."""
    return stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), of any orderable type; returns node and root, its component's least node, of nodes with edges.

    Each step keeps the components and joins every edge's ends to a lesser neighbour; it ends when all edges lead to
    roots. Minima are partial sums and their way back is a join, so a node of many edges is no task of its own."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large")
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "edges")
        # stars: no lesser end is itself the greater end of an edge, and each greater end has one edge
        if edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
