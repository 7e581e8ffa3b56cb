"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.runtime import cut, discard


def connected(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node that an edge (columns u, v) names.

    Each round points every node's larger neighbours at the smallest node of its neighbourhood, then does
    the same among smaller neighbours; both are a grouped minimum and a join, and the number of rounds
    grows with the logarithm of the longest path.  Rounds end when every component is a star around its
    smallest node, which one aggregate tells.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        # u > v holds in every edge: a node's larger neighbours are the edges turned round
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = now.unionByName(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = turned.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node of distinct edges (u > v) has larger neighbours only, or a single smaller one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not nodes.agg(F.max(F.col("below") + F.col("above") * F.least("below", F.lit(1)) > 1)).first()[0]
