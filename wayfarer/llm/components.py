"""Connected components of a graph of long ids, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node that has an edge to another.

    ``edges`` has long columns u and v; self-loops, repeats and nulls count for
    nothing. The component's id is its smallest node. Each round only groups with
    partial minima and joins on one key, so a node with very many edges is split
    by adaptive skew joins; the number of rounds grows with the logarithm of the
    longest chain.
    """
    edges = staged(edges.where("u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = staged(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # All edges now lead from a node to the least node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
