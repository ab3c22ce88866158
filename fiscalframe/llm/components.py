"""Connected components by alternating stars, with nothing gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fiscalframe.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them.  Takes and gives edges with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ties = edges.join(least, "a").select("b", "m").filter("b > m").withColumnRenamed("b", "a")
    return ties.union(least).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots themselves; the root is the component's least node.

    Hubs are met by map-side aggregation and by joins that AQE can split.  Every
    round is written to the checkpoint folder, so lineage does not grow.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.toDF("node", "root")
        before = now
        edges = kept(_small_star(_large_star(edges)))
