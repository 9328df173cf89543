"""Connected components of links, by alternating star joins on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.session import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select("low", "high")).toDF("node", "other")
    smallest = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
    return both.filter("other > node").join(smallest, "node").select(F.col("other").alias("high"), F.col("root").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("high").agg(F.min("low").alias("root"))
    moved = edges.join(smallest, "high").filter("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
    return moved.union(smallest.select("high", F.col("root").alias("low")))


def connected_components(links: DataFrame, first: str, second: str) -> DataFrame:
    """``node, component`` for every end of a link; a component is named by its smallest node.

    Only edges travel, and only a count and a checksum of them reach the driver. Each round
    is a stored table, so a lost executor costs no more than that round.
    """
    spark = links.sparkSession
    edges = (
        links.select(F.greatest(first, second).alias("high"), F.least(first, second).alias("low"))
        .filter("high <> low").distinct()
    )
    edges, seen = store(spark, edges, "edges"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("sum")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        edges = store(spark, _small_star(_large_star(edges)).distinct(), "edges")
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
