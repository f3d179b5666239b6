"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.session import checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b: long).

    Each step links the neighbours of a node to the least of them (Kiveris and others, "Connected components in
    MapReduce and beyond"); a logarithmic number of steps gives stars around the least nodes. The number of edges
    does not grow, and a node of very many edges is joined as a skewed key.
    """
    checkpoint_dir(edges.sparkSession)

    def star(graph: DataFrame, large: bool) -> DataFrame:
        # (u, v): v is a neighbour of u; large: all neighbours; small: the lesser ones
        both = graph.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(graph.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(least, "u")
        if large:
            out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = (linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
                   .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        return out.filter("a <> b")

    def settled(graph: DataFrame) -> bool:
        """Whether every node but the least of its component has one edge, which leads to that one."""
        ends = graph.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            graph.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        each = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return each.filter("out > 1 or (out = 1 and into = 1)").isEmpty()

    graph = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    graph = graph.distinct().checkpoint()
    while not settled(graph):
        graph = star(star(graph, True), False).distinct().checkpoint()
    # every edge now leads from a node to the least of its component
    found = graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
