"""Connected components of a table of links, as joins and aggregates on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdwatch.llm import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with a link; the label is the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each node's links are moved
    to its smallest neighbour until all links of a component point at one node.  A node's links are
    never gathered; its smallest neighbour is an aggregate and is joined back.  Every round is
    written to the shared folder.  Null ends and links of a node to itself are ignored; no links
    give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = store.keep(edges, "links")
    while not _are_stars(edges):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours of u move to the smallest of u and its neighbours.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(moved.select("u", F.col("m").alias("v")))
        edges = store.keep(small.filter("u <> v").distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none of its own."""
    ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    twice = ends.filter("n > 1").select("u")
    onward = edges.select(F.col("v").alias("u")).join(ends.select("u"), "u", "left_semi")
    return not twice.unionAll(onward).head(1)
