"""Connected components of an edge table, by rounds of joins that shrink every component to a star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labourlens.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, component): the least node that each node is connected with.

    A round links every node's neighbours to the least of them, first to those above the node, then to those below; each
    round is an aggregation that combines on the map side and a join that splits hot keys.  The edges are stars, each
    around its least node, when a round changes nothing.  Nodes without an edge to another node are not in the result.
    """
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    while True:
        # large star: of all neighbours of a node, those above it move to the least
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.filter(F.col("m") > F.col("n")).join(least, "n").select(F.col("m").alias("v"), F.col("least").alias("u")).filter(F.col("v") != F.col("u")).distinct()
        # small star: of the neighbours below a node, and the node itself, all move to the least
        low = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(low, "v").select(F.col("u").alias("x"), "least").unionByName(low.select(F.col("v").alias("x"), "least"))
        new = stored(small.filter(F.col("x") != F.col("least")).select(F.col("x").alias("v"), F.col("least").alias("u")).distinct(), "edges")
        if new.exceptAll(edges).isEmpty() and new.count() == edges.count():
            break
        edges = new
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
