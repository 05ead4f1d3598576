"""Connected components of a graph of links, by alternating large and small stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sieve import met
from .store import materialise

#: Edges of a hub that one task moves.
PART = 1 << 14


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of all nodes that links(a, b) name.

    A round of stars halves the distance to the smallest node at least, so that the number of rounds follows the logarithm of
    a component's diameter. A hub's edges are moved in parts."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "stars")
    while not _stars(edges):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours larger than a node move to the least of its neighbourhood
        large = met(both.where("v > u"), least, "u", PART).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node and its smaller neighbours move to the least of them
        small = met(large, least, "u", PART).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one that has none itself: then the stars are the components."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    per = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return per.agg(F.count_if((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0)))).first()[0] == 0
