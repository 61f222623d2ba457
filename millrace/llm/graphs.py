"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import settle


def in_stars(edges: DataFrame) -> bool:
    """Whether no larger end ``a`` has another edge: then every component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    more = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("up")).filter("up = 1 and n > 1")
    return more.agg(F.count(F.lit(1))).first()[0] == 0


def star(pairs: DataFrame, keep) -> DataFrame:
    """For every ``a``: its smallest neighbour or itself as ``m``, joined back to the neighbours that
    ``keep`` selects. The smallest comes from an aggregation, so a hub is no single task."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(low, "a").filter(keep)


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node of ``edges`` (``a``, ``b``); the root is the smallest node.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest path; edges
    that are stars already take none.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settle(ordered, "edges")
    while not in_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large, "large")
        # here b is always the smaller end
        small = star(large, F.lit(True))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = settle(small.filter("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
