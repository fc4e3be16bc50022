"""Connected components by alternating large-star and small-star steps; every step is a few shuffles, whatever a node's degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import cut

#: A node's edges meet its least neighbour in so many places, so that a hub's star isn't one task's.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with ``m``, the least node that ``least`` (a row for each a) has for a."""
    salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(salted, ["a", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = _with_least(down, least)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), longs; a component's id is its least node. Nodes without edges don't appear.

    The steps end when no node has two neighbours below it and no neighbour is above another: then edges are stars
    about components' least nodes, which is tested as such.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    while not _are_stars(edges):
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each edge leads from a to a lesser b, each a has one edge only, and no b is another edge's a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("own"), (F.col("a") < F.col("b")).alias("up")).union(edges.select("b", F.lit(0), F.lit(False)))
    per_node = ends.groupBy("node").agg(F.sum("own").alias("own"), F.count("*").alias("n"), F.bool_or("up").alias("up"))
    return per_node.filter("up or own > 1 or own = 1 and n > 1").isEmpty()
