"""Connected components of a link table, by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import remove, written


def _least_of(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their first node's m. Joined by a turned node, for which alone both sides are shuffled, so that a node of very many edges can be split over tasks."""
    turned = F.reverse("a") if dict(edges.dtypes)["a"] == "string" else F.col("a").bitwiseXOR(F.lit(1).cast("long"))
    return edges.join(least.select(turned.alias("_a"), "m"), turned == F.col("_a"))


def _pull(edges: DataFrame) -> DataFrame:
    """Large star: of (a, b) with a > b, every node's larger neighbours move to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _least_of(both.where(F.col("b") > F.col("a")), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _fold(edges: DataFrame) -> DataFrame:
    """Small star: every node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _least_of(edges, least).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to its root, and no root has any: then roots are the smallest of their components, as edges go down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(F.col("up") + F.col("down") > 1).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), numbers or strings, root being the smallest node that can be reached.

    Links may be repeated, in either direction or from a node to itself; nodes with no link to another are not in the
    result. Rounds grow with the logarithm of the number of nodes, and links from every node to its root take none; each is written to
    the shared folder, and the one before removed.
    """
    one_way = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = written(one_way.distinct(), "links")
    while not _settled(edges):
        old, (edges, path) = path, written(_fold(_pull(edges)).distinct(), "links")
        remove(links.sparkSession, old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
