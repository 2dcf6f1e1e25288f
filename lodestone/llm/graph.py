"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _joined(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with the least neighbour ``m`` of their ``a``. It is written first: then
    both sides of the join are plain shuffles, and AQE can split a hub's rows."""
    return rows.join(least, "a")


def _large_star(edges: DataFrame) -> list[DataFrame]:
    """Link every larger neighbour of a node to the least of node and neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    star = _joined(both, least).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return [materialize(star.distinct(), "edges"), least]


def _small_star(edges: DataFrame) -> list[DataFrame]:
    """Link a node and its smaller neighbours to the least of these. edges: a > b."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = _joined(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    star = moved.unionAll(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
    return [materialize(star.distinct(), "edges"), least]


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a leaf with one edge or a centre. Edges lead to the
    smaller node, so a centre is then the least of its component."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sums = ends.groupBy("n").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return sums.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the least node that it reaches. edges:
    (a, b), two columns of one orderable type. Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain."""
    kept = edges.where(F.col("a") != F.col("b"))
    now = materialize(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(now):
        large, least = _large_star(now)
        new, other = _small_star(large)
        for old in (now, large, least, other):
            discard(old)
        now = new
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(centres)
