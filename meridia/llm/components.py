"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node that it reaches.

    Each round is two aggregations by node with a join back, so that a node with a great many
    neighbours is pre-aggregated before the shuffle and split by the adaptive skew join. Nothing but
    a count and a checksum comes to the driver; each round's edges are a table in the shared folder.
    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    star = scratch(star, tag)
    seen = _digest(star)
    while seen[0]:
        star = scratch(_small(_large(star)), tag)
        now = _digest(star)
        if now == seen:
            break
        seen = now
    own = star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its greater neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Edges run from greater to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least).distinct()
