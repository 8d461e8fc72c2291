"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from geohotspots.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    siblings = (
        edges.join(least, "u")
        .filter(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return siblings.union(least.select("u", F.col("m").alias("v"))).distinct()


def _store(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Stored edges and their fingerprint, taken while they are written."""
    seen = Observation()
    watched = edges.observe(
        seen,
        F.count(F.lit(1)).alias("edges"),
        F.bit_xor(F.xxhash64("u", "v")).alias("mix"),
    )
    stored = cut_lineage(watched)
    return stored, (seen.get["edges"], seen.get["mix"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)``.

    ``root`` is the smallest node of the component. Rounds grow with the logarithm of the
    graph, not with its diameter; each stores its edges and drops the plan behind them.
    """
    current, before = _store(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while before[0]:
        current, now = _store(_small_star(_large_star(current)))
        if now == before:
            break
        before = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots)
