"""Connected components of a graph given as a table of edges.

Two kinds of round alternate until no edge changes: each node's larger
neighbours, then its smaller ones, are linked to its smallest neighbour.  Every
round is a minimum per node (combined map-side) and an equi-join back, so no
node's neighbours are gathered, and the number of rounds grows with the logarithm of
the number of nodes, also on a chain.  Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """Per ``(a, b)``: ``a``'s smallest neighbour, or ``a`` if that is smaller."""
    least = pairs.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return pairs.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = _to_smallest(both).filter(F.col("b") > F.col("a"))
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` go from larger to smaller nodes."""
    near = _to_smallest(edges)
    own = near.select("a", F.col("m").alias("b"))
    return own.unionByName(near.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge between two different nodes; a
    component's name is its smallest node.  ``edges`` has columns ``a`` and ``b`` (long)."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        now = materialize(_small_star(_large_star(now)), "components")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = seen
