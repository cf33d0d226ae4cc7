"""Connected components of a link table by alternating star contractions, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import materialize

MAX_ROUNDS = 60


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node, and the node itself, to the least of them."""
    both = edges if larger_only else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if larger_only:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Least node reachable from every linked node: (node, component). Columns ``a`` and ``b`` hold the links.

    Nulls and links of a node to itself are left out; a node without links is not returned. A hub with
    any number of links is folded by partial minima, and each round is a table in the shared folder.
    """
    ordered = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_towards_least(_towards_least(edges, False), True), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        known = state
    raise RuntimeError("components did not settle")
