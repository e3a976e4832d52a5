"""Connected components of a large edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.runtime import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``u``, ``v``, long); component is the smallest node.

    Alternating star contraction: each node's larger neighbours, then its smaller ones, are hung on the
    smallest neighbour, until every edge points at the smallest node of its component. The number of rounds grows
    with the logarithm of the longest chain. Each round is written to the shared folder; minima are
    combined before the shuffle, so a node with very many neighbours costs one row per task.
    """
    current = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _fingerprint(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
