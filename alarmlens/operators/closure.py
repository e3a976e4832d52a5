"""Reachability over the device graph.

A closure doubles the path length it covers in each round: the newest pairs are joined
with all pairs so far, pairs seen before are dropped, and each round is stored in the
shared folder. It stops on cycles because only new pairs go on.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.runtime import is_empty, materialize


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ancestors(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All pairs ``(node, ancestor)`` over the given edges, without a node's own pair.

    ``nodes`` (column ``id``) limits the rows to these nodes.
    """
    steps = edges.select(F.col("dst").alias("node"), F.col("src").alias("ancestor"))
    frontier = materialize(steps.filter(F.col("node") != F.col("ancestor")).distinct(), "closure")
    seen = [frontier]
    while not is_empty(frontier):
        known = _union(seen)
        onward = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        reached = (
            frontier.join(onward, "ancestor")
            .select("node", F.col("next").alias("ancestor"))
            .filter(F.col("node") != F.col("ancestor"))
            .distinct()
        )
        frontier = materialize(reached.join(known, ["node", "ancestor"], "left_anti"), "closure")
        seen.append(frontier)
    pairs = _union(seen)
    if nodes is None:
        return pairs
    return pairs.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")


def descendants(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All pairs ``(node, descendant)``."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ancestors(flipped, nodes).withColumnRenamed("ancestor", "descendant")


def physical_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs ``(node, ancestor)`` over physical links, each node with itself included.

    Depends on the topology version only; compute once and pass it to every run.
    """
    own = nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"))
    pairs = ancestors(edges.filter(F.col("edge_type") == "physical"))
    return materialize(own.unionByName(pairs), "physical")


def conditional_ancestors(
    active: DataFrame,
    physical: DataFrame,
    edges: DataFrame,
    keys: list[str],
) -> DataFrame:
    """Ancestors of each active host of a window, its own pair included.

    ``active`` has the window keys, ``hostname`` and ``is_routing``. Physical links
    always count. A routing session counts only when the host at its receiving end
    is routing-active in the window, so each window sees its own graph. The result
    has ``hostname``, ``ancestor`` and ``physical`` (reached over physical links alone).
    """
    up = physical.select(F.col("node").alias("hostname"), "ancestor")
    base = active.select(*keys, "hostname").join(up, "hostname").select(*keys, "hostname", "ancestor")
    grown = gained_ancestors(active, physical, edges, keys, base)
    return base.withColumn("physical", F.lit(True)).unionByName(grown.withColumn("physical", F.lit(False)))


def met_ancestors(active: DataFrame, physical: DataFrame, keys: list[str]) -> DataFrame:
    """Physical pairs of a window whose ancestor is active in it too, a host's own pair included.

    The only step in which every ancestor of every active host moves; few of them are active, so what it gives is small.
    """
    up = physical.select(F.col("node").alias("hostname"), "ancestor")
    base = active.select(*keys, "hostname").join(up, "hostname").select(*keys, "hostname", "ancestor")
    return base.join(active.select(*keys, F.col("hostname").alias("ancestor")), [*keys, "ancestor"], "left_semi")


def gained_ancestors(
    active: DataFrame,
    physical: DataFrame,
    edges: DataFrame,
    keys: list[str],
    pairs: DataFrame,
) -> DataFrame:
    """Pairs that live sessions add to the physical ones: window keys, ``hostname``, ``ancestor``.

    ``pairs`` has the physical pairs; those of ``met_ancestors`` are enough, since a live session ends at an active host.
    """
    up = physical.select(F.col("node").alias("hostname"), "ancestor")
    sessions = edges.filter(F.col("edge_type") == "bgp").select(
        F.col("dst").alias("hostname"), F.col("src").alias("via")
    )
    live = materialize(
        active.filter("is_routing").join(sessions, "hostname").select(
            *keys, F.col("hostname").alias("ancestor"), "via"
        ),
        "live-sessions",
    )
    if is_empty(live):
        return pairs.select(*keys, "hostname", "ancestor").filter(F.lit(False))
    # The rounds run over the far ends of live sessions alone: from one the hosts above it and their own sessions are reached.
    beyond = physical.select(F.col("node").alias("via"), "ancestor")
    following = live.select(*keys, "ancestor", F.col("via").alias("next"))
    ends = live.select(*keys, "via").distinct()
    hops = ends.join(beyond, "via").join(following, [*keys, "ancestor"]).select(*keys, "via", "next")
    frontier = materialize(hops.filter("via != next").distinct(), "hops")
    seen: list[DataFrame] = []
    while not is_empty(frontier):
        seen.append(frontier)
        known = _union(seen)
        onward = known.select(*keys, F.col("via").alias("next"), F.col("next").alias("last"))
        reached = frontier.join(onward, [*keys, "next"]).select(*keys, "via", F.col("last").alias("next"))
        reached = reached.filter("via != next").distinct()
        frontier = materialize(reached.join(known, [*keys, "via", "next"], "left_anti"), "hops")
    crossed = materialize(pairs.join(live, [*keys, "ancestor"]).select(*keys, "hostname", "via").distinct(), "crossed")
    if seen:
        further = crossed.join(_union(seen), [*keys, "via"]).select(*keys, "hostname", F.col("next").alias("via"))
        crossed = crossed.unionByName(further).distinct()
    gained = crossed.join(beyond, "via").select(*keys, "hostname", "ancestor").distinct()
    # A host's physical pairs are the same in every window, so what is new shows against the closure.
    return materialize(gained.join(up, ["hostname", "ancestor"], "left_anti").select(*keys, "hostname", "ancestor"), "reach")
