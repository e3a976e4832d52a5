"""Device graph as ``nodes`` and ``edges`` tables built from topology documents."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.runtime import is_empty, materialize

# Upstream priority of device roles, smaller is further upstream.
ROLE_PRIORITY = {
    "border": 0,
    "spine": 0,
    "core": 1,
    "distribution": 2,
    "access": 3,
    "leaf": 3,
    "oob": 4,
    "other": 5,
}
UNKNOWN_PRIORITY = 5


@dataclass(frozen=True)
class Topology:
    nodes: DataFrame
    edges: DataFrame


def role_priority(role: Column) -> Column:
    out = F.lit(UNKNOWN_PRIORITY)
    for name, value in ROLE_PRIORITY.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def _physical(docs: DataFrame, field: str) -> DataFrame:
    path = f"`network-model`.`physical-layer`.`{field}`"
    return docs.select("doc_id", F.posexplode(F.col(path)).alias("pos", "item"))


def load_nodes(docs: DataFrame) -> DataFrame:
    """One row per device id; of duplicates the last one wins."""
    role = F.coalesce(F.col("item.role"), F.lit("other"))
    devices = _physical(docs, "device").select(
        F.col("item.`device-id`").alias("id"), role.alias("role"), F.struct("doc_id", "pos").alias("at")
    )
    last = devices.filter("id is not null").groupBy("id").agg(F.max_by("role", "at").alias("role"))
    return last.select("id", "role", role_priority(F.col("role")).alias("role_priority"))


def _endpoints(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep two-ended links between known devices and attach both role priorities."""
    ends = items.filter(F.size("item.endpoint") == 2).select(
        F.struct("doc_id", "pos").alias("at"),
        F.col("item.endpoint")[0]["device-id"].alias("a"),
        F.col("item.endpoint")[1]["device-id"].alias("b"),
        *([F.col("item.type").alias("type")] if "type" in items.schema["item"].dataType.names else []),
    )
    rank = nodes.select("id", "role_priority")
    return ends.join(
        rank.select(F.col("id").alias("a"), F.col("role_priority").alias("pa")), "a"
    ).join(rank.select(F.col("id").alias("b"), F.col("role_priority").alias("pb")), "b")


def load_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed links, upstream to downstream.

    A physical link runs from the lower role priority to the higher one and keeps
    the endpoint order on a tie. A session between internal peers runs in
    alphabetical order, other sessions like physical links. On the same direction a
    physical link wins, then the first session.
    """
    downward = F.col("pa") <= F.col("pb")
    links = _endpoints(_physical(docs, "physical-connection"), nodes).select(
        F.when(downward, F.col("a")).otherwise(F.col("b")).alias("src"),
        F.when(downward, F.col("b")).otherwise(F.col("a")).alias("dst"),
        F.lit("physical").alias("edge_type"),
        F.lit(None).cast("string").alias("bgp_type"),
        F.lit(0).alias("layer"),
        "at",
    )
    sessions = docs.select(
        "doc_id", F.posexplode(F.col("`network-model`.`layer3-layer`.`bgp-session`")).alias("pos", "item")
    )
    kind = F.coalesce(F.col("type"), F.lit("ebgp"))
    internal = kind == "ibgp"
    peers = _endpoints(sessions, nodes).select(
        F.when(internal, F.least("a", "b"))
        .when(downward, F.col("a"))
        .otherwise(F.col("b"))
        .alias("src"),
        F.when(internal, F.greatest("a", "b"))
        .when(downward, F.col("b"))
        .otherwise(F.col("a"))
        .alias("dst"),
        F.lit("bgp").alias("edge_type"),
        kind.alias("bgp_type"),
        F.lit(1).alias("layer"),
        "at",
    )
    first = W.partitionBy("src", "dst").orderBy("layer", "at")
    return (
        links.unionByName(peers)
        .withColumn("n", F.row_number().over(first))
        .filter("n = 1")
        .select("src", "dst", "edge_type", "bgp_type")
    )


def load_interfaces(docs: DataFrame) -> DataFrame:
    """Interfaces of the first document entry of each device."""
    devices = _physical(docs, "device").select(
        F.col("item.`device-id`").alias("device_id"),
        F.struct("doc_id", "pos").alias("at"),
        F.col("item.interface").alias("interface"),
    )
    first = devices.groupBy("device_id").agg(F.min_by("interface", "at").alias("interface"))
    return first.select("device_id", F.posexplode("interface").alias("position", "i")).select(
        "device_id",
        "position",
        F.col("i.`interface-id`").alias("interface_id"),
        F.col("i.`ip-address`").alias("ip"),
        F.col("i.description").alias("description"),
    )


def load_topology(docs: DataFrame, *, durable: bool = True) -> Topology:
    """Both tables; with ``durable`` they are stored once and reread by every job."""
    nodes = load_nodes(docs)
    if durable:
        nodes = materialize(nodes, "nodes")
    edges = load_edges(docs, nodes)
    return Topology(nodes, materialize(edges, "edges") if durable else edges)


def neighbors(edges: DataFrame) -> DataFrame:
    """Direct neighbours of every node, each once; upstream ones have side 0."""
    up = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), F.lit(0).alias("side"))
    down = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), F.lit(1).alias("side"))
    return up.unionByName(down).groupBy("id", "neighbor").agg(F.min("side").alias("side"))


def device_profiles(requested: DataFrame, topology: Topology, interfaces: DataFrame) -> DataFrame:
    """Role, neighbours and interfaces as JSON per requested ``device_id``."""
    near = neighbors(topology.edges).groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("side", "neighbor"))), lambda x: x.neighbor).alias(
            "neighbors"
        )
    )
    ports = interfaces.groupBy("device_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "interface_id", "ip", "description"))),
            lambda x: F.struct(x.interface_id.alias("id"), x.ip.alias("ip"), x.description.alias("description")),
        ).alias("interfaces")
    )
    found = (
        requested.join(topology.nodes.select(F.col("id").alias("device_id"), "role"), "device_id", "left")
        .join(near.withColumnRenamed("id", "device_id"), "device_id", "left")
        .join(ports, "device_id", "left")
    )
    profile = F.to_json(
        F.struct(
            "device_id",
            "role",
            F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"),
            F.coalesce(
                "interfaces", F.array().cast("array<struct<id:string,ip:string,description:string>>")
            ).alias("interfaces"),
        ),
        {"ignoreNullFields": "false"},
    )
    unknown = F.to_json(
        F.struct(
            F.concat(F.lit("デバイス '"), F.col("device_id"), F.lit("' はトポロジーに存在しません")).alias("error")
        )
    )
    return found.select("device_id", F.when(F.col("role").isNull(), unknown).otherwise(profile).alias("profile"))


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges added and removed between two versions; types do not count."""
    old_pairs, new_pairs = (e.select("src", "dst").distinct() for e in (old, new))
    added = new_pairs.join(old_pairs, ["src", "dst"], "left_anti").withColumn("change", F.lit("added"))
    removed = old_pairs.join(new_pairs, ["src", "dst"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def topology_changed(old: DataFrame, new: DataFrame) -> bool:
    return not is_empty(edge_diff(old, new))


def node_list(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.coalesce("role", F.lit("other")).alias("role"))


def edge_list(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.coalesce("edge_type", F.lit("physical")).alias("edge_type"),
    )


def graph_elements(topology: Topology) -> DataFrame:
    """Map-viewer elements, one JSON element per row with its group (nodes or edges)."""
    nodes = node_list(topology.nodes).select(
        F.lit("nodes").alias("element_group"),
        F.to_json(F.struct(F.struct("id", "role").alias("data"))).alias("element"),
    )
    edges = edge_list(topology.edges).select(
        F.lit("edges").alias("element_group"),
        F.to_json(
            F.struct(
                F.struct(
                    F.concat_ws("__", "source", "target").alias("id"), "source", "target", "edge_type"
                ).alias("data")
            )
        ).alias("element"),
    )
    return nodes.unionByName(edges)


def tag_map(nodes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Tag every node as root, secondary or normal for each given incident.

    Only the tagged rows are joined; the normal ones come from the node list that a
    viewer holds anyway, so the pairs stay proportional to incidents plus affected nodes.
    """
    tags = incidents.select(
        "incident_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("root_cause_node").alias("id"), F.lit("root").alias("node_type"))),
                F.transform(
                    "secondary_nodes",
                    lambda n: F.struct(n.alias("id"), F.lit("secondary").alias("node_type")),
                ),
            )
        ).alias("t"),
    ).select("incident_id", "t.id", "t.node_type")
    first = tags.groupBy("incident_id", "id").agg(F.min("node_type").alias("node_type"))
    return first.join(nodes.select("id"), "id", "left_semi").select("incident_id", "id", "node_type")


def map_for_incident(nodes: DataFrame, incident: DataFrame) -> DataFrame:
    """Full node list with tags for one incident row."""
    tags = tag_map(nodes, incident)
    return nodes.select("id").join(tags, "id", "left").select(
        "id", F.coalesce("node_type", F.lit("normal")).alias("node_type")
    )


def save_version(topology: Topology, path: str, version: int) -> None:
    """Store one topology version; readers pick the newest."""
    topology.nodes.write.mode("overwrite").parquet(f"{path}/nodes/version={version}")
    topology.edges.write.mode("overwrite").parquet(f"{path}/edges/version={version}")


def load_latest(spark, path: str) -> Topology:
    """Newest stored version. The maximum comes from folder names only."""
    nodes = spark.read.parquet(f"{path}/nodes")
    edges = spark.read.parquet(f"{path}/edges")
    newest = edges.select(F.max("version").alias("v")).first().v
    return Topology(
        nodes.filter(F.col("version") == newest).drop("version"),
        edges.filter(F.col("version") == newest).drop("version"),
    )


def reload_counts(topology: Topology) -> DataFrame:
    """Numbers of nodes and edges of a loaded version."""
    parts = topology.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(
        topology.edges.select(F.lit(0), F.lit(1))
    )
    return parts.agg(
        F.lit("reloaded").alias("status"), F.sum("n").alias("nodes"), F.sum("e").alias("edges")
    )
