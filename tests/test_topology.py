import json

from alarmlens.operators import topology as T
from alarmlens.operators.closure import ancestors, descendants, physical_closure
from alarmlens.sources.topology_docs import from_column, read_json, read_supporting_nodes, read_yaml


def _doc(devices, links=(), sessions=()):
    return {
        "network-model": {
            "physical-layer": {
                "device": devices,
                "physical-connection": [
                    {"connection-id": f"c{i}", "endpoint": [{"device-id": e} for e in ends]} for i, ends in enumerate(links)
                ],
            },
            "layer3-layer": {
                "bgp-session": [
                    {**({"type": kind} if kind else {}), "endpoint": [{"device-id": e} for e in ends]}
                    for kind, ends in sessions
                ]
            },
        }
    }


def _dev(name, role=None, ports=()):
    return {"device-id": name, **({"role": role} if role else {}), "interface": list(ports)}


def _load(spark, *docs):
    frame = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "doc_id string, doc string")
    parsed = from_column(frame, "doc")
    return T.load_topology(parsed), T.load_interfaces(parsed)


CORE = _doc(
    [_dev("A", "core"), _dev("A", "border"), _dev("B", "access", [{"interface-id": "e0", "ip-address": "1.1.1.1"}]),
     _dev("Zebra", "leaf"), _dev("Alpha", "leaf"), _dev("Odd")],
    [("B", "A"), ("B", "A", "Odd"), ("B", "Ghost"), ("Zebra", "Alpha"), ("Odd", "Zebra")],
    [("ibgp", ("Zebra", "Alpha")), ("ebgp", ("A", "B")), (None, ("Odd", "A")), ("ebgp", ("A", "Odd"))],
)


def test_loader_rules(spark):
    topo, ports = _load(spark, CORE)
    assert {r.id: (r.role, r.role_priority) for r in topo.nodes.collect()} == {
        "A": ("border", 0), "B": ("access", 3), "Zebra": ("leaf", 3), "Alpha": ("leaf", 3), "Odd": ("other", 5),
    }
    assert {(r.src, r.dst, r.edge_type, r.bgp_type) for r in topo.edges.collect()} == {
        ("A", "B", "physical", None),
        ("Zebra", "Alpha", "physical", None),
        ("Alpha", "Zebra", "bgp", "ibgp"),
        ("Zebra", "Odd", "physical", None),
        ("A", "Odd", "bgp", "ebgp"),
    }
    assert [(r.device_id, r.interface_id, r.ip, r.description) for r in ports.collect()] == [("B", "e0", "1.1.1.1", None)]
    near = {(r.id, r.neighbor, r.side) for r in T.neighbors(topo.edges).collect()}
    assert ("Zebra", "Alpha", 0) in near and ("A", "B", 1) in near
    profile = T.device_profiles(topo.nodes.selectExpr("id as device_id").filter("id = 'B'"), topo, ports).first()
    assert json.loads(profile.profile) == {
        "device_id": "B", "role": "access", "neighbors": ["A"],
        "interfaces": [{"id": "e0", "ip": "1.1.1.1", "description": None}],
    }


def test_file_formats(spark, tmp_path):
    import yaml

    (tmp_path / "t.json").write_text(json.dumps(CORE, indent=1))
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "t.yaml").write_text(yaml.safe_dump(CORE))
    a = T.load_topology(read_json(spark, str(tmp_path / "t.json")))
    b = T.load_topology(read_yaml(spark, str(tmp_path / "y")))
    pairs = lambda t: {tuple(r) for r in t.edges.collect()}
    assert pairs(a) == pairs(b) and len(pairs(a)) == 5
    (tmp_path / "s.json").write_text(json.dumps({"ietf-network:networks": {"network": [{"node": [
        {"node-id": "kid", "ietf-network-topology:supporting-node": [{"node-ref": "mum"}]}, {"node-id": "mum"}]}]}}))
    assert [tuple(r) for r in read_supporting_nodes(spark, str(tmp_path / "s.json")).collect()] == [("mum", "kid")]


def test_closure_on_chain_and_cycle(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(20)]
    ring = [("x", "y"), ("y", "z"), ("z", "x"), ("x", "x")]
    edges = spark.createDataFrame([(*e, "physical", None) for e in chain + ring], "src string, dst string, edge_type string, bgp_type string")
    pairs = {tuple(r) for r in ancestors(edges).collect()}
    want = {(f"n{j}", f"n{i}") for j in range(21) for i in range(j)}
    want |= {(a, b) for a in "xyz" for b in "xyz" if a != b}
    assert pairs == want
    assert {tuple(r) for r in descendants(edges).collect()} == {(b, a) for a, b in want}
    nodes = spark.createDataFrame([("n0",), ("x",)], "id string")
    own = {tuple(r) for r in physical_closure(nodes, edges.filter("src = 'none'")).collect()}
    assert own == {("n0", "n0"), ("x", "x")}


def test_versions_diff_and_tags(spark, tmp_path):
    topo, _ = _load(spark, CORE)
    other, _ = _load(spark, _doc([_dev("A", "core"), _dev("B", "access")], [("A", "B")], []))
    assert not T.topology_changed(topo.edges, topo.edges)
    assert T.topology_changed(topo.edges, other.edges)
    T.save_version(topo, str(tmp_path), 9)
    T.save_version(other, str(tmp_path), 10)
    newest = T.load_latest(spark, str(tmp_path))
    counts = T.reload_counts(newest).first()
    assert (counts.status, counts.nodes, counts.edges) == ("reloaded", 2, 1)
    incident = spark.createDataFrame([("i1", "A", ["B"])], "incident_id string, root_cause_node string, secondary_nodes array<string>")
    tags = {r.id: r.node_type for r in T.map_for_incident(topo.nodes, incident).collect()}
    assert tags == {"A": "root", "B": "secondary", "Zebra": "normal", "Alpha": "normal", "Odd": "normal"}
