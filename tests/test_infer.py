import random

import pytest
from pyspark.sql import functions as F

from alarmlens.operators.topology import ROLE_PRIORITY
from alarmlens.plans import infer as plan
from alarmlens.plans.infer import Rules, assign_hosts, incident_logs, infer, simple_roots, window_summary
from alarmlens.runtime import materialize
from tests.helpers import SITE_EDGES, SITE_NODES, at, model_infer, star, topology, windowed

LINK = "%LINK-3-UPDOWN: Interface GE0/0, changed state to down"
BGP = "%BGP-5-ADJCHANGE: neighbor 10.0.0.1 Down"
PING = "%PING-3-FAILED: Gateway unreachable"
CONF = "%SYS-5-CONFIG_I: Configured"


def run(spark, topo, rows, **kw):
    got = infer(windowed(spark, rows), topo, **kw).orderBy("domain", "emit_rank").collect()
    return got


def by_domain(found):
    got = {}
    for x in found:
        got.setdefault(x.domain, []).append(x)
    return got


def forest():
    """A binary tree of 15, a tree below a session, a ring, and two parents that share their children."""
    edges = [(f"t{i // 2}", f"t{i}") for i in range(2, 16)]
    edges += [("v1", "v2"), ("v2", "v3", "bgp"), ("v3", "v4")] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1")]
    edges += [(y, f"z{i}") for y in ("y1", "y2") for i in range(4)]
    return edges, sorted({n for e in edges for n in e[:2]})


def below(edges, node):
    found, left = set(), [node]
    while left:
        at_ = left.pop()
        for e in edges:
            if e[0] == at_ and e[1] not in found:
                found.add(e[1])
                left.append(e[1])
    return found


def test_alarm_of_a_whole_tree_has_its_top_as_root(spark):
    """All nodes of a tree log, in any order: one incident of its top, which covers all others."""
    edges, nodes = forest()
    rows = []
    for k in range(4):
        hosts = ["t1", *sorted(below(edges, "t1"))]
        random.Random(k).shuffle(hosts)
        rows += [(h, LINK, 3, i, f"order{k}") for i, h in enumerate(hosts)]
    got = by_domain(run(spark, topology(spark, dict.fromkeys(nodes, "leaf"), edges), rows))
    for k in range(4):
        (one,) = got[f"order{k}"]
        assert (one.root_cause_node, one.secondary_nodes) == ("t1", sorted(below(edges, "t1")))
        assert one.raw_log_count == len(one.raw_logs) == 15
        assert (one.status, one.condition, one.primary_event) == ("OPEN", "ACTIVE", LINK)


def test_hosts_outside_the_topology_and_mild_messages_make_nothing(spark):
    edges, nodes = forest()
    rows = [("stranger", LINK, 3, 0, "a"), ("t4", LINK, 6, 0, "b"), ("t4", LINK, 7, 1, "b"), ("t4", LINK, 6, 0, "c"), ("t4", BGP, 5, 1, "c")]
    got = by_domain(run(spark, topology(spark, dict.fromkeys(nodes, "leaf"), edges), rows))
    assert set(got) == {"c"} and got["c"][0].raw_logs == [LINK, BGP] and got["c"][0].primary_event == BGP


@pytest.mark.parametrize("threshold", [3, 0])
def test_windows_over_a_forest_match_the_model(spark, threshold):
    """Storms, repeats and recoveries of neighbouring hosts, window by window."""
    edges, nodes = forest()
    rng = random.Random(40 + threshold)
    up = LINK.replace("down", "up")
    per_window, rows = {}, []
    for w in range(60):
        start = rng.choice(nodes)
        near = sorted({start, *below(edges, start), *[e[0] for e in edges if e[1] == start]})
        for i in range(rng.randint(1, 14)):
            rows.append((rng.choice(near), rng.choice([LINK, LINK, up, BGP, CONF, PING]), rng.choice([2, 3, 5, 6]), i, f"f{w:02d}"))
    for i, r in enumerate(rows):
        per_window.setdefault(r[4], []).append((r[0], r[1], r[2], r[3], i))
    topo = topology(spark, dict.fromkeys(nodes, "leaf"), edges)
    got = by_domain(run(spark, topo, rows, drop_recovery=False, rules=Rules(flapping_threshold=threshold)))
    for w, messages in per_window.items():
        found = [(x.kind, x.root_cause_node, tuple(x.secondary_nodes), x.primary_event, x.raw_logs) for x in got.get(w, [])]
        assert found == model_infer(messages, [e if len(e) > 2 else (*e, "physical") for e in edges], nodes, flap=threshold or 10**9), w


def test_simple_variant(spark):
    """Without severities, sessions and silent roots: what logs and has no logging ancestor is a root."""
    edges, nodes = forest()
    rng = random.Random(9)
    hosts = rng.sample([n for n in nodes if n[0] != "x"], 9)
    messages = windowed(spark, [(h, rng.choice([LINK, PING]), rng.choice([1, 7]), i) for i, h in enumerate([*hosts, "stranger"])])
    topo = topology(spark, dict.fromkeys(nodes, "leaf"), edges)
    got = {x.root_cause_node: x.secondary_nodes for x in simple_roots(messages, topo).collect()}
    roots = [h for h in hosts if not any(h in below(edges, o) for o in hosts if o != h)]
    assert got == {r: sorted(below(edges, r) & set(hosts)) for r in roots}
    totals = window_summary(messages, simple_roots(messages, topo)).first()
    assert (totals.raw_logs, totals.root_causes) == (10, len(roots))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_windows_match_the_model(spark, seed):
    """Random graphs with cycles and sessions; each window is compared as a whole."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    pairs = rng.sample([(a, b) for a in names for b in names if a != b], 13)
    edges = [(a, b, "bgp" if rng.random() < 0.35 else "physical") for a, b in pairs]
    texts = [LINK, BGP, CONF, "no token", "%OSPF-5-ADJCHG: to DOWN"]
    rows, per_window = [], {}
    for w in range(120):
        hosts = rng.sample(names + ["ghost"], rng.randint(1, 8))
        for i in range(rng.randint(1, 16)):
            row = (rng.choice(hosts), rng.choice(texts), rng.choice([2, 3, 5, 5, 6]), rng.randint(0, 25), f"w{w:03d}")
            rows.append(row)
    rows.sort(key=lambda r: (r[4], r[3]))
    for i, r in enumerate(rows):
        per_window.setdefault(r[4], []).append((r[0], r[1], r[2], r[3], i))
    topo = topology(spark, dict.fromkeys(names, "leaf"), edges)
    messages = windowed(spark, rows)
    got = {}
    for x in infer(messages, topo).orderBy("domain", "emit_rank").collect():
        got.setdefault(x.domain, []).append(
            (x.kind, x.root_cause_node, tuple(x.secondary_nodes), x.primary_event, x.raw_logs)
        )
        assert x.raw_log_count == len(x.raw_logs)
    assert {k[0] for v in got.values() for k in v} >= {"flapping", "silent", "regular"}
    for w, msgs in per_window.items():
        assert got.get(w, []) == model_infer(msgs, edges, names), w
    assigned = assign_hosts(messages, topo)
    assert assigned.count() == assigned.select("domain", "hostname").distinct().count()
    total = infer(messages, topo, logs=False).agg(F.sum("raw_log_count").alias("n")).first().n
    assert incident_logs(messages, assigned).count() == total


def claimed(spark, windows, flapping=()):
    """Tables for the owners of hosts: ``windows`` maps a name to candidates, in rank order, each with its hosts."""
    hosts, marked, ranked = set(), [], []
    for w, candidates in windows.items():
        for rank, (name, below_it) in enumerate(candidates, 1):
            ranked.append((w, 0, name, rank))
            for host in below_it:
                hosts.add((w, 0, host, "flaps" if (w, host) in flapping else None))
                marked.append((w, 0, host, name))
    return (
        spark.createDataFrame(sorted(hosts, key=str), "domain string, window_start int, hostname string, flap string"),
        spark.createDataFrame(marked, "domain string, window_start int, hostname string, ancestor string"),
        spark.createDataFrame(ranked, "domain string, window_start int, ancestor string, rank int"),
    )


def taken_in_order(windows, flapping=()):
    out = {}
    for w, candidates in windows.items():
        free = {h for _, below_it in candidates for h in below_it if (w, h) not in flapping}
        for name, below_it in candidates:
            own = free & set(below_it)
            if len(own) >= 2:
                free -= own
                out |= {(w, h): name for h in own}
    return out


def owners_and_rounds(spark, monkeypatch, *tables):
    rounds = []

    def counted(df, name="step"):
        rounds.append(name)
        return materialize(df, name)

    monkeypatch.setattr(plan, "materialize", counted)
    got = {(r.domain, r.hostname): r.silent_root for r in plan._silent_owners(*tables).collect()}
    return got, rounds.count("owners")


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_silent_roots_take_hosts_in_rank_order(spark, monkeypatch, seed):
    """Candidates with overlapping hosts, many of them left with one: as when they are asked one after another."""
    rng = random.Random(seed)
    windows = {
        f"w{w}": [(f"c{c}", rng.sample([f"h{i}" for i in range(12)], rng.randint(1, 4))) for c in range(rng.randint(1, 9))]
        for w in range(150)
    }
    flapping = {(w, f"h{i}") for w in windows for i in range(12) if rng.random() < 0.15}
    got, _ = owners_and_rounds(spark, monkeypatch, *claimed(spark, windows, flapping))
    assert got == taken_in_order(windows, flapping)


def test_lonely_candidates_of_a_wide_tree_leave_at_once(spark, monkeypatch):
    """300 routers over two hosts each, of which one flaps: one round for all, and one that finds nothing left."""
    windows = {"w": [(f"c{c:03d}", [f"h{c}a", f"h{c}b"]) for c in range(300)]}
    flapping = {("w", f"h{c}a") for c in range(0, 300, 2)}
    got, rounds = owners_and_rounds(spark, monkeypatch, *claimed(spark, windows, flapping))
    assert got == taken_in_order(windows, flapping) and len(got) == 300
    assert rounds == 2


def test_stored_logs_are_the_first_200(spark):
    rows = [("Leaf1", f"line {i}", 3 if i > 250 else 6, i) for i in range(300)]
    got = run(spark, star(spark, 1), rows)
    assert got[0].raw_log_count == 300
    assert got[0].raw_logs == [f"line {i}" for i in range(200)]
    assert got[0].primary_event == "line 251"
