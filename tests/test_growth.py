"""Steps whose cost once grew faster than their input."""
import glob

import pytest
from pyspark.sql import functions as F

from alarmlens.operators import closure
from alarmlens.plans import infer as INF
from alarmlens.runtime import materialize
from tests.helpers import star, topology, windowed
from workload import registry, stored

DAY = 86400


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """600 events of 40 devices over 50 days, longer than the delay of the stream queries."""
    path = str(tmp_path_factory.mktemp("log"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("error", "signup", "purchase", "click", "view")]), (F.col("id") % 5 + 1).cast("int"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.range(600).select(
        F.col("id").alias("event_id"),
        (start + F.make_dt_interval(secs=F.col("id") * F.lit(50 * DAY / 600))).alias("ts"),
        (F.col("id") * 7 % 40).alias("user_id"),
        kinds.alias("event_type"),
        F.lit(1.0).alias("value"),
        F.lit('{"k": 3}').alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_rounds_store_session_ends_not_hosts(spark, monkeypatch):
    """Sessions v0 <- v1 <- ... <- v5 with 30 hosts below v0: the rounds see the six ends, the hosts are stored once."""
    stored_rows = []
    plain = closure.materialize

    def counted(df, name="step"):
        out = plain(df, name)
        stored_rows.append((name, out.count()))
        return out

    hosts = [f"h{i}" for i in range(30)] + [f"v{i}" for i in range(6)]
    active = spark.createDataFrame([(1, h, h.startswith("v")) for h in hosts], "w int, hostname string, is_routing boolean")
    pairs = [(h, h) for h in hosts] + [(h, "v0") for h in hosts if h.startswith("h")]
    physical = spark.createDataFrame(pairs, "node string, ancestor string")
    edges = spark.createDataFrame([(f"v{i + 1}", f"v{i}", "bgp") for i in range(5)], "src string, dst string, edge_type string")
    monkeypatch.setattr(closure, "materialize", counted)
    got = closure.conditional_ancestors(active, physical, edges, ["w"])
    found = {(r.hostname, r.ancestor): r.physical for r in got.collect()}
    assert found == (
        {p: True for p in pairs}
        | {(f"h{i}", f"v{j}"): False for i in range(30) for j in range(1, 6)}
        | {(f"v{i}", f"v{j}"): False for i in range(6) for j in range(i + 1, 6)}
    )
    assert all(n <= 15 for name, n in stored_rows if name == "hops")
    assert [n for name, n in stored_rows if name == "reach"] == [30 * 5 + 15]


def test_numbers_come_before_logs(spark, log, monkeypatch):
    """The shared incidents are numbered without their logs, so the messages are read for logs once."""
    numbered = []
    plain = registry.I.number_incidents
    monkeypatch.setattr(registry.I, "number_incidents", lambda found: numbered.append(found.columns) or plain(found))
    monkeypatch.setattr(registry, "_STORED", {})
    got = registry.incidents(spark, log)
    assert numbered and "raw_logs" not in numbered[0]
    topo, messages = registry.topology(spark, log), registry.windowed(spark, log)
    plain_rows = INF.infer(messages, topo, registry.RULES)
    key = ["window_start", "emit_rank", "root_cause_node", "raw_log_count", "raw_logs", "secondary_nodes"]
    assert got.count() == plain_rows.count() > 0
    assert got.select(key).exceptAll(plain_rows.select(key)).count() == 0
    assert got.select("incident_id").distinct().count() == got.count()


def test_parts_of_a_stream_are_cut_into_files(spark, log, monkeypatch):
    monkeypatch.setattr(stored, "FILE_ROWS", 50)
    path, files = stored._datagrams(spark, log, 3)
    assert files == 4 and len(glob.glob(f"{path}/part-*")) == 12
    assert spark.read.json(path).count() == 600
    assert stored.received_count(spark, log).first()["received"] == 600


def test_batches_of_the_stream_queries_are_bounded(spark, log, monkeypatch):
    """A log longer than the delay comes in time order, so no row of a later batch is late."""
    monkeypatch.setattr(registry, "_STORED", {})
    whole = sorted(map(tuple, stored.tumbling_stream(spark, log).collect()))
    sessions = sorted(map(tuple, stored.session_stream(spark, log).collect()))
    made = []
    plain = stored._folder
    monkeypatch.setattr(stored, "_folder", lambda s, name: made.append(plain(s, name)) or made[-1])
    monkeypatch.setattr(stored, "FILE_ROWS", 100)
    assert sorted(map(tuple, stored.tumbling_stream(spark, log).collect())) == whole and len(whole) == 600
    assert len(glob.glob(f"{made[0]}/part=0/part-*")) == 6
    assert sorted(map(tuple, stored.session_stream(spark, log).collect())) == sessions


def _moves(df) -> int:
    """Shuffles by key in the plan of ``df``."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_incidents_move_once_and_logs_not_for_their_join(spark, monkeypatch):
    """Hosts move once to be folded and placed in their window, and logs are grouped by the key that incidents are joined on."""
    rows = [(f"Leaf{i % 3 + 1}", f"line {i}", 3, i) for i in range(9)]
    messages = materialize(windowed(spark, rows))
    assigned = materialize(INF.assign_hosts(messages, star(spark, 3)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = INF.build_incidents(assigned)
        assert _moves(found) == 1
        stored_found = materialize(found)
        logs = INF.stored_logs(messages, assigned)
        assert _moves(stored_found.join(logs, INF.LOG_KEY)) == _moves(logs) + 1
        assert sum(len(r.raw_logs) for r in stored_found.join(logs, INF.LOG_KEY).collect()) == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("mask", [INF.PLACE_MASK, 0])
def test_simple_roots_moves_pairs_as_one_number(spark, monkeypatch, mask):
    """Only places where an ancestor may log are stored, and names decide: equal hashes (mask 0) change no row."""
    stored_frames = {}

    def kept(df, name="step"):
        stored_frames[name] = materialize(df, name)
        return stored_frames[name]

    monkeypatch.setattr(INF, "materialize", kept)
    monkeypatch.setattr(INF, "PLACE_MASK", mask)
    nodes = dict.fromkeys([f"n{i}" for i in range(1, 16)], "leaf")
    topo = topology(spark, nodes, [(f"n{i // 2}", f"n{i}") for i in range(2, 16)])
    rows = [(h, f"{h} {w}", 3, i, w) for w, hosts in {"a": ["n8", "n9", "n3"], "b": ["n2", "n8", "n5", "n15"]}.items() for i, h in enumerate(hosts)]
    got = {(x.domain, x.root_cause_node): x.secondary_nodes for x in INF.simple_roots(windowed(spark, rows), topo).collect()}
    assert got == {("a", "n8"): [], ("a", "n9"): [], ("a", "n3"): [], ("b", "n2"): ["n5", "n8"], ("b", "n15"): []}
    assert stored_frames["met"].columns == ["place"] and stored_frames["met"].count() == 1


def test_only_pairs_with_active_or_wide_ancestors_are_stored(spark, monkeypatch):
    """Ten chains of 20 silent nodes, of which five windows see a leaf each: no table of a run holds all ancestors of its hosts."""
    stored_rows = {}

    def counted(df, name="step"):
        out = materialize(df, name)
        stored_rows[name] = out.count()
        return out

    monkeypatch.setattr(INF, "materialize", counted)
    monkeypatch.setattr(closure, "materialize", counted)
    edges = [(f"c{k}-{i}", f"c{k}-{i + 1}") for k in range(10) for i in range(20)]
    topo = topology(spark, dict.fromkeys([n for e in edges for n in e], "leaf"), edges)
    physical = materialize(closure.physical_closure(topo.nodes, topo.edges))
    stored_rows.clear()
    rows = [(f"c{k}-20", "line", 3, k, f"w{w}") for w in range(5) for k in range(10)]
    got = INF.assign_hosts(windowed(spark, rows), topo, physical=physical).collect()
    assert len(got) == 50 and {(r.kind_no, r.root_cause_node == r.hostname) for r in got} == {(INF.REGULAR, True)}
    stored_rows.pop("sized")  # depends on the topology alone
    assert max(stored_rows.values()) == 50

    few = [(f"c{k}-{i}", "line", 3, k, "w") for k in range(2) for i in (19, 20)]
    hosts = INF.host_stats(windowed(spark, few))
    wide = INF._wide_ancestors(hosts, physical, 4.5)  # 18 hosts are needed: nodes 0 to 2 of a chain have as many below them
    assert {r.ancestor for r in wide.collect()} == {f"c{k}-{i}" for k in range(2) for i in range(3)}
