import json
import random

import pytest
from pyspark.sql import functions as F

from alarmlens import schema
from alarmlens.functions.parse import parse_syslog
from alarmlens.operators import incidents as tables
from alarmlens.operators.topology import save_version
from alarmlens.plans.pipeline import run_batch
from alarmlens.sources.lines import stream_datagrams, stream_lines, with_arrival_order
from alarmlens.streaming.live import LiveJob, count_received, session_counts, tumbling_hosts
from tests.helpers import SITE_EDGES, SITE_NODES, at, topology

DOWN = "%LINK-3-UPDOWN: Interface GE0/0, changed state to down"
UP = "%LINK-3-UPDOWN: Interface GE0/0, changed state to up"


def _line(host, text, sec, seq):
    return {"raw": f"<187>Aug 17 10:00:00 {host} {text}", "source_ip": "10.0.0.1",
            "received_at": at(sec).isoformat(), "seq": seq}


ROWS = [
    _line("hub", DOWN, 0, 0), _line("mid-w", DOWN, 4, 1), _line("end-w1", DOWN, 30, 2),
    _line("gate", DOWN, 31, 3), _line("hub", UP, 45, 4),
    _line("gate-cpe", DOWN, 61, 5), _line("hub", DOWN, 70, 6), _line("gate", UP, 95, 7),
    _line("end-w1", DOWN, 110, 8),
]
KEEP = ["domain", "window_start", "emit_rank", "incident_id", "root_cause_node", "secondary_nodes",
        "raw_logs", "condition", "recurrence_count"]


@pytest.fixture()
def job(spark, tmp_path):
    topo = topology(spark, SITE_NODES, SITE_EDGES)
    save_version(topo, str(tmp_path / "topo"), 1)
    return LiveJob(spark, str(tmp_path / "state"), str(tmp_path / "table"), str(tmp_path / "topo"))


def _run(spark, job, tmp_path, batches):
    """One input file and one run of the query per batch, so every batch starts from the checkpoint."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        query = job.start(
            stream_datagrams(spark, str(folder)), str(tmp_path / "ckpt"), availableNow=True
        )
        query.awaitTermination()
    return len(batches) - 1


def test_stream_equals_batch_and_survives_replay(spark, job, tmp_path):
    late = _line("mid-w", DOWN, 12, 99)
    last = _run(spark, job, tmp_path, [ROWS[:5], [late, *ROWS[5:]]])
    # The same micro-batch again, as after a failure.
    lines = spark.createDataFrame(
        [(r["raw"], r["source_ip"], at(s), r["seq"]) for r, s in zip([late, *ROWS[5:]], (12, 61, 70, 95, 110))],
        schema.RAW_LINES,
    )
    before = sorted(map(str, job.feed().collect()))
    job.process(lines, last)
    assert sorted(map(str, job.feed().collect())) == before
    job.drain(last)
    every = spark.createDataFrame(
        [(r["raw"], r["source_ip"], at(s), r["seq"])
         for r, s in zip(ROWS, (0, 4, 30, 31, 45, 61, 70, 95, 110))], schema.RAW_LINES
    )
    expected = run_batch(every, job._topology()[0], time_col="received_at", apply_recovery=True)
    got = tables.read_incidents(spark, job.table_path)
    order = ["window_start", "emit_rank"]
    a = [r.asDict() for r in got.select(KEEP).orderBy(order).collect()]
    b = [r.asDict() for r in expected.select(KEEP).orderBy(order).collect()]
    assert a == b
    assert [r["condition"] for r in b] == ["RECOVERED", "RECOVERED", "ACTIVE", "ACTIVE", "ACTIVE"][: len(b)]
    assert [r.seq for r in job.late_rows().collect()] == [99]
    feed = job.feed()
    assert {r.type for r in feed.select("type").distinct().collect()} == {"incident.new", "incident.recovered"}


def test_native_stream_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [_line("A", DOWN, s, i) for i, s in enumerate((0, 30, 61, 61.5, 500))]
    (folder / "0.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    stream = parse_syslog(count_received(stream_datagrams(spark, str(folder))))
    for name, df in (("sess", session_counts(stream, 30)), ("tumb", tumbling_hosts(stream, 10))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    sessions = spark.table("sess").orderBy("window_start").collect()
    assert [(s.window_start, s.n) for s in sessions] == [
        (at(0).replace(tzinfo=None), 2), (at(61).replace(tzinfo=None), 2)
    ]
    assert spark.table("tumb").agg(F.sum("n").alias("n")).first().n == 4


def test_text_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(r["raw"] for r in ROWS) + "\n\n")
    seen = []

    def keep(df, batch):
        parsed = parse_syslog(with_arrival_order(df))
        seen.extend((r.hostname, r.seq) for r in parsed.orderBy("received_at", "seq").collect())

    lines = stream_lines(spark, str(folder), max_files_per_trigger=1)
    query = lines.writeStream.foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [h for h, _ in seen] == [r["raw"].split()[3] for r in ROWS]
    assert len({s for _, s in seen}) == len(ROWS)
    plain = parse_syslog(stream_lines(spark, str(folder)))
    query = plain.writeStream.format("memory").queryName("plain").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("plain").count() == len(ROWS)


def test_upkeep(spark, tmp_path):
    from alarmlens.streaming.live import nightly_upkeep

    path = str(tmp_path / "table")
    row = ("i1", at(0), "A", "e", [], 1, ["l"], "CLOSED", "ACTIVE", 0, "d", at(0), "regular", 1)
    tables.save(spark, path, spark.createDataFrame([row], schema.INCIDENTS))
    cache = spark.createDataFrame([("f", "r", at(0))], schema.REPORT_CACHE)
    removed, live = nightly_upkeep(spark, path, F.lit(at(91 * 86400)), cache=cache)
    assert removed == 1 and live.count() == 0
    assert nightly_upkeep(spark, path, F.lit(at(0)))[0] == 0


def test_event_time_lines_without_header_time_go_by_arrival(spark, job):
    job.time_col, job.year = "event_ts", 2026
    raws = ["<11>Aug 17 10:00:01 hub %A-3-B: one", "no header at all"]
    lines = spark.createDataFrame([(r, "hub", at(2 + i), i) for i, r in enumerate(raws)], schema.RAW_LINES)
    job.process(lines, 0)
    assert job._read_state("pending", 0).count() == 2 and job.late_rows() is None


def test_closed_incidents_stay_closed_on_replay(spark, job):

    rows = [(r["raw"], r["source_ip"], at(s), r["seq"]) for r, s in zip(ROWS[:3], (0, 4, 200))]
    lines = spark.createDataFrame(rows, schema.RAW_LINES)
    job.process(lines, 0)
    table = tables.read_incidents(spark, job.table_path)
    n = table.count()
    closed = table.withColumn("status", F.lit("CLOSED"))
    tables.save(spark, job.table_path, closed)
    job.process(lines, 0)
    assert [r.status for r in tables.read_incidents(spark, job.table_path).collect()] == ["CLOSED"] * n


def test_a_fast_domain_does_not_settle_a_slow_one(spark, job):
    messages = [("fast", 0, 0), ("fast", 500, 1), ("slow", 1, 2)]
    fresh = parse_syslog(
        spark.createDataFrame(
            [(d, ROWS[0]["raw"], "hub", at(s), n) for d, s, n in messages],
            "domain string, raw string, source_ip string, received_at timestamp, seq bigint",
        )
    )
    job.settle(fresh, 0)
    assert sorted((r.domain, r.seq) for r in job._read_state("pending", 0).collect()) == [("fast", 1), ("slow", 2)]


def test_overflow_and_stored_logs(spark, job, tmp_path):
    """Two rows of a window take part and one log is kept; the other rows are in the side table."""
    job.max_size, job.stored_logs = 2, 1
    job.drain(_run(spark, job, tmp_path, [ROWS]))
    table = tables.read_incidents(spark, job.table_path).collect()
    assert table and all(len(r.raw_logs) == 1 for r in table)
    kept = sum(r.raw_log_count for r in table)
    dropped = job.overflow_rows()
    assert dropped.count() > 0 and kept + dropped.filter("not is_recovery").count() <= len(ROWS)
    assert dropped.select("domain", "window_start", "seq").distinct().count() == dropped.count()


@pytest.mark.parametrize("window", ["anchored", "session"])
def test_late_messages_reopen_their_windows(spark, job, window):
    """Messages out of order over four micro-batches: the table equals the batch result, and the feed tells how it came to be."""
    job.window, job.reopen_sec, job.window_sec = window, 10_000, 60
    draw = random.Random(5)
    hosts = ["hub", "mid-w", "end-w1", "gate", "gate-cpe"]
    rows = [
        (_line(draw.choice(hosts), draw.choice([DOWN, DOWN, UP]), 0, n)["raw"], "10.0.0.1", at(draw.randrange(0, 1500) if n < 40 else 1500 + n), n)
        for n in range(44)
    ]
    rows.sort(key=lambda r: r[2])
    place = [min(3, k * 4 // len(rows) + draw.choice([0, 0, 0, 1, 2])) for k in range(len(rows))]
    batches = [spark.createDataFrame([r for r, p in zip(rows, place) if p == b], schema.RAW_LINES) for b in range(4)]
    for number, lines in enumerate(batches):
        job.process(lines, number)
    before = sorted(map(str, job.feed().collect()))
    job.process(batches[3], 3)  # replayed
    assert sorted(map(str, job.feed().collect())) == before
    job.drain(3)
    expected = run_batch(
        spark.createDataFrame(rows, schema.RAW_LINES), job._topology()[0], time_col="received_at", apply_recovery=True, window=window, window_sec=60
    )
    keep = ["domain", "window_start", "window_end", "emit_rank", "kind", "root_cause_node", "secondary_nodes", "raw_logs", "raw_log_count", "condition"]
    got = tables.read_incidents(spark, job.table_path)
    assert sorted(map(str, got.select(keep).collect())) == sorted(map(str, expected.select(keep).collect()))
    assert got.select("incident_id").distinct().count() == got.count()
    assert job.late_rows() is None or job.late_rows().count() == 0
    ids = {kind: set() for kind in ("new", "recovered", "changed", "withdrawn")}
    for r in job.feed().collect():
        ids[r.type.split(".")[1]].add(r.incident_id)
    assert ids["withdrawn"] and ids["changed"]
    assert ids["new"] - ids["withdrawn"] == {r.incident_id for r in got.collect()}


def test_reopening_ends_at_its_reach_and_keeps_closures(spark, job):
    job.reopen_sec = 100
    frame = lambda rows: spark.createDataFrame([(r["raw"], r["source_ip"], at(s), n) for n, (r, s) in enumerate(rows)], schema.RAW_LINES)
    hub, end = ROWS[0], ROWS[2]
    job.process(frame([(hub, 0), (hub, 1), (end, 500), (end, 900)]), 0)
    table = tables.read_incidents(spark, job.table_path)
    assert table.count() == 2
    tables.save(spark, job.table_path, table.withColumn("status", F.lit("CLOSED")))
    job.process(frame([(hub, 2), (end, 505)]).withColumn("seq", F.col("seq") + 10), 1)
    assert [r.seq for r in job.late_rows().collect()] == [10]  # beyond the reach
    by_root = {r.root_cause_node: r for r in tables.read_incidents(spark, job.table_path).collect()}
    assert by_root["end-w1"].raw_log_count == 2 and by_root["hub"].raw_log_count == 2
    assert {r.status for r in by_root.values()} == {"CLOSED"}
    job.process(frame([(end, 2000)]).withColumn("seq", F.col("seq") + 20), 2)
    job.process(frame([(end, 3000)]).withColumn("seq", F.col("seq") + 30), 3)
    assert {r["batch"] for r in tables.read_table(spark, f"{job.state_path}/archive").select("batch").distinct().collect()} == {2, 3}
