import datetime as dt
import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from alarmlens import schema
from alarmlens.functions.texts import fingerprint, json_ascii
from alarmlens.operators import incidents as I
from alarmlens.operators.ranking import global_row_number
from alarmlens.operators.similar import nearest, text_vectors
from alarmlens.plans import payloads as PL
from alarmlens.plans import reports as R
from tests.helpers import at

DAY0 = dt.datetime(2026, 8, 16, 10, tzinfo=dt.timezone.utc)


def rows(spark, specs):
    """specs: (id, hours after DAY0, root, overrides)."""
    out = []
    for n, (iid, hours, root, extra) in enumerate(specs):
        when = DAY0 + dt.timedelta(hours=hours)
        row = dict(
            incident_id=iid, created_at=when, root_cause_node=root,
            primary_event="%OPTICS-2-LOS: no light on lane 4",
            secondary_nodes=["olt-9", "cpe-3", "cpe-1"], raw_log_count=2, raw_logs=["first words", "second words"],
            status="OPEN", condition="ACTIVE", recurrence_count=0, domain="d", window_start=when,
            kind="regular", emit_rank=n + 1,
        )
        row.update(extra)
        out.append(tuple(row.values()))
    return spark.createDataFrame(out, schema.INCIDENTS)


def ids(df):
    return [r.incident_id for r in df.collect()]


def test_list_close_upsert_purge(spark):
    table = rows(spark, [("a", -2, "X", {}), ("b", 0, "X", {"status": "CLOSED"}), ("c", 2, "Y", {"condition": "FLAPPING"})])
    assert ids(I.list_incidents(table)) == ["c", "b", "a"]
    assert ids(I.list_incidents(table, status="CLOSED")) == ["b"]
    assert ids(I.list_incidents(table, condition="FLAPPING")) == ["c"]
    assert ids(I.list_incidents(table, from_dt="2026-08-16 09:00:00", to_dt="2026-08-16 11:00:00")) == ["b"]
    assert ids(I.list_incidents(table, from_dt="2026-08-16 08:00:00", to_dt="2026-08-16 10:00:00")) == ["b", "a"]
    closures = spark.createDataFrame([("a",), ("zz",)], "incident_id string")
    assert {r.incident_id: r.status for r in I.close(table, closures).collect()} == {"a": "CLOSED", "b": "CLOSED", "c": "OPEN"}
    assert ids(I.unmatched_closures(table, closures)) == ["zz"]
    update = rows(spark, [("a", -2, "X", {"raw_logs": [str(i) for i in range(250)], "raw_log_count": 250}), ("n", 5, "X", {})])
    merged = {r.incident_id: r for r in I.upsert(table, update).collect()}
    assert set(merged) == {"a", "b", "c", "n"}
    assert len(merged["a"].raw_logs) == 200 and merged["a"].raw_log_count == 250
    as_of = F.lit(DAY0 + dt.timedelta(days=90))
    kept = I.purge_closed(rows(spark, [
        ("old", -1, "X", {"status": "CLOSED"}), ("edge", 0, "X", {"status": "CLOSED"}), ("open", -50, "X", {})]), as_of)
    assert sorted(ids(kept)) == ["edge", "open"]
    bare = table.drop("raw_logs", "recurrence_count", "condition")
    first = I.with_added_columns(bare).first()
    assert (first.raw_logs, first.recurrence_count, first.condition) == ([], 0, "ACTIVE")
    assert I.get_by_id(table, "b").count() == 1
    requests = spark.createDataFrame([("r", ["c", "zz", "a", "c"])], "request_id string, ids array<string>")
    assert ids(I.by_ids(table, requests)) == ["c", "a", "c"]


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    I.save(spark, path, rows(spark, [("a", 0, "X", {"status": "CLOSED"}), ("b", 48, "X", {})]))
    I.save(spark, path, rows(spark, [("b", 48, "X", {"status": "CLOSED"}), ("c", 49, "Y", {})]))
    table = I.read_incidents(spark, path)
    assert {r.incident_id: r.status for r in table.collect()} == {"a": "CLOSED", "b": "CLOSED", "c": "OPEN"}
    # A moved row leaves its old day, which is then empty.
    I.save(spark, path, rows(spark, [("a", 49, "X", {"status": "CLOSED"})]))
    assert I.read_incidents(spark, path).filter("incident_id = 'a'").count() == 1
    assert I.purge(spark, path, F.lit(DAY0 + dt.timedelta(days=93))) == 2
    assert ids(I.read_incidents(spark, path)) == ["c"]
    assert I.read_incidents(spark, str(tmp_path / "none")) is None


def test_commits_are_whole_and_never_replace_one_another(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    I.save(spark, path, rows(spark, [("a", 0, "X", {})]))
    # A writer that ends before its version file exists leaves folders that nobody reads.
    monkeypatch.setattr(I, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        I.save(spark, path, rows(spark, [("b", 0, "X", {})]))
    monkeypatch.undo()
    assert ids(I.read_incidents(spark, path)) == ["a"]
    # Two writers start from one version: the later one is told, and has changed nothing.
    stale = I._version(spark, path)
    I.save(spark, path, rows(spark, [("c", 1, "Y", {})]))
    monkeypatch.setattr(I, "_version", lambda *_: stale)
    with pytest.raises(I.CommitConflict):
        I.save(spark, path, rows(spark, [("d", 1, "Y", {})]))
    monkeypatch.undo()
    assert sorted(ids(I.read_incidents(spark, path))) == ["a", "c"]
    assert ids(I.read_incidents(spark, path, {"1999-01-01"})) == []


def test_stored_logs_are_a_parameter(spark, tmp_path):
    path = str(tmp_path / "t")
    many = rows(spark, [("a", 0, "X", {"raw_logs": [str(i) for i in range(300)]})])
    I.save(spark, path, many)
    assert len(I.read_incidents(spark, path).first().raw_logs) == 200
    I.save(spark, path, many, stored_logs=None)
    assert len(I.read_incidents(spark, path).first().raw_logs) == 300


def test_numbering_and_recurrence(spark):
    stored = rows(spark, [("INC-20260816-007", 0, "X", {}), ("INC-20260816-002", 1, "Y", {})])
    new = rows(spark, [
        ("", 2, "X", {}), ("", 2, "Z", {}), ("", 3, "X", {}), ("", 24, "X", {}), ("", 1, "Y", {"emit_rank": 2}),
    ]).drop("incident_id", "created_at", "recurrence_count").withColumn("window_end", F.col("window_start"))
    got = [(r.incident_id, r.root_cause_node, r.recurrence_count)
           for r in I.number_incidents(new, stored).orderBy("window_start", "emit_rank").collect()]
    assert got == [
        ("INC-20260816-002", "Y", 0), ("INC-20260816-008", "X", 1), ("INC-20260816-009", "Z", 0),
        ("INC-20260816-010", "X", 2), ("INC-20260817-001", "X", 3),
    ]


def test_rank_of_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.8 else f"g{rng.randint(0, 5)}", x) for x in rng.sample(range(10_000), 1500)]
    frame = spark.createDataFrame(data, "g string, v int").repartition(6)
    got = {(r.g, r.v): r.n for r in global_row_number(frame, ["g"], ["v"], "n").collect()}
    for g in {g for g, _ in data}:
        for n, v in enumerate(sorted(v for h, v in data if h == g), 1):
            assert got[(g, v)] == n


def test_recovery_is_as_of(spark):
    table = rows(spark, [
        ("a", 0, "X", {}), ("b", 30, "X", {"condition": "FLAPPING"}), ("c", 100, "X", {}), ("d", 0, "Y", {}),
        ("e", 0, "X", {"status": "CLOSED"}), ("f", 0, "X", {"domain": "other"}),
    ])
    recoveries = spark.createDataFrame(
        [("d", "X", DAY0 + dt.timedelta(hours=h)) for h in (-5, 3, 75)], "domain string, hostname string, window_start timestamp")
    got = {r.incident_id: (r.condition, r.recovered_window) for r in I.recover(table, recoveries).collect()}
    when = lambda h: (DAY0 + dt.timedelta(hours=h)).replace(tzinfo=None)
    assert got["a"] == ("RECOVERED", when(3)) and got["b"] == ("RECOVERED", when(75))
    assert got["c"] == ("ACTIVE", None) and got["d"] == ("ACTIVE", None)
    assert got["e"] == ("ACTIVE", None) and got["f"] == ("ACTIVE", None)
    same = spark.createDataFrame([("d", "Y", DAY0)], "domain string, hostname string, window_start timestamp")
    assert {r.incident_id: r.condition for r in I.recover(table, same).collect()}["d"] == "RECOVERED"


def test_similar_by_root(spark):
    table = rows(spark, [(f"i{n}", n, "X", {}) for n in range(8)] + [("solo", 0, "Y", {})])
    got = {}
    for r in I.similar_by_root(table).orderBy("incident_id", "rank").collect():
        got.setdefault(r.incident_id, []).append(r.similar_id)
    assert got["i0"] == ["i7", "i6", "i5", "i4", "i3"] and got["i7"] == ["i6", "i5", "i4", "i3", "i2"]
    assert "solo" not in got


def test_fingerprint_is_the_sorted_json_hash(spark):
    cases = [
        ("Core", "%LINK-3-UPDOWN: Gi0/0 down", ["b", "a"]), ("Core", "%LINK-3-UPDOWN: Gi0/1 down", ["a", "b"]),
        ("ルータ\"1\\", "no token", ["é", "tab\t", "😀"]), ("Core", "%L2-3-X9 %AB-3-CD", []), ("\x7f\x01\x1f", "x", ["/"]),
    ]
    frame = spark.createDataFrame(cases, "rc string, ev string, sn array<string>")
    got = [r.fp for r in frame.select(fingerprint(F.col("rc"), F.col("ev"), F.col("sn")).alias("fp")).collect()]
    token = {0: "%LINK-3-UPDOWN", 1: "%LINK-3-UPDOWN", 3: "%AB-3-CD"}
    for i, (rc, _, sn) in enumerate(cases):
        text = json.dumps({"rc": rc, "et": token.get(i, ""), "sn": sorted(sn)}, sort_keys=True)
        assert got[i] == hashlib.sha256(text.encode()).hexdigest(), i
    assert got[0] == got[1]
    assert frame.select(json_ascii(F.col("rc")).alias("j")).collect()[2].j == json.dumps(cases[2][0])


def test_report_worklist(spark):
    table = rows(spark, [("a", 0, "X", {}), ("b", 0, "Y", {}), ("c", 1, "Z", {"secondary_nodes": []})])
    prints = {r.incident_id: r.fingerprint for r in R.with_fingerprint(table).collect()}
    cache = spark.createDataFrame(
        [(prints["a"], "cached text", DAY0), (prints["b"], "stale", DAY0 - dt.timedelta(days=7, seconds=1))], schema.REPORT_CACHE)
    similar = spark.createDataFrame([("b", ["doc one", "doc two"])], "incident_id string, similar_docs array<string>")
    got = {r.incident_id: r for r in R.report_worklist(table, cache, F.lit(DAY0), similar=similar).collect()}
    assert (got["a"].state, got["a"].report, got["a"].prompt) == ("cached", "cached text", None)
    assert "doc one\n---\ndoc two" in got["b"].prompt and "過去の類似" in got["b"].prompt
    assert "過去の類似" not in got["c"].prompt and "二次影響ノード:" not in got["c"].prompt
    assert "- インシデントID: c\n- 根本原因ノード: Z" in got["c"].prompt

    @F.pandas_udf("string")
    def ask(prompt: pd.Series) -> pd.Series:
        return prompt.str.len().astype(str)

    answers = R.answer_prompts(R.report_worklist(table, cache, F.lit(DAY0)), ask).withColumn("created_at", F.lit(DAY0))
    after = R.cache_put(cache, answers)
    assert after.count() == 3
    assert {r.fingerprint for r in R.cache_purge(after, F.lit(DAY0)).collect()} == set(prints.values())
    docs = R.incident_documents(table)
    assert docs.filter("incident_id = 'c'").first().document == (
        "RootCause: Z\nPrimaryEvent: %OPTICS-2-LOS: no light on lane 4\nLog: first words\nLog: second words")
    vectors = text_vectors(docs, dims=64)
    empty = "incident_id string, document string, root_cause string, created_at timestamp, embedding array<float>"
    corpus = R.corpus_put(spark.createDataFrame([], empty), table, vectors)
    assert corpus.count() == 3
    found = R.similar_documents(vectors, corpus, 1).collect()
    assert len(found) == 3 and all(len(r.similar_docs) == 1 for r in found)
    assert {r.source for r in R.similar_incidents(table, vectors).collect()} == {"rag"}
    assert R.similar_incidents(table).count() == 0


def test_nearest_in_blocks_is_exact(spark):
    rng = random.Random(8)
    data = [(i, [float(rng.randint(0, 9)) for _ in range(4)]) for i in range(120)]
    frame = spark.createDataFrame(data, "id bigint, embedding array<float>")
    got = {}
    for r in nearest(frame, frame, 3, block_rows=25).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    for i, v in data:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in data if j != i)[:3]
        assert got[i] == [j for _, j in want]


def test_payloads(spark):
    table = rows(spark, [
        ("INC-20260816-001", 0, "olt-7", {}),
        ("INC-20260816-002", 0, "Leaf", {"secondary_nodes": [], "condition": "FLAPPING"}),
        ("INC-20260816-003", 0, "Leaf", {"recurrence_count": 2, "status": "CLOSED"}),
    ])
    load = lambda df: {r.incident_id: json.loads(r.payload) for r in df.collect()}
    hook = load(PL.webhook_payloads(table))["INC-20260816-001"]
    assert hook == {
        "incident_id": "INC-20260816-001", "root_cause": "olt-7",
        "primary_event": "%OPTICS-2-LOS: no light on lane 4", "secondary_affected_count": 3,
        "secondary_nodes": ["olt-9", "cpe-3", "cpe-1"], "raw_log_count": 2, "created_at": "2026-08-16T10:00:00+00:00",
    }
    slack = load(PL.slack_payloads(table))
    blocks = slack["INC-20260816-002"]["blocks"]
    assert blocks[0]["text"]["text"].endswith("INC-20260816-002")
    assert blocks[1]["fields"][0]["text"] == "*根本原因:*\nLeaf" and blocks[2]["text"]["text"].endswith("なし")
    alert = load(PL.alert_payloads(table, "net"))
    assert [alert[k]["priority"] for k in sorted(alert)] == ["P3", "P2", "P2"]
    assert alert["INC-20260816-003"]["description"].endswith(" / 再発: 2回")
    assert load(PL.alert_payloads(table, strict=True))["INC-20260816-002"]["priority"] == "P3"
    feed = PL.event_feed(table, table.limit(1)).collect()
    assert len(feed) == 4 and set(json.loads(feed[0].event)["incident"]) == set(PL.PUBLIC_COLUMNS)
    block = PL.text_blocks(table.filter("root_cause_node = 'olt-7'")).first().value
    assert block.split("\n")[3] == "  Secondary   : olt-9, cpe-3, cpe-1" and "  Logs        : 2" in block
    assert "Secondary" not in PL.text_blocks(table.filter("size(secondary_nodes) = 0")).first().value
    assert {r.badge for r in PL.with_badge(table).collect()} == {"新規発生", "フラッピング", "復旧済"}
    assert PL.json_lines(table).columns == PL.LINE_COLUMNS and len(PL.LINE_COLUMNS) == 8
