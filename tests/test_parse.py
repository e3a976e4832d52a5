from alarmlens import schema
from alarmlens.functions.parse import event_parts, parse_syslog, parse_tagged
from alarmlens.operators.filters import drop_ignored
from alarmlens.sources.patterns import effective_patterns, literal_patterns
from tests.helpers import T0, at

CASES = [
    # raw, sender, host, facility, severity, event, recovery, format
    ("<11>Mar 02 23:59:59 pe7.lon %IFMGR-4-LOWLIGHT: xe-1/2 optical power low", "203.0.113.8",
     "pe7.lon", 1, 3, "%IFMGR-4-LOWLIGHT", False, "rfc3164"),
    ("<0>Dec 31 00:00:01 tor-b crond: nightly job began", "198.51.100.4",
     "tor-b", 0, 0, None, False, "rfc3164"),
    ("<191>1 2025-03-02T04:05:06Z edge_3 sshd 77 M1 - session opened", "203.0.113.9",
     "edge_3", 23, 7, None, False, "rfc5424"),
    ("<78>1 2025-03-02T04:05:06Z - sshd 77 M1 - no name given", "203.0.113.10",
     "203.0.113.10", 9, 6, None, False, "rfc5424"),
    ("<13>1 2025-03-02T04:05:06Z edge_3 rpd - - - %ISIS-6-ADJCHANGE: peer lost", "203.0.113.9",
     "edge_3", 1, 5, "%ISIS-6-ADJCHANGE", False, "rfc5424"),
    ("free words without any header", "203.0.113.11", "203.0.113.11", 1, 5, None, False, "raw"),
    ("<46>Jun 30 12:30:00 203.0.113.12 998: Agg-4: %OSPF-5-ADJCHG: Process 9, Nbr 203.0.113.13 to FULL",
     "203.0.113.12", "Agg-4", 5, 6, "%OSPF-5-ADJCHG", True, "rfc3164"),
    ("<46>998: Agg-4: words", "203.0.113.12", "203.0.113.12", 1, 5, None, False, "raw"),
    ("<>Aug 15 10:00:00 r1 x", "s", "s", 1, 5, None, False, "raw"),
    ("< 34 >Aug 15 10:00:00 r1 x", "s", "r1", 4, 2, None, False, "rfc3164"),
    ("<3_4>Aug 15 10:00:00 r1 x", "s", "r1", 4, 2, None, False, "rfc3164"),
    ("<3__4>Aug 15 10:00:00 r1 x", "s", "s", 1, 5, None, False, "raw"),
    ("<abc>Aug 15 10:00:00 r1 x", "s", "s", 1, 5, None, False, "raw"),
    ("<34>1 2026-08-15T10:00:00Z r1 app -", "s", "s", 1, 5, None, False, "raw"),
    ("<34>1 2026-08-15T10:00:00Z r1 app - -", "s", "r1", 4, 2, None, False, "rfc5424"),
    ("　<34>Aug 15 10:00:00 r1 two\nlines ", "s", "r1", 4, 2, None, False, "rfc3164"),
    ("<34>Aug 15 10:00:00 router1", "s", "s", 1, 5, None, False, "raw"),
    ("<34>1 t 10.0.0.7 - - - - 12: Sw-9: up", "s", "Sw-9", 4, 2, None, False, "rfc5424"),
]


def _parsed(spark, raws, **kw):
    rows = [(raw, ip, T0, i) for i, (raw, ip) in enumerate(raws)]
    return parse_syslog(spark.createDataFrame(rows, schema.RAW_LINES), **kw).orderBy("seq").collect()


def test_lines(spark):
    got = _parsed(spark, [(c[0], c[1]) for c in CASES])
    for case, row in zip(CASES, got):
        assert (row.hostname, row.facility, row.severity, row.event_type, row.is_recovery, row.format) == case[2:], case
    assert got[5].message == "free words without any header"
    assert got[7].message == "<46>998: Agg-4: words"
    assert got[14].message == ""
    assert got[15].message == "two\nlines"


def test_header_times(spark):
    got = _parsed(spark, [(CASES[0][0], "a"), (CASES[2][0], "a"), ("plain", "a")], year=2024)
    assert str(got[0].event_ts) == "2024-03-02 23:59:59"
    assert str(got[1].event_ts) == "2025-03-02 04:05:06"
    assert got[2].event_ts is None
    tz = _parsed(spark, [(CASES[0][0], "a")], year=2024, tz="Asia/Tokyo")
    assert str(tz[0].event_ts) == "2024-03-02 14:59:59"


def test_structured_data(spark):
    raw = '<34>1 2026-08-15T10:00:00Z r1 app 1 ID [x a="1 2"][y] the text'
    assert _parsed(spark, [(raw, "s")])[0].message != "the text"
    assert _parsed(spark, [(raw, "s")], strict_sd=True)[0].message == "the text"


def test_recovery_texts(spark):
    texts = {
        "changed state to up": True,
        "CHANGED  state to UP.": True,
        "changed state to upper": False,
        "%BGP-5-ADJCHANGE: neighbor 10.0.0.1 Up": True,
        "%OSPF-5-ADJCHG: Process 1, Nbr 10.0.0.2 to FULL": True,
        "%ISIS-5-ADJCHANGE: x UP": True,
        "%SYS-5-RESTART: again": True,
        "changed state to down": False,
        "%BGP-5-ADJCHANGE: neighbor 10.0.0.1 Down": False,
        "%BGP-5-ADJCHANGE: a\nUp": False,
    }
    got = _parsed(spark, [(t, "s") for t in texts])
    assert [r.is_recovery for r in got] == list(texts.values())


def test_tagged_lines_and_event_parts(spark):
    lines = spark.createDataFrame(
        [("Host:Core1 %LINK-3-UPDOWN: down", "s", T0, 0), ("Host:X", "s", T0, 1)], schema.RAW_LINES
    )
    got = parse_tagged(lines).orderBy("seq").collect()
    assert (got[0].hostname, got[0].message, got[0].event_type) == ("Core1", "%LINK-3-UPDOWN: down", "%LINK-3-UPDOWN")
    assert (got[1].hostname, got[1].message) == ("X", "")
    parts = parse_tagged(lines).orderBy("seq").select(event_parts("event_type").alias("p")).first().p
    assert (parts.facility, parts.severity, parts.mnemonic) == ("LINK", 3, "UPDOWN")


def test_ignore_filter(spark, tmp_path):
    path = tmp_path / "ignore.txt"
    path.write_text("# note\n\n  %SYS-5-CONFIG_I \n%LINK-2-INTVULN\n")
    patterns = effective_patterns(spark, str(path), ["%X-1-Y", ""])
    assert sorted(r.pattern for r in patterns.collect()) == [
        "%LINK-2-INTVULN", "%LINK-2-INTVULN", "%SYS-5-CONFIG_I", "%X-1-Y",
    ]
    assert effective_patterns(spark, include_defaults=False).count() == 0
    messages = spark.createDataFrame(
        [("a %SYS-5-CONFIG_I b",), ("%sys-5-config_i",), ("%LINK-2-INTVULN",), ("keep",)], "message string"
    )
    assert sorted(r.message for r in drop_ignored(messages, patterns).collect()) == ["%sys-5-config_i", "keep"]


def test_many_ignore_patterns(spark):
    words = literal_patterns(spark, [f"<{i}>" for i in range(300)])
    messages = spark.createDataFrame([(f"x<{i}>y",) for i in range(0, 600, 7)], "message string")
    kept = {r.message for r in drop_ignored(messages, words).collect()}
    assert kept == {f"x<{i}>y" for i in range(0, 600, 7) if i >= 300}


def test_read_lines(spark, tmp_path):
    from alarmlens.sources.lines import read_lines

    path = tmp_path / "a.log"
    path.write_bytes("<34>Aug 15 10:00:00 r1 one\n\n   \n<34>Aug 15 10:00:01 r2 twö\n".encode() + b"bad \xff byte\n")
    rows = parse_syslog(read_lines(spark, str(path), received_at=at(0))).orderBy("seq").collect()
    assert [r.hostname for r in rows] == ["r1", "r2", "file"]
    assert rows[2].message == "bad � byte"
    assert rows[0].source_ip == "file"


def test_filters_do_not_pull_the_parser_apart(spark):
    """A filter above the parser leaves its expressions where they are, once each; null messages stay."""
    rows = [("<11>Mar 02 23:59:59 pe7 noise zz1 here", "a", T0, 0), (None, "a", T0, 1), ("<11>Mar 02 23:59:59 pe7 kept", "a", T0, 2)]
    parsed = parse_syslog(spark.createDataFrame(rows, schema.RAW_LINES))

    def patterns_in_plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString().lower().count("regexp_")

    for n in (2, 90):
        wanted = spark.createDataFrame([(f"zz{i}",) for i in range(n)], "pattern string")
        kept = drop_ignored(parsed, wanted)
        assert patterns_in_plan(kept) == patterns_in_plan(parsed)
        assert sorted(r.seq for r in kept.collect()) == [1, 2]
