"""The registered queries and, where SQL can express them, the matching DuckDB text.

Inputs that several queries share (parsed messages, windows, topology, incidents) are
stored once per session and data folder and reread by each query.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.functions import parse as P
from alarmlens.functions import texts
from alarmlens.operators import closure as C
from alarmlens.operators import filters as FL
from alarmlens.operators import incidents as I
from alarmlens.operators import topology as T
from alarmlens.operators import windows as WN
from alarmlens.operators.similar import nearest
from alarmlens.plans import infer as INF
from alarmlens.plans import payloads as PL
from alarmlens.plans import pipeline as PIPE
from alarmlens.plans import reports as R
from alarmlens.runtime import materialize
from alarmlens.sources.lines import payload_lines
from alarmlens.sources.patterns import literal_patterns
from alarmlens.sources.topology_docs import from_column
from workload import inputs
from workload import oracle_parts as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

W_SEC = 600
W_US = W_SEC * 1_000_000
RULES = INF.Rules(flapping_threshold=2)
AS_OF = "2024-02-15 00:00:00"
IGNORED = ("%LINK-2-INTVULN", "%SYS-5-CONFIG_I", "vty1", "Gi0/7,")

_STORED: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def messages(spark, d):
    return _once(spark, d, "messages", lambda: materialize(inputs.messages(spark, d), "messages"))


def windowed(spark, d):
    return _once(
        spark, d, "windowed", lambda: materialize(WN.anchored_windows(messages(spark, d), W_SEC), "windowed")
    )


def evidence(spark, d):
    return FL.drop_recoveries(windowed(spark, d))


def topology(spark, d):
    return _once(spark, d, "topology", lambda: inputs.topology(spark, d))


def physical(spark, d):
    topo = topology(spark, d)
    return _once(spark, d, "physical", lambda: C.physical_closure(topo.nodes, topo.edges))


def assigned(spark, d):
    return _once(
        spark,
        d,
        "assigned",
        lambda: materialize(
            INF.assign_hosts(evidence(spark, d), topology(spark, d), RULES, physical=physical(spark, d)),
            "assigned",
        ),
    )


def incidents(spark, d):
    """Numbered incidents of the whole log, with a deterministic mix of closed ones."""

    def build():
        found, logs = INF.infer_parts(
            windowed(spark, d), topology(spark, d), RULES, physical=physical(spark, d)
        )
        numbered = I.number_incidents(materialize(found, "found")).join(logs, INF.LOG_KEY)
        closed = F.pmod(F.regexp_extract("incident_id", I.ID_PATTERN, 2).cast("int"), F.lit(3)) == 0
        return materialize(numbered.withColumn("status", F.when(closed, "CLOSED").otherwise("OPEN")), "incidents")

    return _once(spark, d, "incidents", build)


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


TOPO = O.topology()
INPUT = (O.BASE, O.MSGS, TOPO)
WINDOWED = (*INPUT, O.windowed(W_US))
HOSTS = (*WINDOWED, O.hosts(RULES.flapping_threshold), O.closure(), O.candidates())
FULL = (*HOSTS, O.incidents())
TABLE = (
    *FULL,
    O.NUMBERED,
    O.LOGS,
    """
tab AS (
  SELECT * REPLACE (CASE WHEN CAST(regexp_extract(incident_id, '-(\\d+)$', 1) AS INT) % 3 = 0
                         THEN 'CLOSED' ELSE 'OPEN' END AS status) FROM full_inc
)""",
)
us = F.unix_micros


# --- parsing and filters -------------------------------------------------------------------


@register(
    "parse_lines",
    O.query(
        f"""SELECT seq, hostname, CAST(CASE WHEN format = 'raw' THEN 1 ELSE pri >> 3 END AS INTEGER) AS facility,
        CAST(CASE WHEN format = 'raw' THEN 5 ELSE pri & 7 END AS INTEGER) AS severity, message,
        nullif(regexp_extract(message, '{O.TOKEN}'), '') AS event_type,
        regexp_matches(message, '{O.RECOVERY}') AS is_recovery, format, event_us FROM parsed""",
        O.BASE,
        O.LINES,
        O.PARSED,
    ),
)
def parse_lines(spark, d):
    return inputs.messages(spark, d).select(
        "seq", "hostname", "facility", "severity", "message", "event_type", "is_recovery", "format",
        us("event_ts").alias("event_us"),
    )


@register(
    "event_tokens",
    O.query(
        """SELECT facility, CAST(sev AS INTEGER) AS severity, mnemonic, routing, count(*) AS n FROM (
        SELECT nullif(regexp_extract(event_type, '%(\\w+)-(\\d)-(\\w+)', 1), '') AS facility,
               nullif(regexp_extract(event_type, '%(\\w+)-(\\d)-(\\w+)', 2), '') AS sev,
               nullif(regexp_extract(event_type, '%(\\w+)-(\\d)-(\\w+)', 3), '') AS mnemonic,
               regexp_matches(message, '%BGP-|%OSPF-|%ISIS-|%EIGRP-|%RIP-') AS routing FROM msgs) GROUP BY ALL""",
        *INPUT,
    ),
)
def event_tokens(spark, d):
    parts = P.event_parts(F.col("event_type"))
    rows = messages(spark, d).select(parts.alias("p"), P.is_routing_event(F.col("message")).alias("routing"))
    return rows.groupBy("p.facility", "p.severity", "p.mnemonic", "routing").agg(F.count("*").alias("n"))


@register(
    "tagged_lines",
    O.query(
        f"""SELECT seq, dev AS hostname, body AS message,
        nullif(regexp_extract(body, '{O.TOKEN}'), '') AS event_type FROM texts""",
        O.BASE,
    ),
)
def tagged_lines(spark, d):
    parsed = messages(spark, d)
    sent = F.regexp_replace("message", r"^\d+: N\d+: ", "")
    user = inputs.events(spark, d).select(F.col("event_id").alias("seq"), "user_id")
    lines = parsed.join(user, "seq").select(
        "seq", "received_at", F.concat(F.lit("Host:N"), F.col("user_id"), F.lit(" "), sent).alias("raw")
    )
    return P.parse_tagged(lines).select("seq", "hostname", "message", "event_type")


@register(
    "payload_lines",
    O.query(
        """SELECT CAST(seq // 20 AS VARCHAR) AS payload_id, addr AS source_ip, raw,
        row_number() OVER (PARTITION BY seq // 20 ORDER BY seq) - 1 AS position FROM lines""",
        O.BASE,
        O.LINES,
    ),
)
def payload_lines_query(spark, d):
    return payload_lines(_payloads(spark, d)).select(
        F.col("domain").alias("payload_id"), "source_ip", "raw", F.col("seq").alias("position")
    )


def _payloads(spark, d):
    lines = inputs.raw_lines(spark, d)
    sent = F.array_sort(F.collect_list(F.struct("seq", "source_ip", "raw")))
    return lines.groupBy(F.floor(F.col("seq") / 20).cast("string").alias("payload_id")).agg(
        F.min("received_at").alias("received_at"),
        F.transform(sent, lambda x: F.struct(x.source_ip.alias("source_ip"), x.raw.alias("raw"))).alias("messages"),
    )


@register(
    "ignore_filter",
    O.query(
        "SELECT seq, message FROM msgs m WHERE NOT EXISTS (SELECT 1 FROM (VALUES "
        + ", ".join(f"('{p}')" for p in IGNORED)
        + ") t(p) WHERE contains(m.message, t.p))",
        *INPUT,
    ),
)
def ignore_filter(spark, d):
    return FL.drop_ignored(messages(spark, d), literal_patterns(spark, IGNORED)).select("seq", "message")


@register("parse_and_filter", ORACLES["ignore_filter"])
def parse_and_filter(spark, d):
    """Raw lines parsed and filtered in one plan, without a stored table in between."""
    parsed = P.parse_syslog(inputs.raw_lines(spark, d))
    return FL.drop_ignored(parsed, literal_patterns(spark, IGNORED)).select("seq", "message")


@register(
    "long_ignore_list",
    O.query(
        """SELECT seq, message FROM msgs m WHERE NOT EXISTS (SELECT 1 FROM
        (SELECT DISTINCT right(message, 9) AS p FROM msgs WHERE severity = 3 AND length(message) >= 9) t
        WHERE contains(m.message, t.p))""",
        *INPUT,
    ),
)
def long_ignore_list(spark, d):
    """Patterns taken from the messages themselves: too many for one predicate."""
    long = messages(spark, d).filter("severity = 3 and length(message) >= 9")
    patterns = materialize(long.select(F.expr("right(message, 9)").alias("pattern")).distinct(), "patterns")
    return FL.drop_ignored(messages(spark, d), patterns).select("seq", "message")


@register(
    "severity_counts",
    O.query(
        """SELECT severity, severity <= 5 AS active, is_recovery, count(*) AS n FROM msgs GROUP BY ALL""", *INPUT
    ),
)
def severity_counts(spark, d):
    return (
        messages(spark, d)
        .groupBy("severity", FL.is_active(5).alias("active"), "is_recovery")
        .agg(F.count("*").alias("n"))
    )


@register(
    "known_hosts",
    O.query(
        "SELECT hostname, count(*) AS n FROM msgs WHERE hostname IN (SELECT id FROM nodes) GROUP BY ALL", *INPUT
    ),
)
def known_hosts(spark, d):
    return FL.known_hosts(messages(spark, d), topology(spark, d).nodes).groupBy("hostname").agg(
        F.count("*").alias("n")
    )


@register(
    "unknown_hosts",
    O.query(
        "SELECT DISTINCT domain, hostname FROM msgs WHERE hostname NOT IN (SELECT id FROM nodes)", *INPUT
    ),
)
def unknown_hosts(spark, d):
    return FL.unknown_hosts(messages(spark, d), topology(spark, d).nodes)


@register(
    "recovery_nodes",
    O.query(
        """SELECT DISTINCT w AS window_us, hostname FROM wm
        WHERE is_recovery AND hostname IN (SELECT id FROM nodes)""",
        *WINDOWED,
    ),
)
def recovery_nodes(spark, d):
    found = FL.recovery_nodes(windowed(spark, d), topology(spark, d).nodes, INF.WINDOW)
    return found.select(us("window_start").alias("window_us"), "hostname")


# --- topology ------------------------------------------------------------------------------


@register("topology_nodes", O.query("SELECT id, role, CAST(role_priority AS INTEGER) AS role_priority FROM nodes", TOPO))
def topology_nodes(spark, d):
    return T.load_nodes(_docs(spark, d))


def _docs(spark, d, changed=False):
    return from_column(inputs.topology_documents(spark, d, changed=changed), "doc")


@register("topology_edges", O.query("SELECT * FROM edges", TOPO))
def topology_edges(spark, d):
    docs = _docs(spark, d)
    return T.load_edges(docs, T.load_nodes(docs))


@register(
    "topology_interfaces",
    O.query(
        """SELECT id AS device_id, 0 AS position, 'Gi0/0' AS interface_id,
        '10.9.0.' || (i % 250) AS ip, 'to N' || CASE WHEN i = 0 THEN -1 ELSE p END AS description FROM dev
        UNION ALL SELECT id, 1, 'Gi0/1', NULL, NULL FROM dev""",
        TOPO,
    ),
)
def topology_interfaces(spark, d):
    return T.load_interfaces(_docs(spark, d))


@register(
    "neighbors",
    O.query(
        """SELECT id, neighbor, min(side) AS side FROM (
        SELECT dst AS id, src AS neighbor, 0 AS side FROM edges UNION ALL SELECT src, dst, 1 FROM edges) GROUP BY ALL""",
        TOPO,
    ),
)
def neighbors(spark, d):
    return T.neighbors(topology(spark, d).edges)


@register(
    "device_profiles",
    O.query(
        """SELECT n.id AS device_id, '{"device_id":"' || n.id || '","role":"' || n.role || '","neighbors":[' ||
        coalesce((SELECT string_agg('"' || neighbor || '"', ',' ORDER BY side, neighbor) FROM (
            SELECT id, neighbor, min(side) AS side FROM (
            SELECT dst AS id, src AS neighbor, 0 AS side FROM edges UNION ALL SELECT src, dst, 1 FROM edges) GROUP BY ALL) b
            WHERE b.id = n.id), '') ||
        '],"interfaces":[{"id":"Gi0/0","ip":"10.9.0.' || (n.i % 250) || '","description":"to N' ||
        CASE WHEN n.i = 0 THEN -1 ELSE (n.i - 1) // 4 END ||
        '"},{"id":"Gi0/1","ip":null,"description":null}]}' AS profile FROM nodes n
        UNION ALL SELECT 'X', '{"error":"デバイス ''X'' はトポロジーに存在しません"}'""",
        TOPO,
    ),
)
def device_profiles(spark, d):
    topo = topology(spark, d)
    wanted = topo.nodes.select(F.col("id").alias("device_id")).unionAll(spark.createDataFrame([("X",)], "s string"))
    return T.device_profiles(wanted, topo, T.load_interfaces(_docs(spark, d)))


@register("closure_physical", O.query("SELECT node, ancestor FROM up", TOPO, O.closure()))
def closure_physical(spark, d):
    return C.ancestors(topology(spark, d).edges.filter("edge_type = 'physical'"))


@register(
    "closure_all_descendants",
    O.query("SELECT ancestor AS node, node AS descendant FROM up", TOPO, O.closure("true")),
)
def closure_all_descendants(spark, d):
    return C.descendants(topology(spark, d).edges)


@register(
    "conditional_ancestors",
    O.query("SELECT w AS window_us, host AS hostname, anc AS ancestor FROM reach", *WINDOWED, O.hosts(2)),
)
def conditional_ancestors(spark, d):
    topo = topology(spark, d)
    hosts = materialize(INF.host_stats(FL.known_hosts(evidence(spark, d), topo.nodes), RULES), "hosts")
    reach = C.conditional_ancestors(hosts, physical(spark, d), topo.edges, INF.WINDOW)
    return reach.select(us("window_start").alias("window_us"), "hostname", "ancestor")


@register(
    "topology_diff",
    O.query(
        """SELECT src, dst, 'added' AS change FROM edges_b WHERE (src, dst) NOT IN (SELECT src, dst FROM edges)
        UNION ALL SELECT src, dst, 'removed' FROM edges WHERE (src, dst) NOT IN (SELECT src, dst FROM edges_b)""",
        TOPO,
        O.topology(changed=True, suffix="_b"),
    ),
)
def topology_diff(spark, d):
    return T.edge_diff(topology(spark, d).edges, inputs.topology(spark, d, changed=True).edges)


@register(
    "graph_elements",
    O.query(
        """SELECT 'nodes' AS element_group, '{"data":{"id":"' || id || '","role":"' || role || '"}}' AS element FROM nodes
        UNION ALL SELECT 'edges', '{"data":{"id":"' || src || '__' || dst || '","source":"' || src || '","target":"'
        || dst || '","edge_type":"' || edge_type || '"}}' FROM edges""",
        TOPO,
    ),
)
def graph_elements(spark, d):
    return T.graph_elements(topology(spark, d))


@register(
    "reload_counts",
    O.query(
        "SELECT 'reloaded' AS status, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges",
        TOPO,
    ),
)
def reload_counts(spark, d):
    return T.reload_counts(topology(spark, d))


# --- windows -------------------------------------------------------------------------------

SITES = 3
SITE_MSGS = f"smsgs AS (SELECT * REPLACE ('site' || (u % {SITES}) AS domain) FROM msgs)"


def _site_messages(spark, d):
    return _once(
        spark, d, "sites", lambda: materialize(inputs.messages(spark, d, sites=SITES), "sites")
    )


@register(
    "anchored_windows",
    O.query(
        f"""SELECT m.domain, m.seq, a.a AS window_us, a.a + {W_US} AS until_us
        FROM smsgs m ASOF JOIN anchors a ON m.domain = a.domain AND m.us >= a.a""",
        O.BASE, O.MSGS, SITE_MSGS, O.anchors(W_US, "smsgs"),
    ),
)
def anchored_windows(spark, d):
    return WN.anchored_windows(_site_messages(spark, d), W_SEC).select(
        "domain", "seq", us("window_start").alias("window_us"), us("window_end").alias("until_us")
    )


@register(
    "anchored_windows_split",
    O.query(
        f"""SELECT m.domain, m.seq, a.a AS window_us, a.a + {W_US} AS until_us
        FROM smsgs m ASOF JOIN anchors a ON m.domain = a.domain AND m.us >= a.a""",
        O.BASE, O.MSGS, SITE_MSGS, O.anchors(W_US, "smsgs"),
    ),
)
def anchored_windows_split(spark, d):
    """Same result with tiny chunks, so that long runs go through the composition tree."""
    got = WN.anchored_windows(_site_messages(spark, d), W_SEC, chunk_rows=8, fanin=3)
    return got.select("domain", "seq", us("window_start").alias("window_us"), us("window_end").alias("until_us"))


BURST = WN.Burst(window_sec=120.0, threshold=3, factor=2.5, max_sec=1200.0)
BURST_SQL = f"""
polls AS (
  SELECT s.domain, s.us, least(k * 120000000, {W_US}) AS off FROM (SELECT DISTINCT domain, us FROM msgs) s, range(1, 6) t(k)
),
hits AS (
  SELECT p.domain, p.us, p.off, count(*) AS n FROM polls p JOIN msgs m
    ON m.domain = p.domain AND m.us BETWEEN greatest(p.us, p.us + p.off - 120000000) AND p.us + p.off
  GROUP BY ALL
),
ends AS (
  SELECT domain, us, us + CASE WHEN max(n) >= 3 THEN 1200000000 ELSE {W_US} END AS e FROM hits GROUP BY domain, us
),
anchors AS (
  SELECT domain, min(us) AS a FROM msgs GROUP BY domain
  UNION ALL
  SELECT domain, nxt FROM (
    SELECT x.domain, (SELECT min(s.us) FROM ends s WHERE s.domain = x.domain AND s.us > o.e) AS nxt
    FROM anchors x JOIN ends o ON o.domain = x.domain AND o.us = x.a) WHERE nxt IS NOT NULL
)"""


@register(
    "adaptive_windows",
    O.query(
        """SELECT m.seq, a.a AS window_us, o.e AS until_us
        FROM msgs m ASOF JOIN anchors a ON m.domain = a.domain AND m.us >= a.a
        JOIN ends o ON o.domain = a.domain AND o.us = a.a""",
        *INPUT, BURST_SQL,
    ),
)
def adaptive_windows(spark, d):
    got = WN.anchored_windows(messages(spark, d), W_SEC, burst=BURST)
    return got.select("seq", us("window_start").alias("window_us"), us("window_end").alias("until_us"))


SESSION_SQL = f"""
gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY domain ORDER BY us, seq) <= {W_US} THEN 0 ELSE 1 END AS opens FROM smsgs
),
sess AS (SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY us, seq) AS s FROM gaps)"""


@register(
    "session_windows",
    O.query(
        f"""SELECT domain, min(us) AS window_us, max(us) + {W_US} AS until_us, count(*) AS n
        FROM sess GROUP BY domain, s""",
        O.BASE, O.MSGS, SITE_MSGS, SESSION_SQL,
    ),
)
def session_windows(spark, d):
    got = WN.session_windows(_site_messages(spark, d), W_SEC)
    return got.groupBy("domain", "window_start", "window_end").agg(F.count("*").alias("n")).select(
        "domain", us("window_start").alias("window_us"), us("window_end").alias("until_us"), "n"
    )


@register(
    "tumbling_windows",
    O.query(
        "SELECT (us // 10000000) * 10000000 AS window_us, hostname, count(*) AS n FROM msgs GROUP BY ALL", *INPUT
    ),
)
def tumbling_windows(spark, d):
    got = WN.tumbling_windows(messages(spark, d), 10)
    return got.groupBy(us("window_start").alias("window_us"), "hostname").agg(F.count("*").alias("n"))


@register(
    "newest_per_window",
    O.query(
        """SELECT w AS window_us, seq FROM wm
        QUALIFY row_number() OVER (PARTITION BY domain, w ORDER BY us DESC, seq DESC) <= 3""",
        *WINDOWED,
    ),
)
def newest_per_window(spark, d):
    return WN.newest_per_window(windowed(spark, d), 3).select(us("window_start").alias("window_us"), "seq")


@register(
    "burst_flags",
    O.query(
        """SELECT domain, count(*) FILTER (us >= epoch_us(TIMESTAMP '2024-01-30 23:00:00') - 3600000000) >= 10 AS burst
        FROM smsgs GROUP BY domain""",
        O.BASE, O.MSGS, SITE_MSGS,
    ),
)
def burst_flags(spark, d):
    as_of = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return WN.burst_detected(_site_messages(spark, d), as_of, WN.Burst(window_sec=3600.0, threshold=10))


# --- inference -----------------------------------------------------------------------------


@register(
    "active_hosts",
    O.query(
        """SELECT w AS window_us, host AS hostname, n_logs, n_active, first_seen AS first_us, amsg AS active_message,
        msg AS message, routing AS is_routing FROM act""",
        *WINDOWED, O.hosts(2),
    ),
)
def active_hosts(spark, d):
    hosts = INF.host_stats(FL.known_hosts(evidence(spark, d), topology(spark, d).nodes), RULES)
    return hosts.select(
        us("window_start").alias("window_us"), "hostname", "n_logs", "n_active",
        us("first_seen.ts").alias("first_us"), "active_message", "message", "is_routing",
    )


@register(
    "flapping_hosts",
    O.query(
        "SELECT w AS window_us, host AS hostname, event_type AS event, times FROM flaps", *WINDOWED, O.hosts(2)
    ),
)
def flapping_hosts(spark, d):
    hosts = INF.host_stats(FL.known_hosts(evidence(spark, d), topology(spark, d).nodes), RULES)
    return hosts.filter("flap is not null").select(
        us("window_start").alias("window_us"), "hostname", "flap.event", "flap.times"
    )


@register(
    "silent_candidates",
    O.query("SELECT w AS window_us, anc AS ancestor, covers, CAST(rk AS INTEGER) AS rank FROM cands", *HOSTS),
)
def silent_candidates(spark, d):
    topo = topology(spark, d)
    hosts = materialize(INF.host_stats(FL.known_hosts(evidence(spark, d), topo.nodes), RULES), "hosts")
    reach = C.conditional_ancestors(hosts, physical(spark, d), topo.edges, INF.WINDOW)
    found = INF.silent_candidates(hosts, INF._marked_ancestors(hosts, reach), RULES.silent_coverage)
    return found.select(us("window_start").alias("window_us"), "ancestor", "covers", "rank")


@register(
    "root_candidates",
    O.query(
        """SELECT w AS window_us, host AS hostname, first_seen AS first_us FROM act a WHERE NOT EXISTS (
        SELECT 1 FROM above v WHERE v.domain = a.domain AND v.w = a.w AND v.host = a.host AND v.evident)""",
        *WINDOWED, O.hosts(0),
    ),
)
def root_candidates(spark, d):
    rules = INF.Rules(flapping_threshold=0, silent_coverage=1e9)
    got = INF.assign_hosts(evidence(spark, d), topology(spark, d), rules, physical=physical(spark, d))
    roots = got.filter("kind_no = 3 and hostname = root_cause_node")
    return roots.select(us("window_start").alias("window_us"), "hostname", us("first_seen.ts").alias("first_us"))


@register(
    "regular_incidents",
    O.query(
        """SELECT w AS window_us, kind, root AS root_cause_node, array_to_string(secondary, ',') AS secondary,
        raw_log_count, primary_event, CAST(emit_rank AS INTEGER) AS emit_rank FROM inc""",
        *WINDOWED, O.hosts(0), O.closure(), O.candidates(), O.incidents(silent=False),
    ),
)
def regular_incidents(spark, d):
    """Roots and independents only: flapping and silent steps off."""
    rules = INF.Rules(flapping_threshold=0, silent_coverage=1e9)
    got = INF.infer(
        windowed(spark, d), topology(spark, d), rules, physical=physical(spark, d), logs=False
    )
    return got.select(
        us("window_start").alias("window_us"), "kind", "root_cause_node",
        F.array_join("secondary_nodes", ",").alias("secondary"), "raw_log_count", "primary_event", "emit_rank",
    )


@register(
    "full_incidents",
    O.query(
        """SELECT w AS window_us, kind, root AS root_cause_node, array_to_string(secondary, ',') AS secondary,
        raw_log_count, primary_event, status, condition, CAST(emit_rank AS INTEGER) AS emit_rank,
        array_to_string(raw_logs, '\n') AS raw_logs FROM full_inc""",
        *FULL, O.NUMBERED, O.LOGS,
    ),
)
def full_incidents(spark, d):
    got = INF.infer(windowed(spark, d), topology(spark, d), RULES, physical=physical(spark, d))
    return got.select(
        us("window_start").alias("window_us"), "kind", "root_cause_node",
        F.array_join("secondary_nodes", ",").alias("secondary"), "raw_log_count", "primary_event",
        "status", "condition", "emit_rank", F.array_join("raw_logs", "\n").alias("raw_logs"),
    )


PAYLOAD_WINDOWS = """
wm AS (
  SELECT * REPLACE (CAST(seq // 20 AS VARCHAR) AS domain, min(us) OVER (PARTITION BY seq // 20) AS us),
         min(us) OVER (PARTITION BY seq // 20) AS w,
         min(us) OVER (PARTITION BY seq // 20) AS wend FROM msgs
)"""


@register(
    "payload_incidents",
    O.query(
        """SELECT domain AS payload_id, kind, root AS root_cause_node, array_to_string(secondary, ',') AS secondary,
        raw_log_count, primary_event, condition, CAST(emit_rank AS INTEGER) AS emit_rank FROM inc""",
        *INPUT, PAYLOAD_WINDOWS, O.hosts(3, drop_recovery=False), O.closure(), O.candidates(), O.incidents(),
    ),
)
def payload_incidents(spark, d):
    got = PIPE.run_payloads(payload_lines(_payloads(spark, d)), topology(spark, d), physical=physical(spark, d))
    return got.select(
        F.col("domain").alias("payload_id"), "kind", "root_cause_node",
        F.array_join("secondary_nodes", ",").alias("secondary"), "raw_log_count", "primary_event",
        "condition", "emit_rank",
    )


@register(
    "session_incidents",
    O.query(
        """SELECT w AS window_us, kind, root AS root_cause_node, array_to_string(secondary, ',') AS secondary,
        raw_log_count, CAST(emit_rank AS INTEGER) AS emit_rank FROM inc""",
        *INPUT, f"""
smsgs AS (SELECT * FROM msgs),{SESSION_SQL},
wm AS (SELECT *, min(us) OVER (PARTITION BY domain, s) AS w, max(us) OVER (PARTITION BY domain, s) + {W_US} AS wend FROM sess)""",
        O.hosts(3), O.closure(), O.candidates(), O.incidents(),
    ),
)
def session_incidents(spark, d):
    """The pipe mode: idle-gap windows, then inference."""
    got = INF.infer(
        WN.session_windows(messages(spark, d), W_SEC), topology(spark, d), physical=physical(spark, d), logs=False
    )
    return got.select(
        us("window_start").alias("window_us"), "kind", "root_cause_node",
        F.array_join("secondary_nodes", ",").alias("secondary"), "raw_log_count", "emit_rank",
    )


SIMPLE_SQL = """
tw AS (SELECT *, (us // 10000000) * 10000000 AS w FROM msgs WHERE hostname IN (SELECT id FROM nodes)),
seen AS (SELECT domain, w, hostname AS host, first(message ORDER BY us, seq) AS msg FROM tw GROUP BY ALL),
links AS (
  SELECT s.domain, s.w, s.host, u.ancestor FROM seen s JOIN up u ON u.node = s.host
  JOIN seen a ON a.domain = s.domain AND a.w = s.w AND a.host = u.ancestor
),
simple AS (
  SELECT s.domain, s.w, s.host AS root, s.msg,
    list_sort(coalesce(list(l.host) FILTER (l.host IS NOT NULL), [])) AS secondary
  FROM seen s LEFT JOIN links l ON l.domain = s.domain AND l.w = s.w AND l.ancestor = s.host
  WHERE (s.domain, s.w, s.host) NOT IN (SELECT domain, w, host FROM links) GROUP BY ALL
)"""


@register(
    "simple_roots",
    O.query(
        """SELECT w AS window_us, root AS root_cause_node, msg AS primary_event,
        array_to_string(secondary, ',') AS secondary FROM simple""",
        *INPUT, O.closure("true"), SIMPLE_SQL,
    ),
)
def simple_roots(spark, d):
    got = INF.simple_roots(WN.tumbling_windows(messages(spark, d), 10), topology(spark, d))
    return got.select(
        us("window_start").alias("window_us"), "root_cause_node", "primary_event",
        F.array_join("secondary_nodes", ",").alias("secondary"),
    )


@register(
    "window_summary",
    O.query(
        """SELECT m.w AS window_us, m.n AS raw_logs, coalesce(i.k, 0) AS root_causes
        FROM (SELECT domain, w, count(*) AS n FROM wm GROUP BY ALL) m
        LEFT JOIN (SELECT domain, w, count(DISTINCT root) AS k FROM inc GROUP BY ALL) i USING (domain, w)""",
        *FULL,
    ),
)
def window_summary(spark, d):
    got = INF.window_summary(windowed(spark, d), incidents(spark, d))
    return got.select(us("window_start").alias("window_us"), "raw_logs", "root_causes")


@register(
    "incident_logs",
    O.query(
        """SELECT e.seq, m.root AS root_cause_node,
        CASE m.kind_no WHEN 1 THEN 'flapping' WHEN 2 THEN 'silent' WHEN 3 THEN 'regular' ELSE 'independent' END AS kind
        FROM ev e JOIN members m ON m.domain = e.domain AND m.w = e.w AND m.host = e.hostname""",
        *FULL,
    ),
)
def incident_logs(spark, d):
    return INF.incident_logs(evidence(spark, d), assigned(spark, d)).select("seq", "root_cause_node", "kind")


# --- incident table ------------------------------------------------------------------------


@register(
    "incident_ids",
    O.query(
        "SELECT incident_id, w AS window_us, root AS root_cause_node, recurrence_count FROM num", *FULL, O.NUMBERED
    ),
)
def incident_ids(spark, d):
    found = INF.build_incidents(assigned(spark, d))
    return I.number_incidents(found).select(
        "incident_id", us("window_start").alias("window_us"), "root_cause_node", "recurrence_count"
    )


@register(
    "recovery_join",
    O.query(
        """SELECT t.incident_id, CASE WHEN r.first IS NOT NULL THEN 'RECOVERED' ELSE t.condition END AS condition,
        r.first AS recovered_us FROM tab t LEFT JOIN (
          SELECT t.incident_id, min(m.w) AS first FROM tab t JOIN wm m
            ON m.domain = t.domain AND m.hostname = t.root AND m.is_recovery AND m.w >= t.w
          WHERE t.status = 'OPEN' GROUP BY ALL) r USING (incident_id)""",
        *TABLE,
    ),
)
def recovery_join(spark, d):
    recoveries = FL.recovery_nodes(windowed(spark, d), topology(spark, d).nodes, INF.WINDOW)
    return I.recover(incidents(spark, d), recoveries).select(
        "incident_id", "condition", us("recovered_window").alias("recovered_us")
    )


@register(
    "list_incidents",
    O.query(
        """SELECT incident_id, epoch_us(created_at) AS created_us, root AS root_cause_node FROM tab
        WHERE status = 'OPEN' AND condition = 'ACTIVE' AND created_at >= TIMESTAMP '2024-01-05 00:00:00'
        AND created_at <= TIMESTAMP '2024-01-20 12:00:00'""",
        *TABLE,
    ),
)
def list_incidents(spark, d):
    got = I.list_incidents(incidents(spark, d), "OPEN", "ACTIVE", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return got.select("incident_id", us("created_at").alias("created_us"), "root_cause_node")


@register("incident_total", O.query("SELECT count(*) AS total FROM tab", *TABLE))
def incident_total(spark, d):
    return PL.incident_total(incidents(spark, d))


@register(
    "count_by_root", O.query("SELECT root AS root_cause_node, count(*) AS incidents FROM tab GROUP BY ALL", *TABLE)
)
def count_by_root(spark, d):
    return I.count_by_root(incidents(spark, d))


@register(
    "pipeline_status",
    O.query(
        """SELECT true AS topology_loaded, (SELECT count(*) FROM msgs) AS received,
        (SELECT count(*) FROM tab) AS incidents""",
        *TABLE,
    ),
)
def pipeline_status(spark, d):
    return PIPE.pipeline_status(messages(spark, d), incidents(spark, d), topology(spark, d))


@register(
    "purge_closed",
    O.query(
        f"""SELECT incident_id, status FROM tab WHERE NOT (status = 'CLOSED'
        AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)""",
        *TABLE,
    ),
)
def purge_closed(spark, d):
    as_of = F.lit(AS_OF).cast("timestamp")
    return I.purge_closed(incidents(spark, d), as_of, 30).select("incident_id", "status")


@register(
    "close_incidents",
    O.query(
        """SELECT incident_id, CASE WHEN kind = 'silent' THEN 'CLOSED' ELSE status END AS status FROM tab""", *TABLE
    ),
)
def close_incidents(spark, d):
    table = incidents(spark, d)
    return I.close(table, table.filter("kind = 'silent'")).select("incident_id", "status")


@register(
    "upsert_incidents",
    O.query(
        """SELECT incident_id, CASE WHEN kind = 'regular' THEN 'CLOSED' ELSE status END AS status,
        len(raw_logs) AS logs FROM tab""",
        *TABLE,
    ),
)
def upsert_incidents(spark, d):
    table = incidents(spark, d)
    changed = table.filter("kind = 'regular'").withColumn("status", F.lit("CLOSED"))
    stored = table.filter("kind <> 'independent'")
    fresh = changed.unionByName(table.filter("kind = 'independent'"))
    return I.upsert(stored, fresh).select("incident_id", "status", F.size("raw_logs").cast("bigint").alias("logs"))


@register(
    "similar_by_root",
    O.query(
        """SELECT a.incident_id, CAST(row_number() OVER (PARTITION BY a.incident_id
            ORDER BY b.created_at DESC, b.incident_id) AS INTEGER) AS rank, b.incident_id AS similar_id
        FROM tab a JOIN tab b ON a.root = b.root AND a.incident_id <> b.incident_id
        QUALIFY row_number() OVER (PARTITION BY a.incident_id ORDER BY b.created_at DESC, b.incident_id) <= 5""",
        *TABLE,
    ),
)
def similar_by_root(spark, d):
    return I.similar_by_root(incidents(spark, d))


@register(
    "incidents_by_ids",
    O.query(
        """SELECT a.root AS request_id, a.pos AS position, t.incident_id, t.primary_event FROM (
          SELECT root, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM (
            SELECT root, list_concat(list_concat(list(incident_id ORDER BY incident_id DESC)[1:4], ['none']),
                   list(incident_id ORDER BY incident_id)[1:1]) AS ids FROM tab GROUP BY root)) a
        JOIN tab t ON t.incident_id = a.id""",
        *TABLE,
    ),
)
def incidents_by_ids(spark, d):
    table = incidents(spark, d)
    newest = I.first_per_group(
        table.select("root_cause_node", "incident_id"), ["root_cause_node"], [F.desc("incident_id")], 4
    )
    requests = newest.groupBy(F.col("root_cause_node").alias("request_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "incident_id"))), lambda x: x.incident_id
        ).alias("newest")
    )
    oldest = table.groupBy(F.col("root_cause_node").alias("request_id")).agg(F.min("incident_id").alias("oldest"))
    requests = requests.join(oldest, "request_id").select(
        "request_id", F.concat("newest", F.array(F.lit("none"), "oldest")).alias("ids")
    )
    return I.by_ids(table, requests).select("request_id", "position", "incident_id", "primary_event")


# --- reports and payloads ------------------------------------------------------------------

FP_SQL = """sha256('{"et": "' || regexp_extract(primary_event, '%[A-Z_]+-\\d+-[A-Z_]+') || '", "rc": "' || root
|| '", "sn": [' || array_to_string(list_transform(secondary, lambda x: '"' || x || '"'), ', ') || ']}')"""
CACHE_SQL = f"""
fp AS (SELECT *, {FP_SQL} AS fingerprint FROM tab),
cache AS (
  SELECT fingerprint, 'report of ' || min(incident_id) AS report, max(created_at) AS created_at
  FROM fp WHERE kind <> 'independent' GROUP BY fingerprint
),
live AS (SELECT * FROM cache WHERE created_at >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 7 DAY)"""
CACHE_TIME = "2024-01-28 00:00:00"


def _cache(spark, d):
    table = R.with_fingerprint(incidents(spark, d)).filter("kind <> 'independent'")
    return table.groupBy("fingerprint").agg(
        F.concat(F.lit("report of "), F.min("incident_id")).alias("report"),
        F.max("created_at").alias("created_at"),
    )


@register("fingerprints", O.query("SELECT incident_id, fingerprint FROM fp", *TABLE, CACHE_SQL))
def fingerprints(spark, d):
    return R.with_fingerprint(incidents(spark, d)).select("incident_id", "fingerprint")


@register(
    "cache_lookup",
    O.query(
        "SELECT incident_id, fp.fingerprint, report FROM fp LEFT JOIN live USING (fingerprint)", *TABLE, CACHE_SQL
    ),
)
def cache_lookup(spark, d):
    got = R.cache_lookup(incidents(spark, d), _cache(spark, d), F.lit(CACHE_TIME).cast("timestamp"))
    return got.select("incident_id", "fingerprint", "report")


@register(
    "cache_purge", O.query("SELECT fingerprint, report FROM live", *TABLE, CACHE_SQL)
)
def cache_purge(spark, d):
    got = R.cache_purge(_cache(spark, d), F.lit(CACHE_TIME).cast("timestamp"))
    return got.select("fingerprint", "report")


@register(
    "incident_documents",
    O.query(
        """SELECT incident_id, 'RootCause: ' || root || chr(10) || 'PrimaryEvent: ' || primary_event
        || CASE WHEN len(secondary) > 0 THEN chr(10) || 'SecondaryNodes: ' || array_to_string(secondary, ', ') ELSE '' END
        || CASE WHEN len(raw_logs) > 0 THEN chr(10) || 'Log: ' || array_to_string(raw_logs[1:8], chr(10) || 'Log: ') ELSE '' END
        AS document FROM tab""",
        *TABLE,
    ),
)
def incident_documents(spark, d):
    return R.incident_documents(incidents(spark, d)).select("incident_id", "document")


PROMPT_SQL = (
    "'" + texts.PROMPT_HEAD + "' || '" + texts.SUMMARY_LABELS["id"] + "' || incident_id || chr(10) || '"
    + texts.SUMMARY_LABELS["root"] + "' || root || chr(10) || '" + texts.SUMMARY_LABELS["event"]
    + "' || primary_event || CASE WHEN len(secondary) > 0 THEN chr(10) || '" + texts.SUMMARY_LABELS["secondary"]
    + "' || array_to_string(secondary, ', ') ELSE '' END || chr(10) || '" + texts.SUMMARY_LABELS["count"]
    + "' || raw_log_count || CASE WHEN len(raw_logs) > 0 THEN chr(10) || '  - ' || "
    "array_to_string(raw_logs[1:10], chr(10) || '  - ') ELSE '' END || chr(10) || '" + texts.PROMPT_TAIL + "'"
)


@register(
    "report_worklist",
    O.query(
        f"""SELECT incident_id, CASE WHEN report IS NULL THEN 'to_ask' ELSE 'cached' END AS state, report,
        CASE WHEN report IS NULL THEN {PROMPT_SQL} END AS prompt FROM fp LEFT JOIN live USING (fingerprint)""",
        *TABLE, CACHE_SQL,
    ),
)
def report_worklist(spark, d):
    got = R.report_worklist(incidents(spark, d), _cache(spark, d), F.lit(CACHE_TIME).cast("timestamp"))
    return got.select("incident_id", "state", "report", "prompt")


@register(
    "semantic_topk",
    """SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
       CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(
         CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS INTEGER) AS rank
       FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
       QUALIFY rank <= 5""",
)
def semantic_topk(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return nearest(vectors, vectors, 5, id_col="vec_id").select("query_id", "neighbor_id", "rank")


@register(
    "similar_incidents",
    O.query(
        """SELECT a.incident_id, CAST(row_number() OVER (PARTITION BY a.incident_id
            ORDER BY b.created_at DESC, b.incident_id) AS INTEGER) AS rank, b.incident_id AS similar_id,
          b.root AS root_cause_node, b.primary_event, b.status, 'db' AS source
        FROM tab a JOIN tab b ON a.root = b.root AND a.incident_id <> b.incident_id
        QUALIFY row_number() OVER (PARTITION BY a.incident_id ORDER BY b.created_at DESC, b.incident_id) <= 5""",
        *TABLE,
    ),
)
def similar_incidents(spark, d):
    return R.similar_incidents(incidents(spark, d)).select(
        "incident_id", "rank", "similar_id", "root_cause_node", "primary_event", "status", "source"
    )


ISO_SQL = """strftime(created_at, '%Y-%m-%dT%H:%M:%S') ||
CASE WHEN wend % 1000000 <> 0 THEN strftime(created_at, '.%f') ELSE '' END || '+00:00'"""


def _json_list(col: str) -> str:
    return f"CASE WHEN len({col}) = 0 THEN '[]' ELSE '[\"' || array_to_string({col}, '\",\"') || '\"]' END"


@register(
    "json_lines",
    O.query(
        f"""SELECT incident_id, {ISO_SQL} AS created_at, root AS root_cause_node, primary_event,
        array_to_string(secondary, ',') AS secondary, raw_log_count, status, recurrence_count FROM tab""",
        *TABLE,
    ),
)
def json_lines(spark, d):
    return PL.json_lines(incidents(spark, d)).withColumn(
        "secondary", F.array_join("secondary_nodes", ",")
    ).drop("secondary_nodes")


@register(
    "text_blocks",
    O.query(
        """SELECT '[INCIDENT] ' || incident_id || chr(10) || '  Root Cause  : ' || root || chr(10)
        || '  Event       : ' || primary_event || CASE WHEN len(secondary) > 0
           THEN chr(10) || '  Secondary   : ' || array_to_string(secondary, ', ') ELSE '' END
        || chr(10) || '  Logs        : ' || raw_log_count || chr(10) || '  Status      : ' || status AS value FROM tab""",
        *TABLE,
    ),
)
def text_blocks(spark, d):
    return PL.text_blocks(incidents(spark, d))


@register(
    "payload_webhook",
    O.query(
        f"""SELECT incident_id, '{{"incident_id":"' || incident_id || '","root_cause":"' || root || '","primary_event":"'
        || primary_event || '","secondary_affected_count":' || len(secondary) || ',"secondary_nodes":'
        || {_json_list("secondary")} || ',"raw_log_count":' || raw_log_count || ',"created_at":"' || {ISO_SQL} || '"}}' AS payload
        FROM tab""",
        *TABLE,
    ),
)
def payload_webhook(spark, d):
    return PL.webhook_payloads(incidents(spark, d))


NL = "\\n"


@register(
    "payload_slack",
    O.query(
        f"""SELECT incident_id, '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"\U0001f6a8 インシデント検知: '
        || incident_id || '"}}}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*根本原因:*{NL}' || root
        || '"}},{{"type":"mrkdwn","text":"*影響ノード数:*{NL}' || len(secondary) || '"}},{{"type":"mrkdwn","text":"*主イベント:*{NL}`'
        || primary_event || '`"}},{{"type":"mrkdwn","text":"*ログ件数:*{NL}' || raw_log_count
        || '"}}]}},{{"type":"section","text":{{"type":"mrkdwn","text":"*二次影響ノード:* '
        || CASE WHEN len(secondary) > 0 THEN array_to_string(secondary, ', ') ELSE 'なし' END || '"}}}}]}}' AS payload FROM tab""",
        *TABLE,
    ),
)
def payload_slack(spark, d):
    return PL.slack_payloads(incidents(spark, d))


@register(
    "payload_alert",
    O.query(
        """SELECT incident_id, '{"title":"[' || incident_id || '] ' || root || ': ' || primary_event
        || '","description":"影響ノード: ' || CASE WHEN len(secondary) > 0 THEN array_to_string(secondary, ', ') ELSE 'なし' END
        || ' / ログ件数: ' || raw_log_count || CASE WHEN recurrence_count > 0 THEN ' / 再発: ' || recurrence_count || '回' ELSE '' END
        || '","source":"' || root || '","team_name":"default","priority":"'
        || CASE WHEN condition = 'FLAPPING' OR recurrence_count > 0 THEN 'P2' ELSE 'P3' END || '"}' AS payload FROM tab""",
        *TABLE,
    ),
)
def payload_alert(spark, d):
    return PL.alert_payloads(incidents(spark, d))


@register(
    "payload_resolve",
    O.query(
        """SELECT source, '{"source":"' || source || '"}' AS payload FROM (
        SELECT DISTINCT domain, w, hostname AS source FROM wm WHERE is_recovery AND hostname IN (SELECT id FROM nodes)
        UNION ALL SELECT domain, w, root FROM tab WHERE status = 'CLOSED')""",
        *TABLE,
    ),
)
def payload_resolve(spark, d):
    recoveries = FL.recovery_nodes(windowed(spark, d), topology(spark, d).nodes, INF.WINDOW)
    return PL.resolve_payloads(recoveries, incidents(spark, d).filter("status = 'CLOSED'"))


@register(
    "event_feed",
    O.query(
        f"""SELECT type, incident_id, '{{"type":"' || type || '",' || CASE WHEN type = 'incident.recovered'
          THEN '"incident_id":"' || incident_id || '",' ELSE '' END
        || '"incident":{{"incident_id":"' || incident_id || '","created_at":"' || {ISO_SQL} || '","root_cause_node":"' || root
        || '","primary_event":"' || primary_event || '","secondary_nodes":' || {_json_list("secondary")}
        || ',"raw_log_count":' || raw_log_count || ',"raw_logs":' || {_json_list("raw_logs")} || ',"status":"' || status
        || '","condition":"' || cond || '","recurrence_count":' || recurrence_count || '}}}}' AS event
        FROM (SELECT 'incident.new' AS type, condition AS cond, * FROM tab
              UNION ALL SELECT 'incident.recovered', 'RECOVERED', * FROM tab t WHERE status = 'OPEN' AND EXISTS (
                SELECT 1 FROM wm m WHERE m.domain = t.domain AND m.hostname = t.root AND m.is_recovery AND m.w >= t.w))""",
        *TABLE,
    ),
)
def event_feed(spark, d):
    table = incidents(spark, d)
    recoveries = FL.recovery_nodes(windowed(spark, d), topology(spark, d).nodes, INF.WINDOW)
    recovered = I.recover(table, recoveries).filter("recovered_window is not null")
    return PL.event_feed(table, recovered)


@register(
    "state_badges",
    O.query(
        f"""SELECT incident_id, CASE WHEN status = 'CLOSED' THEN '{texts.BADGE_CLOSED}'
        WHEN condition = 'FLAPPING' THEN '{texts.BADGE_FLAPPING}'
        WHEN recurrence_count > 0 THEN '再発 (' || (recurrence_count + 1) || '回目)' ELSE '{texts.BADGE_NEW}' END AS badge
        FROM tab""",
        *TABLE,
    ),
)
def state_badges(spark, d):
    return PL.with_badge(incidents(spark, d)).select("incident_id", "badge")


@register(
    "map_tags",
    O.query(
        """SELECT incident_id, id, min(node_type) AS node_type FROM (
        SELECT incident_id, root AS id, 'root' AS node_type FROM tab
        UNION ALL SELECT incident_id, unnest(secondary), 'secondary' FROM tab) GROUP BY ALL""",
        *TABLE,
    ),
)
def map_tags(spark, d):
    return T.tag_map(topology(spark, d).nodes, incidents(spark, d))
