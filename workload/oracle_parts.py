"""DuckDB SQL building blocks: the derived inputs and the inference rules as common table expressions.

Nothing here reads a Spark result; lines, topology, windows and incidents are rebuilt
from the shared tables.
"""
from __future__ import annotations

TOKEN = "%[A-Z0-9_]+-\\d+-[A-Z0-9_]+"
RECOVERY = (
    "(?i)changed\\s+state\\s+to\\s+up\\b|ADJCHANGE[^\\n]*\\bUp\\b"
    "|ADJCHG[^\\n]*\\bto\\s+FULL\\b|%SYS-\\d+-RESTART"
)

BASE = """
base AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id AS u, event_type AS kind,
         event_id % 10 AS form, 'N' || user_id AS dev,
         '10.1.' || (user_id // 256) || '.' || (user_id % 256) AS addr,
         CASE WHEN user_id % 7 = 1 THEN 7 WHEN event_type IN ('error', 'purchase') THEN 3
              WHEN event_type = 'view' THEN 6 ELSE 5 END AS sev,
         json_extract_string(props, '$.k') AS k
  FROM events
),
texts AS (
  SELECT *, CASE kind
      WHEN 'error' THEN '%LINK-3-UPDOWN: Interface Gi0/' || k || ', changed state to down'
      WHEN 'signup' THEN '%BGP-5-ADJCHANGE: neighbor 10.0.0.' || k || ' Down'
      WHEN 'purchase' THEN '%LINK-3-UPDOWN: Interface Gi0/' || k || ', changed state to up'
      WHEN 'click' THEN '%SYS-5-CONFIG_I: Configured from console by vty' || k
      ELSE 'session ' || k || ' refreshed' END AS body
  FROM base
)"""

LINES = """
lines AS (
  SELECT seq, ts, us, u, addr, CASE
      WHEN form <= 4 THEN pri || stamp || ' ' || dev || ' ' || body
      WHEN form = 5 THEN pri || stamp || ' ' || addr || ' ' || seq || ': ' || dev || ': ' || body
      WHEN form <= 7 THEN pri || '1 ' || iso || ' ' || dev || ' app ' || seq || ' ID - ' || body
      WHEN form = 8 THEN pri || '1 ' || iso || ' - app ' || seq || ' ID - ' || seq || ': ' || dev || ': ' || body
      ELSE body END AS raw
  FROM (SELECT *, '<' || ((16 + u % 8) * 8 + sev) || '>' AS pri,
               strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') AS stamp,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso
        FROM texts)
)"""

# Lines parsed back with regular expressions.
PARSED = r"""
split AS (
  SELECT *, TRY_CAST(regexp_extract(raw, '^<([0-9]+)>', 1) AS BIGINT) AS pri,
         regexp_replace(raw, '^<[0-9]+>', '') AS rest
  FROM lines
),
shaped AS (
  SELECT *,
    CASE WHEN pri IS NULL THEN 'raw'
         WHEN regexp_matches(rest, '^\d+(\s+\S+){5}') THEN 'rfc5424'
         WHEN regexp_matches(rest, '^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+') THEN 'rfc3164'
         ELSE 'raw' END AS format
  FROM split
),
fields AS (
  SELECT *,
    CASE format
      WHEN 'rfc5424' THEN regexp_extract(rest, '^\d+\s+\S+\s+(\S+)', 1)
      WHEN 'rfc3164' THEN regexp_extract(rest, '^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+(\S+)\s+', 1)
      ELSE addr END AS host0,
    CASE format
      WHEN 'rfc5424' THEN regexp_extract(rest, '^(?:\S+\s+){7}(.*)$', 1)
      WHEN 'rfc3164' THEN regexp_extract(rest, '^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+(.*)$', 1)
      ELSE raw END AS message,
    CASE format
      WHEN 'rfc5424' THEN epoch_us(CAST(replace(regexp_extract(rest, '^\d+\s+(\S+)', 1), 'Z', '') AS TIMESTAMP))
      WHEN 'rfc3164' THEN epoch_us(strptime('2024 ' || regexp_extract(rest, '^(\w{3}\s+\d{1,2}\s+\S+)', 1), '%Y %b %d %H:%M:%S'))
      END AS event_us
  FROM shaped
),
parsed AS (
  SELECT seq, us, format, pri, message, event_us,
    CASE WHEN format = 'raw' THEN host0
         WHEN regexp_matches(h, '^\d{1,3}(\.\d{1,3}){3}$') AND regexp_matches(message, '^\d+:\s+\S+?:\s+')
         THEN regexp_extract(message, '^\d+:\s+(\S+?):\s+', 1) ELSE h END AS hostname
  FROM (SELECT *, CASE WHEN host0 = '-' THEN addr ELSE host0 END AS h FROM fields)
)"""

MSGS = f"""
msgs AS (
  SELECT *, nullif(regexp_extract(message, '{TOKEN}'), '') AS event_type,
         regexp_matches(message, '{RECOVERY}') AS is_recovery
  FROM (SELECT 'default' AS domain, seq, us, u, addr, ts,
               CASE WHEN form = 9 THEN addr ELSE dev END AS hostname,
               CASE WHEN form = 9 THEN 1 ELSE 16 + u % 8 END AS facility,
               CASE WHEN form = 9 THEN 5 ELSE sev END AS severity,
               CASE WHEN form IN (5, 8) THEN seq || ': ' || dev || ': ' || body ELSE body END AS message
        FROM texts)
)"""


def topology(changed: bool = False, suffix: str = "") -> str:
    keep = "AND i % 8 <> 3" if changed else ""
    extra = (
        "UNION ALL SELECT (p - 1) // 4 AS a, i AS b, 0 AS layer, NULL AS typ, i, 3 FROM dev WHERE i % 12 = 5"
        if changed
        else ""
    )
    return f"""
dev{suffix} AS (
  SELECT i, (i - 1) // 4 AS p, 'N' || i AS id, max(i) OVER () AS last,
    CASE WHEN i = 0 THEN 'spine' WHEN i <= 4 THEN 'core' WHEN i <= 20 THEN 'distribution'
         WHEN i <= 84 THEN 'access' WHEN i <= 340 THEN 'leaf' WHEN i % 3 = 0 THEN 'oob' ELSE 'other' END AS role
  FROM (SELECT DISTINCT user_id AS i FROM events)
),
nodes{suffix} AS (
  SELECT i, id, role, CASE role WHEN 'spine' THEN 0 WHEN 'core' THEN 1 WHEN 'distribution' THEN 2
      WHEN 'access' THEN 3 WHEN 'leaf' THEN 3 WHEN 'oob' THEN 4 ELSE 5 END AS role_priority
  FROM dev{suffix}
),
pairs{suffix} AS (
  SELECT CASE WHEN i % 5 = 0 THEN i ELSE p END AS a, CASE WHEN i % 5 = 0 THEN p ELSE i END AS b,
         0 AS layer, NULL AS typ, i, 0 AS pos FROM dev{suffix} WHERE i >= 1 {keep}
  {extra.replace("dev", "dev" + suffix)}
  UNION ALL SELECT i + 1, i, 1, 'ibgp', i, 0 FROM dev{suffix} WHERE i % 4 = 1 AND i < last
  UNION ALL SELECT i, (p - 1) // 4, 1, 'ebgp', i, 1 FROM dev{suffix} WHERE i >= 5 AND i % 3 = 0
  UNION ALL SELECT p, i, 1, 'ebgp', i, 2 FROM dev{suffix} WHERE i > 0 AND i % 6 = 0
),
directed{suffix} AS (
  SELECT layer, typ, q.i, pos,
    CASE WHEN typ = 'ibgp' THEN least(na.id, nb.id) WHEN na.role_priority <= nb.role_priority THEN na.id ELSE nb.id END AS src,
    CASE WHEN typ = 'ibgp' THEN greatest(na.id, nb.id) WHEN na.role_priority <= nb.role_priority THEN nb.id ELSE na.id END AS dst
  FROM pairs{suffix} q JOIN nodes{suffix} na ON na.i = q.a JOIN nodes{suffix} nb ON nb.i = q.b
),
edges{suffix} AS (
  SELECT src, dst, CASE layer WHEN 0 THEN 'physical' ELSE 'bgp' END AS edge_type, typ AS bgp_type
  FROM directed{suffix}
  QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY layer, i, pos) = 1
)"""


def closure(edge_filter: str = "edge_type = 'physical'", name: str = "up") -> str:
    return f"""
{name} AS (
  SELECT dst AS node, src AS ancestor FROM edges WHERE {edge_filter} AND src <> dst
  UNION
  SELECT u.node, e.src FROM {name} u JOIN edges e ON e.dst = u.ancestor
  WHERE {edge_filter} AND e.src <> u.node
)"""


def anchors(window_us: int, source: str = "msgs", name: str = "anchors") -> str:
    return f"""
stamps AS (SELECT DISTINCT domain, us FROM {source}),
{name} AS (
  SELECT domain, min(us) AS a FROM stamps GROUP BY domain
  UNION ALL
  SELECT domain, nxt FROM (
    SELECT x.domain, (SELECT min(s.us) FROM stamps s WHERE s.domain = x.domain AND s.us > x.a + {window_us}) AS nxt
    FROM {name} x) WHERE nxt IS NOT NULL
)"""


def windowed(window_us: int) -> str:
    """Messages with the start ``w`` and end ``wend`` of their anchored window."""
    return (
        anchors(window_us)
        + f""",
wm AS (
  SELECT m.*, a.a AS w, a.a + {window_us} AS wend
  FROM msgs m ASOF JOIN anchors a ON m.domain = a.domain AND m.us >= a.a
)"""
    )


def hosts(flap: int, drop_recovery: bool = True) -> str:
    """Active hosts per window, flapping hosts, routing hosts, ancestor pairs."""
    keep = "WHERE NOT is_recovery" if drop_recovery else ""
    return f"""
ev AS (SELECT * FROM wm {keep}),
known AS (SELECT * FROM ev WHERE hostname IN (SELECT id FROM nodes)),
act AS (
  SELECT domain, w, hostname AS host, max(wend) AS wend, count(*) AS n_logs,
         count(*) FILTER (severity <= 5) AS n_active, min(us) FILTER (severity <= 5) AS first_seen,
         first(seq ORDER BY us, seq) FILTER (severity <= 5) AS first_seq,
         first(message ORDER BY us, seq) FILTER (severity <= 5) AS amsg,
         first(message ORDER BY us, seq) AS msg,
         bool_or(severity <= 5 AND regexp_matches(message, '%BGP-|%OSPF-|%ISIS-|%EIGRP-|%RIP-')) AS routing
  FROM known GROUP BY ALL HAVING count(*) FILTER (severity <= 5) > 0
),
flaps AS (
  SELECT domain, w, host, event_type, times FROM (
    SELECT domain, w, hostname AS host, event_type, count(*) AS times, min(us) AS us0, min(seq) AS seq0
    FROM known WHERE severity <= 5 AND event_type IS NOT NULL AND {flap} > 0
    GROUP BY domain, w, hostname, event_type HAVING count(*) >= {flap})
  QUALIFY row_number() OVER (PARTITION BY domain, w, host ORDER BY times DESC, us0, seq0) = 1
),
reach AS (
  SELECT domain, w, host, host AS anc FROM act
  UNION
  SELECT r.domain, r.w, r.host, e.src FROM reach r JOIN edges e ON e.dst = r.anc
  LEFT JOIN act t ON t.domain = r.domain AND t.w = r.w AND t.host = e.dst AND t.routing
  WHERE e.edge_type = 'physical' OR t.host IS NOT NULL
),
above AS (
  SELECT r.*, a.host IS NOT NULL AS evident FROM reach r
  LEFT JOIN act a ON a.domain = r.domain AND a.w = r.w AND a.host = r.anc
  WHERE r.anc <> r.host
)"""


def candidates(coverage: str = "0.6::DOUBLE") -> str:
    return f"""
totals AS (SELECT domain, w, count(*) AS n_hosts FROM act GROUP BY ALL HAVING count(*) >= 2),
cands AS (
  SELECT a.domain, a.w, u.ancestor AS anc, count(*) AS covers,
         row_number() OVER (PARTITION BY a.domain, a.w ORDER BY count(*) DESC, u.ancestor) AS rk
  FROM act a JOIN totals t USING (domain, w) JOIN up u ON u.node = a.host
  WHERE NOT EXISTS (SELECT 1 FROM act x WHERE x.domain = a.domain AND x.w = a.w AND x.host = u.ancestor)
  GROUP BY a.domain, a.w, u.ancestor, t.n_hosts
  HAVING count(*) >= greatest(2, floor(t.n_hosts * {coverage}))
)"""


def incidents(silent: bool = True) -> str:
    """Candidates taken one after another, then roots, owners and the incident rows."""
    first = "SELECT domain, w, 0 AS rk, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS took FROM totals"
    if not silent:
        first += " WHERE false"
    return f"""
cover AS (
  SELECT c.domain, c.w, c.rk, c.anc,
         coalesce(list(v.host) FILTER (v.host IS NOT NULL), []) AS hosts
  FROM cands c LEFT JOIN (
    SELECT * FROM above WHERE (domain, w, host) NOT IN (SELECT domain, w, host FROM flaps)
  ) v ON v.domain = c.domain AND v.w = c.w AND v.anc = c.anc
  GROUP BY ALL
),
taking AS (
  {first}
  UNION ALL
  SELECT domain, w, rk, CASE WHEN len(free) >= 2 THEN list_concat(taken, free) ELSE taken END,
         CASE WHEN len(free) >= 2 THEN free ELSE CAST([] AS VARCHAR[]) END
  FROM (SELECT t.domain, t.w, c.rk, t.taken, list_filter(c.hosts, lambda x: NOT list_contains(t.taken, x)) AS free
        FROM taking t JOIN cover c ON c.domain = t.domain AND c.w = t.w AND c.rk = t.rk + 1)
),
silent AS (
  SELECT t.domain, t.w, c.anc AS root, t.rk, unnest(t.took) AS host
  FROM taking t JOIN cover c ON c.domain = t.domain AND c.w = t.w AND c.rk = t.rk
),
status AS (
  SELECT a.*, f.event_type AS flap, f.times, s.root AS silent_root, s.rk AS silent_rank,
         f.host IS NULL AND s.host IS NULL AS free,
         NOT EXISTS (SELECT 1 FROM above v WHERE v.domain = a.domain AND v.w = a.w AND v.host = a.host AND v.evident) AS top
  FROM act a LEFT JOIN flaps f USING (domain, w, host) LEFT JOIN silent s USING (domain, w, host)
),
owners AS (
  SELECT v.domain, v.w, v.host, first(r.host ORDER BY r.first_seen, r.first_seq) AS owner
  FROM above v JOIN status r ON r.domain = v.domain AND r.w = v.w AND r.host = v.anc AND r.free AND r.top
  GROUP BY ALL
),
members AS (
  SELECT s.*, CASE WHEN flap IS NOT NULL THEN 1 WHEN silent_root IS NOT NULL THEN 2
                   WHEN top OR owner IS NOT NULL THEN 3 ELSE 4 END AS kind_no,
         CASE WHEN flap IS NOT NULL THEN s.host WHEN silent_root IS NOT NULL THEN silent_root
              WHEN top THEN s.host ELSE coalesce(owner, s.host) END AS root
  FROM status s LEFT JOIN owners o USING (domain, w, host)
),
folded AS (
  SELECT domain, w, kind_no, root, max(wend) AS wend, sum(n_logs) AS raw_log_count,
         list_sort(coalesce(list(host) FILTER (host <> root), [])) AS secondary,
         max(CASE WHEN kind_no = 4 THEN msg ELSE amsg END) FILTER (host = root) AS root_msg,
         max(flap) AS flap, max(times) AS times, min(silent_rank) AS silent_rank,
         min(first_seen) FILTER (host = root) AS root_seen, min(first_seq) FILTER (host = root) AS root_seq
  FROM members GROUP BY ALL
),
inc AS (
  SELECT domain, w, wend, root, secondary, CAST(raw_log_count AS BIGINT) AS raw_log_count,
    CASE kind_no WHEN 1 THEN 'flapping' WHEN 2 THEN 'silent' WHEN 3 THEN 'regular' ELSE 'independent' END AS kind,
    kind_no,
    CASE kind_no WHEN 1 THEN 'FLAPPING: ' || flap || ' repeated ' || times || 'x in window'
                 WHEN 2 THEN '(inferred — node did not send SYSLOG)' ELSE root_msg END AS primary_event,
    'OPEN' AS status, CASE kind_no WHEN 1 THEN 'FLAPPING' ELSE 'ACTIVE' END AS condition,
    row_number() OVER (PARTITION BY domain, w ORDER BY kind_no, silent_rank,
                       CASE WHEN kind_no = 3 THEN root_seen END, CASE WHEN kind_no = 3 THEN root_seq END,
                       root) AS emit_rank
  FROM folded
)"""


NUMBERED = """
num AS (
  SELECT *, make_timestamp(wend) AS created_at,
    'INC-' || strftime(make_timestamp(wend), '%Y%m%d') || '-' || CASE WHEN n < 1000
        THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS incident_id,
    nth - 1 AS recurrence_count
  FROM (SELECT *, row_number() OVER (PARTITION BY strftime(make_timestamp(wend), '%Y%m%d')
                                     ORDER BY w, domain, emit_rank) AS n,
               row_number() OVER (PARTITION BY root ORDER BY w, domain, emit_rank) AS nth
        FROM inc)
)"""

LOGS = """
logs AS (
  SELECT e.domain, e.w, m.kind_no, m.root, list(e.message ORDER BY e.us, e.seq)[1:200] AS raw_logs
  FROM ev e JOIN members m ON m.domain = e.domain AND m.w = e.w AND m.host = e.hostname
  GROUP BY ALL
),
full_inc AS (SELECT n.*, l.raw_logs FROM num n JOIN logs l USING (domain, w, kind_no, root))"""


def query(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select
