"""Schemas of the tables the jobs exchange, as DDL text."""
from __future__ import annotations

RAW_LINES = "raw STRING, source_ip STRING, received_at TIMESTAMP, seq BIGINT"

PAYLOADS = (
    "payload_id STRING, received_at TIMESTAMP,"
    " messages ARRAY<STRUCT<source_ip: STRING, raw: STRING>>"
)

MESSAGES = (
    "domain STRING, seq BIGINT, received_at TIMESTAMP, event_ts TIMESTAMP, source_ip STRING,"
    " hostname STRING, facility INT, severity INT, message STRING, event_type STRING,"
    " is_recovery BOOLEAN, format STRING"
)

TOPOLOGY_DOC = (
    "`network-model` STRUCT<"
    "`physical-layer`: STRUCT<"
    "device: ARRAY<STRUCT<`device-id`: STRING, `device-name`: STRING, `device-type`: STRING,"
    " role: STRING, loopback: STRING, interface: ARRAY<STRUCT<`interface-id`: STRING,"
    " description: STRING, `ip-address`: STRING>>>>,"
    "`physical-connection`: ARRAY<STRUCT<`connection-id`: STRING,"
    " endpoint: ARRAY<STRUCT<`device-id`: STRING, `interface-id`: STRING>>>>>,"
    "`layer3-layer`: STRUCT<`bgp-session`: ARRAY<STRUCT<`session-id`: STRING, type: STRING,"
    " endpoint: ARRAY<STRUCT<`device-id`: STRING>>>>>>"
)

SUPPORTING_NODE_DOC = (
    "`ietf-network:networks` STRUCT<network: ARRAY<STRUCT<node: ARRAY<STRUCT<"
    "`node-id`: STRING,"
    " `ietf-network-topology:supporting-node`: ARRAY<STRUCT<`node-ref`: STRING>>>>>>>"
)

NODES = "id STRING, role STRING, role_priority INT"
EDGES = "src STRING, dst STRING, edge_type STRING, bgp_type STRING"
INTERFACES = "device_id STRING, interface_id STRING, ip STRING, description STRING"
PATTERNS = "pattern STRING"

INCIDENTS = (
    "incident_id STRING, created_at TIMESTAMP, root_cause_node STRING, primary_event STRING,"
    " secondary_nodes ARRAY<STRING>, raw_log_count BIGINT, raw_logs ARRAY<STRING>,"
    " status STRING, condition STRING, recurrence_count BIGINT,"
    " domain STRING, window_start TIMESTAMP, kind STRING, emit_rank INT"
)

REPORT_CACHE = "fingerprint STRING, report STRING, created_at TIMESTAMP"
