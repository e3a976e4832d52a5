"""End-to-end batch jobs from raw lines to incidents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.functions.parse import parse_syslog
from alarmlens.operators.filters import drop_ignored, recovery_nodes
from alarmlens.operators.incidents import number_incidents, recover
from alarmlens.operators.topology import Topology
from alarmlens.operators.windows import (
    DEFAULT_WINDOW_SEC,
    Burst,
    anchored_windows,
    payload_windows,
    session_windows,
    tumbling_windows,
)
from alarmlens.plans.infer import LOG_KEY, WINDOW, Rules, infer, infer_parts
from alarmlens.runtime import materialize


def prepare_messages(
    lines: DataFrame, patterns: DataFrame | None = None, *, year: int | None = None, tz: str = "UTC"
) -> DataFrame:
    """Parse and filter once; stored, because windows and inference read it several times."""
    parsed = parse_syslog(lines, year=year, tz=tz)
    if patterns is not None:
        parsed = drop_ignored(parsed, patterns)
    return materialize(parsed, "messages")


def assign_windows(
    messages: DataFrame,
    kind: str = "anchored",
    window_sec: float = DEFAULT_WINDOW_SEC,
    *,
    time_col: str = "received_at",
    burst: Burst | None = None,
) -> DataFrame:
    if kind == "anchored":
        return anchored_windows(messages, window_sec, time_col=time_col, burst=burst)
    if kind == "session":
        return session_windows(messages, window_sec, time_col=time_col)
    if kind == "tumbling":
        return tumbling_windows(messages, window_sec, time_col=time_col)
    if kind == "payload":
        return payload_windows(messages)
    raise ValueError(f"unknown window kind {kind!r}")


def run_batch(
    lines: DataFrame,
    topology: Topology,
    *,
    patterns: DataFrame | None = None,
    window: str = "anchored",
    window_sec: float = DEFAULT_WINDOW_SEC,
    time_col: str = "event_ts",
    burst: Burst | None = None,
    rules: Rules = Rules(),
    drop_recovery: bool = True,
    apply_recovery: bool = False,
    stored: DataFrame | None = None,
    physical: DataFrame | None = None,
    year: int | None = None,
    tz: str = "UTC",
) -> DataFrame:
    """Raw lines to numbered incidents.

    ``time_col`` picks the clock of the windows: the header time, or the arrival time
    when it is ``received_at``; lines without a header time fall back to arrival.
    """
    messages = prepare_messages(lines, patterns, year=year, tz=tz)
    if time_col == "event_ts":
        messages = messages.withColumn("event_ts", F.coalesce("event_ts", "received_at"))
    windowed = materialize(
        assign_windows(messages, window, window_sec, time_col=time_col, burst=burst), "windowed"
    )
    found, logs = infer_parts(
        windowed, topology, rules, drop_recovery=drop_recovery, physical=physical, time_col=time_col
    )
    incidents = number_incidents(found, stored).join(logs, LOG_KEY)
    if apply_recovery:
        incidents = recover(incidents, recovery_nodes(windowed, topology.nodes, WINDOW)).drop(
            "recovered_window"
        )
    return incidents


def run_payloads(
    lines: DataFrame,
    topology: Topology,
    *,
    patterns: DataFrame | None = None,
    rules: Rules = Rules(),
    physical: DataFrame | None = None,
) -> DataFrame:
    """Direct batch payloads: one window each, recoveries kept, no recurrence count."""
    windowed = payload_windows(prepare_messages(lines, patterns))
    incidents = infer(windowed, topology, rules, drop_recovery=False, physical=physical)
    return number_incidents(incidents).withColumn("recurrence_count", F.lit(0).cast("bigint"))


def pipeline_status(received: DataFrame, incidents: DataFrame, topology: Topology | None) -> DataFrame:
    """One row: is a topology loaded, how many messages came in, how many incidents exist."""
    rows = received.select(F.lit(1).alias("m"), F.lit(0).alias("i")).unionAll(
        incidents.select(F.lit(0), F.lit(1))
    )
    return rows.agg(
        F.lit(topology is not None).alias("topology_loaded"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("received"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("incidents"),
    )
