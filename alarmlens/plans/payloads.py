"""Outbound rows: JSON lines, text blocks, notification payloads, event feed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.functions.texts import affected_text, iso_time, state_badge

# Wording and defaults of the payloads.
DEFAULT_PRIORITY = "P3"
RAISED_PRIORITY = "P2"
DEFAULT_TEAM = "default"
PUBLIC_COLUMNS = [
    "incident_id",
    "created_at",
    "root_cause_node",
    "primary_event",
    "secondary_nodes",
    "raw_log_count",
    "raw_logs",
    "status",
    "condition",
    "recurrence_count",
]
LINE_COLUMNS = [c for c in PUBLIC_COLUMNS if c not in ("raw_logs", "condition")]


def _iso(columns: list[str]) -> list[Column]:
    return [iso_time(F.col(c)).alias(c) if c == "created_at" else F.col(c) for c in columns]


def public_incidents(incidents: DataFrame) -> DataFrame:
    """The ten public columns."""
    return incidents.select(*PUBLIC_COLUMNS)


def incident_total(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count("*").alias("total"))


def json_lines(incidents: DataFrame) -> DataFrame:
    """Eight columns for ``write.json``: no logs, no condition."""
    return incidents.select(*_iso(LINE_COLUMNS))


def text_blocks(incidents: DataFrame) -> DataFrame:
    """Readable block per incident for ``write.text``."""
    secondary = F.when(
        F.size("secondary_nodes") > 0,
        F.concat(F.lit("  Secondary   : "), F.array_join("secondary_nodes", ", ")),
    )
    return incidents.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("[INCIDENT] "), "incident_id"),
            F.concat(F.lit("  Root Cause  : "), "root_cause_node"),
            F.concat(F.lit("  Event       : "), "primary_event"),
            secondary,
            F.concat(F.lit("  Logs        : "), F.col("raw_log_count").cast("string")),
            F.concat(F.lit("  Status      : "), "status"),
        ).alias("value")
    )


def webhook_payloads(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id",
        F.to_json(
            F.struct(
                "incident_id",
                F.col("root_cause_node").alias("root_cause"),
                "primary_event",
                F.size("secondary_nodes").alias("secondary_affected_count"),
                "secondary_nodes",
                "raw_log_count",
                iso_time(F.col("created_at")).alias("created_at"),
            )
        ).alias("payload"),
    )


def _text(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("text"))


def slack_payloads(incidents: DataFrame) -> DataFrame:
    """Block messages: header, four fields, affected nodes."""
    header = F.to_json(
        F.struct(
            F.lit("header").alias("type"),
            _text(
                "plain_text", F.concat(F.lit("\U0001f6a8 インシデント検知: "), "incident_id")
            ).alias("text"),
        )
    )
    fields = F.to_json(
        F.struct(
            F.lit("section").alias("type"),
            F.array(
                _text("mrkdwn", F.concat(F.lit("*根本原因:*\n"), "root_cause_node")),
                _text("mrkdwn", F.concat(F.lit("*影響ノード数:*\n"), F.size("secondary_nodes").cast("string"))),
                _text("mrkdwn", F.concat(F.lit("*主イベント:*\n`"), "primary_event", F.lit("`"))),
                _text("mrkdwn", F.concat(F.lit("*ログ件数:*\n"), F.col("raw_log_count").cast("string"))),
            ).alias("fields"),
        )
    )
    affected = F.to_json(
        F.struct(
            F.lit("section").alias("type"),
            _text(
                "mrkdwn", F.concat(F.lit("*二次影響ノード:* "), affected_text(F.col("secondary_nodes")))
            ).alias("text"),
        )
    )
    body = F.concat(
        F.lit('{"blocks":['), F.concat_ws(",", header, fields, affected), F.lit("]}")
    )
    return incidents.select("incident_id", body.alias("payload"))


def alert_priority(default: str = DEFAULT_PRIORITY, *, strict: bool = False) -> Column:
    """Raised for flapping or recurring incidents.

    ``strict`` looks for FLAPPING in the status, where it never occurs, instead of the
    condition.
    """
    flapping = F.col("status" if strict else "condition") == "FLAPPING"
    return F.when(flapping | (F.col("recurrence_count") > 0), RAISED_PRIORITY).otherwise(default)


def alert_payloads(
    incidents: DataFrame,
    team_name: str = DEFAULT_TEAM,
    default_priority: str = DEFAULT_PRIORITY,
    *,
    strict: bool = False,
) -> DataFrame:
    again = F.when(
        F.col("recurrence_count") > 0,
        F.concat(F.lit(" / 再発: "), F.col("recurrence_count").cast("string"), F.lit("回")),
    ).otherwise("")
    description = F.concat(
        F.lit("影響ノード: "),
        affected_text(F.col("secondary_nodes")),
        F.lit(" / ログ件数: "),
        F.col("raw_log_count").cast("string"),
        again,
    )
    title = F.concat(
        F.lit("["), "incident_id", F.lit("] "), "root_cause_node", F.lit(": "), "primary_event"
    )
    return incidents.select(
        "incident_id",
        F.to_json(
            F.struct(
                title.alias("title"),
                description.alias("description"),
                F.col("root_cause_node").alias("source"),
                F.lit(team_name).alias("team_name"),
                alert_priority(default_priority, strict=strict).alias("priority"),
            )
        ).alias("payload"),
    )


def resolve_payloads(recoveries: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """One resolve call per recovered node and window, and per closed incident."""
    rows = recoveries.select("domain", "window_start", "hostname").distinct().select(
        F.col("hostname").alias("source")
    )
    if closed is not None:
        rows = rows.unionAll(closed.select("root_cause_node"))
    return rows.select("source", F.to_json(F.struct("source")).alias("payload"))


def event_feed(
    new: DataFrame, recovered: DataFrame | None = None, *, changed: DataFrame | None = None, withdrawn: DataFrame | None = None
) -> DataFrame:
    """Feed rows ``incident.new`` and ``incident.recovered`` with the public incident; corrections after late messages are
    ``incident.changed`` with the new content and ``incident.withdrawn`` with the last one."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        body = F.struct(*_iso(PUBLIC_COLUMNS)).alias("incident")
        fields = [F.lit(kind).alias("type"), body]
        if kind != "incident.new":
            fields.insert(1, F.col("incident_id"))
        return df.select(
            F.lit(kind).alias("type"), "incident_id", F.to_json(F.struct(*fields)).alias("event")
        )

    out = rows(new, "incident.new")
    for df, kind in ((recovered, "recovered"), (changed, "changed"), (withdrawn, "withdrawn")):
        if df is not None:
            out = out.unionByName(rows(df, f"incident.{kind}"))
    return out


def with_badge(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("badge", state_badge())
