"""Texts built from incident rows: fingerprint, documents, prompts, labels, JSON."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alarmlens.functions.parse import normalized_event

# Wording that has to match the expected output.
SILENT_EVENT = "(inferred — node did not send SYSLOG)"
NONE_AFFECTED = "なし"
BADGE_CLOSED = "復旧済"
BADGE_FLAPPING = "フラッピング"
BADGE_NEW = "新規発生"
BADGE_RECURRING = "再発 (%d回目)"
SUMMARY_LABELS = {
    "id": "- インシデントID: ",
    "root": "- 根本原因ノード: ",
    "event": "- 主要イベント: ",
    "secondary": "- 二次影響ノード: ",
    "count": "- 関連ログ数: ",
}
PROMPT_HEAD = (
    "あなたはネットワーク障害解析の専門家AIです。\n"
    "以下の情報を元に、日本語でインシデントレポートを作成してください。\n"
    "\n"
    "## 現在のインシデント\n"
)
PROMPT_TAIL = (
    "\n"
    "## レポート形式（必ず以下の項目を含めること）\n"
    "1. **障害概要** — 何が起きたか 1〜2 行で\n"
    "2. **根本原因の分析** — 最も可能性の高い原因と根拠\n"
    "3. **影響範囲** — 影響ノードと想定される業務影響\n"
    "4. **推奨対応** — 即時対応 / 恒久対応の具体的手順\n"
    "5. **予防策** — 再発防止のための提言\n"
)
PROMPT_CASES_HEAD = "\n## 過去の類似インシデント（参考）\n"
PROMPT_CASES_TAIL = "\n\n"
CASE_SEPARATOR = "\n---\n"
JSON_SHORT_ESCAPES = {
    "0008": "\\b",
    "0009": "\\t",
    "000A": "\\n",
    "000C": "\\f",
    "000D": "\\r",
    "0022": '\\"',
    "005C": "\\\\",
}
DOCUMENT_LOGS = 8
SUMMARY_LOGS = 10


def flapping_event(event: Column, count: Column) -> Column:
    return F.concat(
        F.lit("FLAPPING: "), event, F.lit(" repeated "), count.cast("string"), F.lit("x in window")
    )


def json_ascii(text: Column) -> Column:
    """JSON string literal in ASCII: other characters become ``\\uXXXX`` units.

    Text without anything to escape, the normal case for device names, takes the
    short branch.
    """
    plain = text.rlike(r"^[\x20-\x21\x23-\x5b\x5d-\x7e]*$")
    code = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(
        F.sequence(F.lit(1), F.length(code), F.lit(4)), lambda i: F.substr(code, i, F.lit(4))
    )

    def escape(unit: Column) -> Column:
        out = F.when(
            (unit >= "0020") & (unit <= "007E"), F.char(F.conv(unit, 16, 10).cast("int"))
        ).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))
        for hex_unit, short in JSON_SHORT_ESCAPES.items():
            out = F.when(unit == hex_unit, F.lit(short)).otherwise(out)
        return out

    body = F.when(plain, text).otherwise(F.array_join(F.transform(units, escape), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def fingerprint(root: Column, primary_event: Column, secondary: Column) -> Column:
    """SHA-256 of the key-sorted JSON of root, normalized event and sorted nodes."""
    nodes = F.array_join(F.transform(F.array_sort(secondary), json_ascii), ", ")
    text = F.concat(
        F.lit('{"et": '),
        json_ascii(normalized_event(primary_event)),
        F.lit(', "rc": '),
        json_ascii(root),
        F.lit(', "sn": ['),
        nodes,
        F.lit("]}"),
    )
    return F.sha2(text, 256)


def _optional_list(prefix: str, nodes: Column) -> Column:
    return F.when(F.size(nodes) > 0, F.concat(F.lit(prefix), F.array_join(nodes, ", ")))


def _log_lines(prefix: str, logs: Column, n: int) -> Column:
    picked = F.transform(F.slice(logs, 1, n), lambda x: F.concat(F.lit(prefix), x))
    return F.when(F.size(logs) > 0, F.array_join(picked, "\n"))


def incident_document() -> Column:
    """Text that represents an incident in similarity search."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("RootCause: "), F.col("root_cause_node")),
        F.concat(F.lit("PrimaryEvent: "), F.col("primary_event")),
        _optional_list("SecondaryNodes: ", F.col("secondary_nodes")),
        _log_lines("Log: ", F.col("raw_logs"), DOCUMENT_LOGS),
    )


def incident_summary() -> Column:
    """Text that describes an incident inside a report prompt."""
    label = SUMMARY_LABELS
    return F.concat_ws(
        "\n",
        F.concat(F.lit(label["id"]), F.col("incident_id")),
        F.concat(F.lit(label["root"]), F.col("root_cause_node")),
        F.concat(F.lit(label["event"]), F.col("primary_event")),
        _optional_list(label["secondary"], F.col("secondary_nodes")),
        F.concat(F.lit(label["count"]), F.col("raw_log_count").cast("string")),
        _log_lines("  - ", F.col("raw_logs"), SUMMARY_LOGS),
    )


def report_prompt(summary: Column, similar_docs: Column) -> Column:
    """Prompt text; the section on similar cases only appears when there are some."""
    cases = F.when(
        F.size(similar_docs) > 0,
        F.concat(
            F.lit(PROMPT_CASES_HEAD),
            F.array_join(similar_docs, CASE_SEPARATOR),
            F.lit(PROMPT_CASES_TAIL),
        ),
    ).otherwise("")
    return F.concat(F.lit(PROMPT_HEAD), summary, F.lit("\n"), cases, F.lit(PROMPT_TAIL))


def affected_text(nodes: Column) -> Column:
    return F.when(F.size(nodes) > 0, F.array_join(nodes, ", ")).otherwise(F.lit(NONE_AFFECTED))


def state_badge() -> Column:
    """Label of the incident state for display."""
    again = F.col("recurrence_count")
    return (
        F.when(F.col("status").isin("CLOSED", "RESOLVED"), F.lit(BADGE_CLOSED))
        .when(F.col("condition") == "FLAPPING", F.lit(BADGE_FLAPPING))
        .when(again > 0, F.format_string(BADGE_RECURRING, again + 1))
        .otherwise(F.lit(BADGE_NEW))
    )


def iso_time(ts: Column) -> Column:
    """ISO 8601 in UTC; microseconds only when they are not zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )
