"""Syslog line parsing as one projection of native expressions.

A line is tried as RFC 5424, then as RFC 3164, and otherwise kept whole. All
patterns carry the Unicode flag because blanks, digits and word characters are
meant in the Unicode sense.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and constants that decide the results.
_BLANK = r"[\s\x1c-\x1f]"
EVENT_TOKEN = r"(?U)%[A-Z0-9_]+-\d+-[A-Z0-9_]+"
EVENT_TOKEN_NO_DIGITS = r"(?U)%[A-Z_]+-\d+-[A-Z_]+"
EVENT_PARTS = r"(?U)%(\w+)-(\d)-(\w+)"
RECOVERY = (
    r"(?iU)changed\s+state\s+to\s+up\b"
    r"|ADJCHANGE[^\n]*\bUp\b"
    r"|ADJCHG[^\n]*\bto\s+FULL\b"
    r"|%SYS-\d+-RESTART"
)
RFC3164_HEAD = r"(?U)^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+"
DOTTED_QUAD = r"(?U)^\d{1,3}(?:\.\d{1,3}){3}$"
ORIGIN_ID = r"(?U)^\d+:\s+(\S+?):\s+"
FALLBACK_FACILITY = 1
FALLBACK_SEVERITY = 5
ROUTING_TOKENS = ("%BGP-", "%OSPF-", "%ISIS-", "%EIGRP-", "%RIP-")
DEFAULT_DOMAIN = "default"


def strip(text: Column) -> Column:
    """Drop Unicode blanks at both ends; only text with a blank there is rewritten."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    trimmed = F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")
    return F.when(ends.rlike(rf"(?U){_BLANK}"), trimmed).otherwise(text)


def _lstrip(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"(?U)^{_BLANK}+", "")
    return F.when(F.substring(text, 1, 1).rlike(rf"(?U){_BLANK}"), trimmed).otherwise(text)


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def event_type(message: Column) -> Column:
    """First ``%FACILITY-SEVERITY-MNEMONIC`` token, or null."""
    return _or_null(F.regexp_extract(message, EVENT_TOKEN, 0))


def normalized_event(message: Column) -> Column:
    """First event token without digits in its names, or the empty string."""
    return F.regexp_extract(message, EVENT_TOKEN_NO_DIGITS, 0)


def event_parts(event: Column) -> Column:
    """Struct of facility, severity and mnemonic of an event token."""
    return F.struct(
        _or_null(F.regexp_extract(event, EVENT_PARTS, 1)).alias("facility"),
        _or_null(F.regexp_extract(event, EVENT_PARTS, 2)).cast("int").alias("severity"),
        _or_null(F.regexp_extract(event, EVENT_PARTS, 3)).alias("mnemonic"),
    )


def is_recovery(message: Column) -> Column:
    """Recovery wording; the costly pattern only runs where one of its parts occurs."""
    lower = F.lower(message)
    hint = lower.contains("changed") | lower.contains("adjch") | lower.contains("tart")
    return hint & message.rlike(RECOVERY)


def is_routing_event(message: Column) -> Column:
    """True when the message names one of the routing protocols."""
    found = F.lit(False)
    for token in ROUTING_TOKENS:
        found = found | message.contains(token)
    return found


def _priority(body: Column) -> Column:
    """Integer between the angle brackets; blanks, sign and single underscores allowed."""
    number = F.regexp_extract(body, rf"(?U)^{_BLANK}*([+-]?\d+(?:_\d+)*){_BLANK}*$", 1)
    loose = F.replace(number, F.lit("_"), F.lit("")).try_cast("bigint")
    return F.when(body.rlike("^[0-9]{1,9}$"), body.try_cast("bigint")).otherwise(loose)


def _origin_host(host: Column, message: Column) -> Column:
    """Device name from ``<seq>: <name>: `` when the header only has an address."""
    name = _or_null(F.regexp_extract(message, ORIGIN_ID, 1))
    return F.when(host.rlike(DOTTED_QUAD), F.coalesce(name, host)).otherwise(host)


def _header_time(words: Column, year: Column, tz: str) -> Column:
    text = F.concat_ws(" ", year.cast("string"), F.slice(words, 1, 3))
    local = F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))
    return local if tz == "UTC" else F.to_utc_timestamp(local, tz)


def parse_syslog(
    lines: DataFrame,
    *,
    year: int | None = None,
    tz: str = "UTC",
    strict_sd: bool = False,
) -> DataFrame:
    """Raw lines to the message table; works on batch and streaming frames.

    ``year`` completes RFC 3164 header times, which have none (default: the year of
    arrival). ``strict_sd`` reads bracketed RFC 5424 structured data as one field;
    the default splits on blanks only. A ``domain`` column of the input is kept.
    """
    domain = F.col("domain") if "domain" in lines.columns else F.lit(DEFAULT_DOMAIN)
    seq = F.col("seq") if "seq" in lines.columns else F.lit(None).cast("bigint")
    stage = lines.select(
        domain.alias("domain"), seq.alias("seq"), "received_at", "source_ip", strip(F.col("raw")).alias("_text")
    )
    text, close = F.col("_text"), F.locate(">", F.col("_text"))
    bracketed = text.startswith("<") & (close >= 3)
    stage = stage.withColumn(
        "_pri", F.when(bracketed, _priority(F.substring(text, F.lit(2), close - 2)))
    )
    rest = F.col("_rest")
    stage = stage.withColumn(
        "_rest", F.when(F.col("_pri").isNotNull(), F.substring(text, close + 1, F.length(text)))
    )
    # A version number comes first in RFC 5424; only such lines are split into fields.
    stage = stage.withColumn(
        "_parts",
        F.when(
            rest.rlike(rf"(?U)^{_BLANK}*\d+{_BLANK}"),
            F.split(_lstrip(rest), rf"(?U){_BLANK}+", 8),
        ),
    ).withColumn("_head", F.regexp_extract(rest, RFC3164_HEAD, 0))
    parts, head = F.col("_parts"), F.col("_head")
    is5424 = F.coalesce(F.size(parts) >= 6, F.lit(False))
    is3164 = F.coalesce(head != "", F.lit(False))
    words = F.split(head, r"(?U)\s+")
    body5424 = F.when(F.size(parts) >= 8, strip(F.get(parts, F.lit(7)))).otherwise("")
    if strict_sd:
        tail = F.regexp_extract(rest, r"(?sU)^\s*(?:\S+\s+){6}(.*)$", 1)
        after_sd = F.regexp_extract(
            tail, r'(?sU)^(?:-|(?:\[(?:[^\]"\\]|\\.|"(?:[^"\\]|\\.)*")*\])+)(?:\s+(.*))?$', 1
        )
        body5424 = F.when(tail.startswith("["), strip(after_sd)).otherwise(body5424)

    header_year = F.lit(year) if year is not None else F.year("received_at")
    stage = stage.withColumn(
        "_m",
        F.when(
            is5424,
            F.struct(
                F.lit("rfc5424").alias("format"),
                F.when(parts[2] != "-", parts[2]).otherwise(F.col("source_ip")).alias("host"),
                body5424.alias("message"),
                parts[1].try_cast("timestamp").alias("event_ts"),
            ),
        )
        .when(
            is3164,
            F.struct(
                F.lit("rfc3164").alias("format"),
                words[3].alias("host"),
                strip(F.substring(rest, F.length(head) + 1, F.length(rest))).alias("message"),
                _header_time(words, header_year, tz).alias("event_ts"),
            ),
        )
        .otherwise(
            F.struct(
                F.lit("raw").alias("format"),
                F.col("source_ip").alias("host"),
                F.col("_text").alias("message"),
                F.lit(None).cast("timestamp").alias("event_ts"),
            )
        ),
    )
    message = F.col("_m.message")
    structured = F.col("_m.format") != "raw"
    parsed = F.struct(
        "domain",
        "seq",
        "received_at",
        F.col("_m.event_ts").alias("event_ts"),
        "source_ip",
        F.when(structured, _origin_host(F.col("_m.host"), message))
        .otherwise(F.col("_m.host"))
        .alias("hostname"),
        F.when(structured, F.shiftright("_pri", 3).try_cast("int"))
        .otherwise(F.lit(FALLBACK_FACILITY))
        .alias("facility"),
        F.when(structured, F.col("_pri").bitwiseAND(F.lit(7)).cast("int"))
        .otherwise(F.lit(FALLBACK_SEVERITY))
        .alias("severity"),
        message.alias("message"),
        event_type(message).alias("event_type"),
        is_recovery(message).alias("is_recovery"),
        F.col("_m.format").alias("format"),
    )
    # One row out for one in, through a generator: no later filter can be moved below it, where the
    # optimizer would write the whole parser once into every condition.
    return stage.select(F.inline(F.array(parsed)))


def parse_tagged(lines: DataFrame) -> DataFrame:
    """``Host:<name> <text>`` lines: first token names the host, the rest is the message."""
    text = strip(F.col("raw"))
    parts = F.split(text, " ", 2)
    domain = F.col("domain") if "domain" in lines.columns else F.lit(DEFAULT_DOMAIN)
    message = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("")
    return lines.select(
        domain.alias("domain"),
        "seq",
        "received_at",
        F.regexp_replace(parts[0], r"^Host:", "").alias("hostname"),
        message.alias("message"),
        event_type(message).alias("event_type"),
    )
