"""Message filters and flags."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.runtime import materialize

# Up to this many patterns become one native predicate inside the scan stage; a larger list goes through a gram index.
_INLINE_PATTERNS = 64
GRAM = 6


def drop_ignored(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Drop messages that contain any pattern (literal, case-sensitive); a null message contains none."""
    wanted = patterns.filter(F.coalesce(F.col("pattern"), F.lit("")) != "").distinct()
    head = [row.pattern for row in wanted.take(_INLINE_PATTERNS + 1)]
    if not head:
        return messages
    if len(head) <= _INLINE_PATTERNS:
        return messages.filter(~_contains_any(F.col("message"), head))
    return messages.join(texts_with_pattern(messages.select("message"), wanted), "message", "left_anti")


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given lengths."""

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        every = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    held = [of_size(n) for n in sizes]
    return F.array_distinct(F.concat(*held))


def texts_with_pattern(texts: DataFrame, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """Distinct ``message`` values of ``texts`` that contain a ``pattern``, for lists of any length.

    Each pattern is looked for at its gram that the fewest texts hold, by an equality join; only texts with that gram
    are compared with the pattern. A pattern with a gram that no text holds is out at once. Patterns shorter
    than a gram are grams of their own length. Both sides meet by key, so neither has to fit into a task.
    """
    wanted = patterns.select("pattern", F.least(F.length("pattern"), F.lit(gram)).alias("size"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # ``gram`` numbers at most
    keys = materialize(
        wanted.select("pattern", F.explode(_grams(F.col("pattern"), sizes)).alias("gram"), "size").filter(F.length("gram") == F.col("size")),
        "pattern_grams",
    )
    held = texts.filter(F.col("message").isNotNull()).distinct()
    held = materialize(held.select("message", F.explode(_grams(F.col("message"), sizes)).alias("gram")).join(keys.select("gram").distinct(), "gram", "left_semi"), "text_grams")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    weighed = keys.join(counts, "gram", "left").groupBy("pattern").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest")
    )
    chosen = weighed.filter("rarest.texts > 0").select("pattern", F.col("rarest.gram").alias("gram"))
    met = held.join(chosen, "gram").filter(F.contains(F.col("message"), F.col("pattern")))
    return met.select("message").distinct()


def _contains_any(text: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.coalesce(text.contains(pattern), F.lit(False))
    return found


def is_active(threshold: int = 5) -> Column:
    """Severe enough to count as evidence; less severe rows only appear among the logs."""
    return F.col("severity") <= threshold


def known_hosts(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    return messages.join(nodes.select(F.col("id").alias("hostname")), "hostname", "left_semi")


def unknown_hosts(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct hosts that sent messages but are not in the topology."""
    hosts = messages.select("domain", "hostname").distinct()
    return hosts.join(nodes.select(F.col("id").alias("hostname")), "hostname", "left_anti").select(
        "domain", "hostname"
    )


def drop_recoveries(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("is_recovery"))


def recovery_nodes(messages: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Known hosts with a recovery message of any severity, per window."""
    recoveries = messages.filter("is_recovery").select(*keys, "hostname").distinct()
    return known_hosts(recoveries, nodes).select(*keys, "hostname")
