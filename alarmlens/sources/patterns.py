"""Ignore patterns: defaults, text files, extra literals."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens import schema
from alarmlens.functions.parse import strip

# Fixed value: the pattern that is always ignored.
DEFAULT_PATTERNS = ("%LINK-2-INTVULN",)


def literal_patterns(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in patterns if p], schema.PATTERNS)


def default_patterns(spark: SparkSession) -> DataFrame:
    return literal_patterns(spark, DEFAULT_PATTERNS)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """One pattern per line; blank lines and ``#`` comments are skipped."""
    text = strip(F.col("value"))
    return (
        spark.read.text(path)
        .select(text.alias("pattern"))
        .filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    )


def effective_patterns(
    spark: SparkSession,
    path: str | None = None,
    extra: Iterable[str] = (),
    *,
    include_defaults: bool = True,
) -> DataFrame:
    """Union of defaults, file and extra literals; duplicates are kept."""
    out = literal_patterns(spark, extra)
    if path:
        out = read_patterns(spark, path).unionByName(out)
    if include_defaults:
        out = default_patterns(spark).unionByName(out)
    return out
