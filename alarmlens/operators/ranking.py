"""Row numbers over groups of any size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.runtime import materialize

_ROW_MASK = (1 << 33) - 1


def global_row_number(
    df: DataFrame, group: list[str], order: list[str | Column], name: str
) -> DataFrame:
    """``row_number()`` per group in the given order, without one task per group.

    The rows are range-partitioned by group and order, so a hot group spreads over many
    sorted partitions. A row's number is its position in its partition plus the number
    of rows of its group in earlier partitions; that table has at most one row per
    group and partition. The order has to be total for a repeatable result.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33).alias("_part")
    pieces = placed.groupBy(*group, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *group, "_part", "_first", "_before"
    )
    return (
        placed.withColumn("_part", part)
        .join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_at", "_part", "_first", "_before")
    )


def first_per_group(
    df: DataFrame, group: list[str], order: list[str | Column], n: int, name: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each group, numbered from 1.

    Spark applies the rank limit before the shuffle too, so a task receives at most
    ``n`` rows of a group from each upstream task.
    """
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(
        F.col(name) <= n
    )
