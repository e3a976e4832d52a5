"""Input tables and small column helpers of the text operators."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHA_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHA_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with null texts as empty; every other column is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))


def text_sha256(text_col: str) -> Column:
    """Digest of the text, which with the id names a row; null texts count as empty."""
    return F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("text_sha256")


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as empty text."""
    as_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(as_text.cast("binary")), F.lit(modulus))


def bounded_sample(rows: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``keys``; all rows where there are fewer.

    Equal rows are chosen together and the choice does not depend on how the table is cut into files. Only for
    fitting a model on labelled rows.
    """
    total = rows.count()
    if total <= bound:
        return rows
    place = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1_000_000))
    return rows.filter(place < int(1_000_000 * bound / total))


def summed(partial: DataFrame) -> dict[int, float]:
    """Sums by place of ``(place, value)`` rows; the places are a fixed number set by the model, not the data."""
    return {r["place"]: r["total"] for r in partial.groupBy("place").agg(F.sum("value").alias("total")).collect()}


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker turns few texts into Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
