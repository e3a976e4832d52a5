"""Readers that yield raw lines: files, streams, payloads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens import schema
from alarmlens.functions.parse import DEFAULT_DOMAIN, strip

FILE_SOURCE = "file"
PAYLOAD_SOURCE = "127.0.0.1"


def _as_lines(values: DataFrame, received_at) -> DataFrame:
    return values.filter(strip(F.col("value")) != "").select(
        F.col("value").alias("raw"),
        F.lit(FILE_SOURCE).alias("source_ip"),
        received_at.alias("received_at"),
    )


def with_arrival_order(lines: DataFrame) -> DataFrame:
    """Add ``seq``, growing with the position in the input, where it is missing."""
    if "seq" in lines.columns:
        return lines
    return lines.withColumn("seq", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str, *, received_at=None) -> DataFrame:
    """Log file(s) to raw lines; blank lines are dropped.

    ``received_at`` defaults to the time of the run, since a file carries no arrival time.
    """
    when = F.current_timestamp() if received_at is None else F.lit(received_at).cast("timestamp")
    return with_arrival_order(_as_lines(spark.read.text(path), when))


def stream_lines(spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of growing log text as a stream of raw lines.

    The arrival time is that of the micro-batch; the live job numbers the lines inside it.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _as_lines(reader.load(path), F.current_timestamp())


def stream_datagrams(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A folder of collected datagrams, one JSON object per line in the raw-line schema."""
    return spark.readStream.schema(schema.RAW_LINES).options(**options).json(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic whose key is the sender address and whose value is the datagram."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return source.select(
        F.make_valid_utf8(F.col("value").cast("string")).alias("raw"),
        F.col("key").cast("string").alias("source_ip"),
        F.col("timestamp").alias("received_at"),
        F.col("offset").alias("seq"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Direct batch payloads, one JSON object per line."""
    return spark.read.schema(schema.PAYLOADS).json(path)


def payload_lines(payloads: DataFrame) -> DataFrame:
    """Explode payloads to raw lines; every payload is its own domain and window."""
    return payloads.select(
        F.col("payload_id").alias("domain"),
        F.col("received_at"),
        F.posexplode("messages").alias("seq", "m"),
    ).select(
        "domain",
        F.col("m.raw").alias("raw"),
        F.coalesce(F.col("m.source_ip"), F.lit(PAYLOAD_SOURCE)).alias("source_ip"),
        "received_at",
        F.col("seq").cast("bigint").alias("seq"),
    )


def with_domain(lines: DataFrame, column=None) -> DataFrame:
    return lines.withColumn("domain", F.lit(DEFAULT_DOMAIN) if column is None else column)
