"""A corpus pipeline in five stages, each written to Parquet and read again by the next.

Language ID drops documents without a language; exact dedup keeps one of equal texts; SimHash near-dedup keeps one
document of each group; decontamination drops documents that hold passages of the benchmark; byte-level BPE
encodes what is left. Stages take (spark, docs, sf_dir); all but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.llm import bpe, decontaminate, exact_dedup, language_id, simhash_dedup
from alarmlens.llm.queries import vocabulary
from alarmlens.llm.tables import table, text_sha256
from alarmlens.runtime import materialize

#: SQL can train no network.
ORACLE_SQL = None


ROW = "_row"


def _row():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("*", _row().alias(ROW), text_sha256("text"))


def _kept(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are in ``keep`` (doc_id, text_sha256). Null is an id like any other."""
    names = materialize(keep.select(_row().alias(ROW), "text_sha256").distinct(), "kept")
    return _named(docs).join(names, [ROW, "text_sha256"], "left_semi").select(*docs.columns)


def _kept_once(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """As ``_kept``, but of repeated rows one; ``kept`` (doc_id, text_sha256, _rows) has one row per row kept."""
    kept = materialize(kept.select(_row().alias(ROW), "text_sha256", "_rows"), "kept")
    once = _named(docs).join(kept.filter("_rows = 1"), [ROW, "text_sha256"], "left_semi")
    more = _named(docs).join(kept.filter("_rows > 1"), [ROW, "text_sha256"], "left_semi").dropDuplicates([ROW, "text_sha256"])
    return once.unionByName(more).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters go. Learns from the documents of ``sf_dir``."""
    judged = language_id.languages(docs, learn_from=table(spark, sf_dir, "documents"), digests=True)
    return _kept(docs, judged.filter(F.col("lang_pred") != language_id.UNDETERMINED))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; of repeated rows of it, one."""
    kept = exact_dedup.exact_groups(docs).filter("kept").groupBy("doc_id", "text_sha256")
    return _kept_once(docs, kept.agg(F.count(F.lit(1)).alias("_rows")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that with the smallest doc_id, of several with it (or, in a group
    without ids, with null) that with the smallest digest of its text; of repeated rows of it, one."""
    first = simhash_dedup.near_groups(docs, digests=True).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    versions = first.groupBy("component", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
    least = versions.groupBy("component", "doc_id").agg(F.min(F.struct("text_sha256", "_rows")).alias("least"))
    return _kept_once(docs, least.select("doc_id", "least.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in any benchmark passage."""
    report = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), digests=True)
    return _kept(docs, report.filter(~F.col("contaminated")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
