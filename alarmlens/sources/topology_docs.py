"""Readers for topology documents: JSON, YAML, document columns."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens import schema


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Topology JSON files, one document per file."""
    return (
        spark.read.schema(schema.TOPOLOGY_DOC)
        .option("multiLine", True)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("doc_id"))
    )


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for batch in batches:
        text = [json.dumps(yaml.safe_load(doc)) for doc in batch["value"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "doc": text})


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Topology YAML files; each file is one site document, files parse in parallel."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), "value"
    )
    return from_column(texts.mapInPandas(_yaml_to_json, "doc_id string, doc string"), "doc")


def from_column(docs: DataFrame, column: str, id_column: str = "doc_id") -> DataFrame:
    """Documents held as JSON text in a column."""
    parsed = docs.select(
        F.col(id_column).cast("string").alias("doc_id"),
        F.from_json(F.col(column), schema.TOPOLOGY_DOC).alias("d"),
    )
    return parsed.select("doc_id", "d.*")


def read_supporting_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Edges parent to child from documents that list supporting nodes."""
    docs = spark.read.schema(schema.SUPPORTING_NODE_DOC).option("multiLine", True).json(path)
    return supporting_edges(docs)


def supporting_edges(docs: DataFrame) -> DataFrame:
    nodes = docs.select(F.explode(F.col("`ietf-network:networks`.network")).alias("net")).select(
        F.explode("net.node").alias("n")
    )
    return nodes.select(
        F.explode(F.col("n.`ietf-network-topology:supporting-node`")).alias("s"),
        F.col("n.`node-id`").alias("dst"),
    ).select(F.col("s.`node-ref`").alias("src"), "dst").distinct()
