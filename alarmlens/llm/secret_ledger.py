"""Secret scans over a ledger of content-addressed blobs, in DataFrame expressions only.

Every version of every path is named by the SHA-256 of its bytes. The ledger holds which pair of blob and rule
version has been scanned and what was found. A run scans only pairs that the ledger doesn't have,
appends them, and joins the findings of each blob back to all paths and versions that hold it: a
text with a million copies is scanned once, and a changed rule is run alone.

Findings are written before the pairs that mark them as scanned, and reading takes each finding once, so a
run that breaks off is repeated without loss and without double rows.
"""
from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from alarmlens.runtime import materialize, run_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# The base rules, in the order that breaks ties of equal starts.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

# Shapes of secrets beyond the base rules. Every repetition is bounded or cannot run on, so a long text takes linear time.
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("provider", r"gh[pousr]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]+|AIza[A-Za-z0-9_-]+", 0, 20),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,256}:[^\x00-\x20/:@]{1,256}@", 0, 1),
)

_SEEN = "blob string, rule_version string"
_FOUND = "blob string, rule_version string, kind string, start int, end int"


class Ledger:
    """Two growing Parquet tables under ``path``, a folder every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        files = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SEEN)

    def findings(self) -> DataFrame:
        return self._read("findings", _FOUND).distinct()

    def append(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.path}/findings")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{run_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}")


def _row_of(rule: Rule):
    def row(z: Column, n: Column) -> Column:
        return F.struct(
            F.lit(rule.version).alias("rule_version"),
            F.lit(rule.kind).alias("kind"),
            n.alias("n"),
            F.length(z["piece"]).alias("gap"),
            F.length(z["match"]).alias("size"),
            (F.length(z["value"]) >= rule.least).alias("holds"),
        )

    return row


def _scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in ``(blob, text, todo)``; ``todo`` lists the rule versions to run. Positions in code points, end exclusive.

    A match's start is the length of all pieces and matches before it, summed along the text.
    """
    wide = texts
    for i, rule in enumerate(rules):
        wanted = F.array_contains("todo", rule.version)
        matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        wide = wide.withColumn(f"m{i}", F.when(wanted, matches).otherwise(F.array().cast("array<string>")))
    parts = []
    for i, rule in enumerate(rules):
        values = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col(f"m{i}")
        zipped = F.arrays_zip(
            F.col(f"m{i}").alias("match"), F.split("text", rule.pattern).alias("piece"), values.alias("value")
        )
        rows = F.transform(F.slice(zipped, F.lit(1), F.size(f"m{i}")), _row_of(rule))
        parts.append(F.when(F.size(f"m{i}") > 0, rows).otherwise(F.slice(rows, 1, 0)))
    found = wide.select("blob", F.inline(F.concat(*parts)))
    along = W.Window.partitionBy("blob", "rule_version").orderBy("n")
    ended = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int"))
    return ended.filter("holds").select("blob", "rule_version", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def scan(
    versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = BASE_RULES, path_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``versions`` (every historical version of every path): path, blob, spans.

    ``spans`` is an array of (start, rank of the rule, kind, end) in that order. Null texts count as empty. Rows
    with null or repeated paths are versions like any other. An empty table gives no rows and leaves the ledger as it is.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = versions.select(
        F.col(path_col).alias("path"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob")
    )
    named = materialize(source.select("path", "blob"), "versions")
    wanted = F.array(*[F.lit(r.version) for r in rules])
    seen = ledger.scanned().groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    open_blobs = (
        named.select("blob")
        .distinct()
        .join(seen, "blob", "left")
        .select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    open_blobs = materialize(open_blobs, "open_blobs")
    texts = source.select("blob", "text").dropDuplicates(["blob"]).join(open_blobs, "blob")
    ledger.append(_scan(texts, rules), open_blobs.select("blob", F.explode("todo").alias("rule_version")))

    ranks = [F.when(F.col("rule_version") == r.version, F.lit(i)) for i, r in enumerate(rules)]
    current = ledger.findings().withColumn("rank", F.coalesce(*ranks)).filter("rank is not null")
    of_blob = current.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return named.join(of_blob, "blob", "left").select(
        F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
