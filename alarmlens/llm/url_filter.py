"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules are a short list that travels in the plan. A host is looked up with all its parent domains, so a rule for a
domain covers its subdomains without a join. URLs that a rule judges are the labelled rows that the
trees learn from; suffix statistics are counted over all labelled rows. A row the trees learn from sees the statistics
without its own fold, so that its label is not among its features.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.tables import ALPHA_LOWER, ALPHA_UPPER, bounded_sample
from alarmlens.runtime import materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ALPHA_UPPER, ALPHA_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Of equal lengths the later text wins."""
    by_host: dict[str, list[UrlRule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entries = []
    for domain, own in by_host.items():
        listed = F.array(*[F.struct(F.lit(r.path).alias("path"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in own])
        entries += [F.lit(domain), listed]
    known = F.create_map(*entries)
    deepest = max(domain.count(".") + 1 for domain in by_host)
    domains = F.array(*[F.substring_index(host, ".", -k) for k in range(1, deepest + 1)])
    fitting = F.filter(
        F.flatten(F.transform(domains, lambda d: F.coalesce(F.try_element_at(known, d), F.slice(entries[1], 1, 0)))),
        lambda r: F.startswith(path, r["path"]),
    )
    return F.array_max(
        F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    )


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    return -F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda acc, c: acc
        + F.when(c == "", F.lit(0.0)).otherwise(
            (size - F.length(F.replace(text, c, F.lit("")))) / size * F.log2((size - F.length(F.replace(text, c, F.lit("")))) / size)
        ),
    )


LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "host_hyphens",
    "host_entropy", "parameters", "query_length", "fragment", "secure",
)
SUFFIX = ("suffix_share", "suffix_rate", "domain_share", "domain_rate")


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features to ``(url, host, path)``."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    features = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _count(host, "[0-9]"),
        "host_hyphens": _count(host, "-"),
        "host_entropy": F.when(host == "", F.lit(0.0)).otherwise(_entropy(host)),
        "parameters": F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(F.lower(F.substring(url, 1, 8)), F.lit("https://")).cast("int"),
    }
    return pages.withColumns({k: v.cast("double") for k, v in features.items()})


#: Parts of the labelled rows for statistics that leave a row's own label out; equal URLs share a part.
FOLDS = 5


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def _with_suffixes(rows: DataFrame, labelled: DataFrame, *, own_fold_out: bool = False) -> DataFrame:
    """Share of labelled URLs and smoothed rate of blocked ones for the last label and the last two labels of the host.

    ``own_fold_out``: the rows are labelled ones themselves; each gets the statistics of the other folds.
    """
    fold = _fold(F.col("url"))
    sizes = {r["fold"]: r["n"] for r in labelled.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = F.lit(max(sum(sizes.values()), 1))
    if own_fold_out:
        rows = rows.withColumn("fold", fold)
        others = F.array(*[F.lit(max(sum(sizes.values()) - sizes.get(k, 0), 1)) for k in range(FOLDS)])
        total = F.get(others, F.col("fold"))
    for name, depth in (("suffix", 1), ("domain", 2)):
        key = F.substring_index("host", ".", -depth)
        parts = labelled.groupBy(key.alias(name), fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
        counts, on = parts.groupBy(name).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), [name]
        if own_fold_out:
            parts, on = materialize(parts, f"{name}_folds"), [name, "fold"]
            every = parts.groupBy(name).agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
            counts = parts.join(every, name).select(*on, (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_blocked") - F.col("blocked")).alias("blocked"))
        stats = materialize(
            counts.select(*on, (F.col("n") / total).alias(f"{name}_share"), ((F.col("blocked") + 1) / (F.col("n") + 2)).alias(f"{name}_rate")),
            f"{name}_stats",
        )
        rows = rows.withColumn(name, key).join(stats, on, "left").drop(name)
        rows = rows.fillna({f"{name}_share": 0.0, f"{name}_rate": 0.5})
    return rows.drop("fold")


def _features() -> VectorAssembler:
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features")


def _fit(labelled: DataFrame, max_training: int, trees: int, depth: int):
    sample = bounded_sample(labelled, max_training, "id", "url")
    training = materialize(_with_suffixes(lexical(sample), labelled, own_fold_out=True), "training")
    return GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(_features().transform(training))


def _labelled(pages: DataFrame, id_col: str, url_col: str, rules: tuple[UrlRule, ...]) -> tuple[DataFrame, DataFrame]:
    """All rows with their rule (``fit``), and those that a rule judges with ``label`` (1: block)."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = materialize(base.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)), "judged")
    return judged, judged.filter("fit is not null").withColumn("label", (F.col("fit.verdict") == "block").cast("int"))


def held_out_accuracy(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES,
    max_training: int = 100_000, trees: int = 20, depth: int = 4,
) -> DataFrame:
    """Per suffix: rule-judged URLs of one fold, how many of them are blocked, and how many the trees judge alike that learn from
    the other folds. Rules must judge both ways in these."""
    _, labelled = _labelled(pages, id_col, url_col, rules)
    own = _fold(F.col("url")) == 0
    rest = labelled.filter(~own)
    model = _fit(rest, max_training, trees, depth)
    scored = model.transform(_features().transform(_with_suffixes(lexical(labelled.filter(own)), rest)))
    right = (vector_to_array("probability")[1] >= 0.5).cast("int") == F.col("label")
    return scored.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(
        F.count(F.lit(1)).alias("urls"), F.sum("label").alias("blocked"), F.count_if(right).alias("right")
    )


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[UrlRule, ...] = RULES,
    max_training: int = 100_000,
    trees: int = 20,
    depth: int = 4,
) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (of block; null where a rule decides).

    Null URLs and URLs without ``://`` have an empty host and path; no rule fits them and the trees judge. The trees learn from about
    ``max_training`` URLs at most that a rule judges. Where rules judge none, the verdict is allow; where all have one
    verdict, it is that one. Repeated rows give repeated rows.
    """
    judged, labelled = _labelled(pages, id_col, url_col, rules)
    classes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest = judged.filter("fit is null")
    if len(classes) < 2:
        scored = rest.withColumn("score", F.lit(float(next(iter(classes), 0))))
    else:
        model = _fit(labelled, max_training, trees, depth)
        scored = model.transform(_features().transform(_with_suffixes(lexical(rest), labelled)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    scored = scored.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), "score")
    ruled = judged.filter("fit is not null").select("id", "host", "path", "fit.rule", "fit.verdict", F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(scored).withColumnRenamed("id", id_col)
