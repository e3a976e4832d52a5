"""Report work-lists: fingerprints, report cache, similar incidents, prompts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.functions import texts
from alarmlens.operators.incidents import SIMILAR_ROWS, similar_by_root, upsert
from alarmlens.operators.similar import nearest
from alarmlens.runtime import materialize

# Cache lifetime and number of similar cases in a prompt.
CACHE_TTL_DAYS = 7
PROMPT_CASES = 3


def with_fingerprint(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn(
        "fingerprint",
        texts.fingerprint(F.col("root_cause_node"), F.col("primary_event"), F.col("secondary_nodes")),
    )


def _is_live(as_of: Column, ttl_days: int) -> Column:
    return F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(ttl_days))


def cache_lookup(
    incidents: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = CACHE_TTL_DAYS
) -> DataFrame:
    """Attach the cached ``report`` of each incident, null when there is none alive."""
    live = cache.filter(_is_live(as_of, ttl_days)).select("fingerprint", "report")
    return with_fingerprint(incidents).join(live, "fingerprint", "left")


def cache_put(cache: DataFrame, reports: DataFrame) -> DataFrame:
    """Upsert (fingerprint, report, created_at) rows; one row per fingerprint, newest wins."""
    newest = reports.groupBy("fingerprint").agg(
        F.max_by("report", F.struct("created_at", "report")).alias("report"),
        F.max("created_at").alias("created_at"),
    )
    return upsert(cache, newest, "fingerprint")


def cache_purge(cache: DataFrame, as_of: Column, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    return cache.filter(_is_live(as_of, ttl_days))


def incident_documents(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id", texts.incident_document().alias("document"), "root_cause_node", "created_at"
    )


def corpus_put(corpus: DataFrame, incidents: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Upsert incidents, with their vectors if given, into the similarity corpus."""
    rows = incident_documents(incidents).withColumnRenamed("root_cause_node", "root_cause")
    if "embedding" in corpus.columns:
        rows = rows.join(vectors, "incident_id", "left")
    return upsert(corpus, rows)


def similar_documents(vectors: DataFrame, corpus: DataFrame, n: int = PROMPT_CASES) -> DataFrame:
    """Documents of the ``n`` nearest corpus incidents, nearest first, as an array.

    Incidents with the same nearest ones share one array: documents are joined once per distinct list of identifiers.
    """
    hits = nearest(vectors, corpus, n, id_col="incident_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))).alias("listed")
    lists = materialize(hits.groupBy(F.col("query_id").alias("incident_id")).agg(listed), "nearest_lists")
    docs = corpus.select(F.col("incident_id").alias("neighbor_id"), "document")
    picked = F.array_sort(F.collect_list(F.struct("rank", "document")))
    distinct = lists.select("listed").distinct().select("listed", F.inline("listed"))
    texts_of = distinct.join(docs, "neighbor_id").groupBy("listed").agg(F.transform(picked, lambda x: x.document).alias("similar_docs"))
    return lists.join(texts_of, "listed").select("incident_id", "similar_docs")


def report_worklist(
    incidents: DataFrame,
    cache: DataFrame,
    as_of: Column,
    *,
    similar: DataFrame | None = None,
    ttl_days: int = CACHE_TTL_DAYS,
) -> DataFrame:
    """One row per incident: the cached report, or the prompt that would produce one.

    ``similar`` has ``incident_id`` and ``similar_docs``.
    """
    looked_up = cache_lookup(incidents, cache, as_of, ttl_days)
    if similar is None:
        looked_up = looked_up.withColumn("similar_docs", F.array().cast("array<string>"))
    else:
        looked_up = looked_up.join(similar, "incident_id", "left")
    # An empty report counts as a miss.
    hit = F.coalesce(F.col("report") != "", F.lit(False))
    return looked_up.select(
        "incident_id",
        "fingerprint",
        F.when(hit, "cached").otherwise("to_ask").alias("state"),
        F.when(hit, F.col("report")).alias("report"),
        F.when(~hit, texts.report_prompt(texts.incident_summary(), F.col("similar_docs"))).alias("prompt"),
    )


def answer_prompts(worklist: DataFrame, ask) -> DataFrame:
    """Fill open reports with a caller's pandas UDF from prompt to text; one call per fingerprint."""
    open_rows = worklist.filter("state = 'to_ask'").groupBy("fingerprint").agg(
        F.min_by("prompt", "incident_id").alias("prompt")
    )
    return open_rows.select("fingerprint", ask("prompt").alias("report"))


def similar_incidents(
    incidents: DataFrame, vectors: DataFrame | None = None, n: int = SIMILAR_ROWS
) -> DataFrame:
    """Similar incidents of every incident, tagged with where the answer came from.

    With vectors the neighbours are semantic, otherwise the newest of the same root.
    """
    if vectors is not None:
        pairs = nearest(vectors, vectors, n, id_col="incident_id").select(
            F.col("query_id").alias("incident_id"), "rank", F.col("neighbor_id").alias("similar_id")
        )
        source = "rag"
    else:
        pairs, source = similar_by_root(incidents, n), "db"
    items = incidents.select(
        F.col("incident_id").alias("similar_id"),
        "root_cause_node",
        "created_at",
        "primary_event",
        "status",
    )
    return pairs.join(items, "similar_id").withColumn("source", F.lit(source))
