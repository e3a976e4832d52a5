"""Queries over files, streams and stored tables that are first written from the shared tables."""
from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.functions import parse as P
from alarmlens.operators import filters as FL
from alarmlens.operators import incidents as I
from alarmlens.operators import topology as T
from alarmlens.operators.windows import newest_per_window
from alarmlens.plans import payloads as PL
from alarmlens.plans import reports as R
from alarmlens.runtime import materialize, run_dir
from alarmlens.sources.lines import read_lines, stream_datagrams, stream_lines
from alarmlens.sources.patterns import effective_patterns, read_patterns
from alarmlens.sources.topology_docs import read_json, read_yaml, supporting_edges
from alarmlens.streaming import live
from workload import inputs
from workload import oracle_parts as O
from workload.registry import (
    AS_OF, CACHE_SQL, CACHE_TIME, FULL, IGNORED, INPUT, PROMPT_SQL, RULES, TABLE, TOPO, W_SEC, W_US, WINDOWED, _cache, evidence, incidents, messages,
    register, topology, us, windowed,
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _as_text(lines: DataFrame, name: str, **options) -> str:
    path = _folder(lines.sparkSession, name)
    lines.write.options(**options).text(path)
    return path


# --- files ---------------------------------------------------------------------------------

RAW = (O.BASE, O.LINES)


@register("file_lines", O.query("SELECT raw, 'file' AS source_ip FROM lines", *RAW))
def file_lines(spark, d):
    """Lines written as text with blank lines between them, read back."""
    raw = inputs.raw_lines(spark, d).select(F.explode(F.array("raw", F.lit("  "))).alias("value"))
    return read_lines(spark, _as_text(raw, "lines"), received_at="2024-01-01 00:00:00").select("raw", "source_ip")


@register("streamed_lines", O.query("SELECT raw, 'file' AS source_ip FROM lines", *RAW))
def streamed_lines(spark, d):
    """The same text as a stream, one file at a time."""
    raw = inputs.raw_lines(spark, d).select(F.col("raw").alias("value")).repartition(3)
    lines = stream_lines(spark, _as_text(raw, "lines"), max_files_per_trigger=1)
    return _drained(lines.select("raw", "source_ip"), "append")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything a stream gives until its input ends, as a table."""
    spark = stream.sparkSession
    path, checkpoint = _folder(spark, "stream"), _folder(spark, "stream_state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _site_files(spark, d, suffix: str) -> str:
    docs = inputs.topology_documents(spark, d).select(F.col("doc").alias("value"))
    return _as_text(docs, f"sites_{suffix}", maxRecordsPerFile=1)


NODES_SQL = O.query("SELECT id, role, CAST(role_priority AS INTEGER) AS role_priority FROM nodes", TOPO)


@register("json_topology", NODES_SQL)
def json_topology(spark, d):
    """One JSON file per site."""
    return T.load_nodes(read_json(spark, _site_files(spark, d, "json")))


@register("yaml_topology", NODES_SQL)
def yaml_topology(spark, d):
    """The same files read as YAML, of which JSON is a part."""
    return T.load_nodes(read_yaml(spark, _site_files(spark, d, "yaml")))


def _pattern_file(spark, d) -> str:
    found = messages(spark, d).filter("severity = 3 and length(message) >= 9").select(F.expr("right(message, 9)").alias("value")).distinct()
    noise = spark.createDataFrame([("# comment",), ("",), ("   ",)], "value string")
    return _as_text(found.unionByName(noise), "patterns")


PATTERNS_SQL = """pats AS (SELECT DISTINCT trim(right(message, 9)) AS pattern FROM msgs WHERE severity = 3 AND length(message) >= 9)"""


@register("pattern_file", O.query("SELECT pattern FROM pats", *INPUT, PATTERNS_SQL))
def pattern_file(spark, d):
    """Comments and blank lines are skipped."""
    return read_patterns(spark, _pattern_file(spark, d)).distinct()


@register(
    "effective_patterns",
    O.query(
        f"""SELECT pattern, count(*) AS n FROM (SELECT pattern FROM pats UNION ALL SELECT '%LINK-2-INTVULN'
        UNION ALL SELECT unnest([{", ".join("'" + p + "'" for p in IGNORED)}])) GROUP BY pattern""",
        *INPUT, PATTERNS_SQL,
    ),
)
def effective_patterns_query(spark, d):
    """File, defaults and extra literals together, duplicates kept, with their counts."""
    every = effective_patterns(spark, _pattern_file(spark, d), IGNORED)
    return every.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@register(
    "supporting_edges",
    "SELECT DISTINCT 'N' || (user_id // 4) AS src, 'N' || user_id AS dst FROM events WHERE user_id > 0",
)
def supporting_edges_query(spark, d):
    """Network documents that list supporting nodes."""
    users = inputs.events(spark, d).filter("user_id > 0").select("user_id").distinct()
    name = lambda n: F.concat(F.lit("N"), n.cast("string"))
    support = F.array(F.struct(name(F.floor(F.col("user_id") / 4)).alias("node-ref")))
    node = F.struct(name(F.col("user_id")).alias("node-id"), support.alias("ietf-network-topology:supporting-node"))
    nets = users.groupBy((F.col("user_id") % 7).alias("k")).agg(F.collect_list(node).alias("node"))
    networks = F.struct(F.array(F.struct("node")).alias("network"))
    return supporting_edges(nets.select(networks.alias("ietf-network:networks")))


@register(
    "latest_topology",
    O.query("SELECT src, dst, edge_type FROM edges_b", O.topology(changed=True, suffix="_b")),
)
def latest_topology(spark, d):
    """Two stored versions; readers see the newest."""
    path = _folder(spark, "versions")
    T.save_version(topology(spark, d), path, 1)
    T.save_version(inputs.topology(spark, d, changed=True), path, 2)
    return T.load_latest(spark, path).edges.select("src", "dst", "edge_type")


@register(
    "topology_changed",
    O.query(
        """SELECT 'same' AS compared, false AS changed UNION ALL SELECT 'other', count(*) > 0 FROM (
        (SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM edges_b) UNION ALL
        (SELECT src, dst FROM edges_b EXCEPT SELECT src, dst FROM edges))""",
        TOPO, O.topology(changed=True, suffix="_b"),
    ),
)
def topology_changed(spark, d):
    """the test that lets a reload be skipped."""
    edges = topology(spark, d).edges
    other = inputs.topology(spark, d, changed=True).edges
    rows = [("same", T.topology_changed(edges, edges)), ("other", T.topology_changed(edges, other))]
    return spark.createDataFrame(rows, "compared string, changed boolean")


# --- incident table ------------------------------------------------------------------------


@register(
    "public_incidents",
    O.query(
        """SELECT incident_id, epoch_us(created_at) AS created_us, root AS root_cause_node, primary_event,
        array_to_string(secondary, ',') AS secondary, raw_log_count, array_to_string(raw_logs, chr(10)) AS logs, status,
        condition, recurrence_count FROM tab""",
        *TABLE,
    ),
)
def public_incidents(spark, d):
    """The ten public columns."""
    out = PL.public_incidents(incidents(spark, d))
    return out.withColumns(
        {"created_us": us("created_at"), "secondary": F.array_join("secondary_nodes", ","), "logs": F.array_join("raw_logs", "\n")}
    ).drop("created_at", "secondary_nodes", "raw_logs")


@register("get_incident", O.query("SELECT incident_id, root AS root_cause_node, status FROM tab WHERE incident_id = (SELECT max(incident_id) FROM tab)", *TABLE))
def get_incident(spark, d):
    """K2."""
    newest = incidents(spark, d).agg(F.max("incident_id").alias("i")).first()["i"]
    return I.get_by_id(incidents(spark, d), newest).select("incident_id", "root_cause_node", "status")


@register(
    "added_columns",
    O.query("SELECT incident_id, root AS root_cause_node, 'ACTIVE' AS condition, 0 AS logs, CAST(0 AS BIGINT) AS recurrence_count FROM tab", *TABLE),
)
def added_columns(spark, d):
    """K9: rows written before the columns existed."""
    old = incidents(spark, d).drop("raw_logs", "recurrence_count", "condition")
    return I.with_added_columns(old).select("incident_id", "root_cause_node", "condition", F.size("raw_logs").alias("logs"), "recurrence_count")


@register(
    "unmatched_closures",
    O.query("SELECT 'X' || incident_id AS incident_id FROM tab WHERE kind = 'silent'", *TABLE),
)
def unmatched_closures(spark, d):
    """K4: closures that name no incident."""
    silent = incidents(spark, d).filter("kind = 'silent'").select("incident_id")
    wrong = silent.select(F.concat(F.lit("X"), "incident_id").alias("incident_id"))
    return I.unmatched_closures(incidents(spark, d), silent.unionByName(wrong))


@register(
    "incident_map",
    O.query(
        """SELECT n.id, CASE WHEN n.id = t.root THEN 'root' WHEN list_contains(t.secondary, n.id) THEN 'secondary' ELSE 'normal' END
        AS node_type FROM nodes n, (SELECT * FROM tab WHERE incident_id = (SELECT min(incident_id) FROM tab)) t""",
        *TABLE,
    ),
)
def incident_map(spark, d):
    """Every node of the map, the normal ones included."""
    oldest = incidents(spark, d).agg(F.min("incident_id").alias("i")).first()["i"]
    return T.map_for_incident(topology(spark, d).nodes, I.get_by_id(incidents(spark, d), oldest))


UPSERTED = O.query(
    """SELECT incident_id, CASE WHEN kind = 'regular' THEN 'CLOSED' ELSE status END AS status, len(raw_logs) AS logs FROM tab""",
    *TABLE,
)


def _stored(spark, d) -> str:
    """A stored table in three commits: all but independent incidents, the independent ones, regular ones closed."""
    path = _folder(spark, "table")
    table = incidents(spark, d)
    I.save(spark, path, table.filter("kind <> 'independent'"))
    I.save(spark, path, table.filter("kind = 'independent'"))
    I.save(spark, path, table.filter("kind = 'regular'").withColumn("status", F.lit("CLOSED")))
    return path


@register("stored_upsert", UPSERTED)
def stored_upsert(spark, d):
    """S12, K1 on the stored table."""
    return I.read_incidents(spark, _stored(spark, d)).select("incident_id", "status", F.size("raw_logs").cast("bigint").alias("logs"))


@register(
    "stored_purge",
    O.query(
        f"""SELECT incident_id FROM tab WHERE NOT ((status = 'CLOSED' OR kind = 'regular')
        AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)""",
        *TABLE,
    ),
)
def stored_purge(spark, d):
    """Nightly upkeep of the stored table."""
    path = _stored(spark, d)
    live.nightly_upkeep(spark, path, F.lit(AS_OF).cast("timestamp"), days=30)
    return I.read_incidents(spark, path).select("incident_id")


@register("stored_numbering", O.query("SELECT incident_id, w AS window_us, root AS root_cause_node, recurrence_count FROM num", *FULL, O.NUMBERED))
def stored_numbering(spark, d):
    """The log in two halves, the second numbered against the stored first."""
    path = _folder(spark, "table")
    every = incidents(spark, d).drop("incident_id", "recurrence_count", "created_at")
    half = every.agg(F.expr("percentile_approx(unix_micros(window_start), 0.5)").alias("h")).first()["h"]
    early = us("window_start") <= half
    for part in (every.filter(early), every.filter(~early)):
        I.save(spark, path, materialize(I.number_against_table(spark, path, part), "numbered"))
    return I.read_incidents(spark, path).select("incident_id", us("window_start").alias("window_us"), "root_cause_node", "recurrence_count")


# --- reports -------------------------------------------------------------------------------

VECTOR = "[CAST(length(root) AS DOUBLE), len(secondary), raw_log_count % 97, epoch_us(created_at) // 60000000 % 101]"
VECTORS_SQL = f"vec AS (SELECT incident_id, CAST({VECTOR} AS DOUBLE[]) AS v FROM tab)"
NEAR_SQL = """near AS (
  SELECT a.incident_id, b.incident_id AS similar_id,
         CAST(row_number() OVER (PARTITION BY a.incident_id ORDER BY list_distance(a.v, b.v), b.incident_id) AS INTEGER) AS rank
  FROM vec a JOIN vec b ON a.incident_id <> b.incident_id QUALIFY rank <= 5)"""


def _vectors(spark, d) -> DataFrame:
    minute = F.floor(F.unix_micros("created_at") / 60_000_000) % 101
    parts = [F.length("root_cause_node"), F.size("secondary_nodes"), F.col("raw_log_count") % 97, minute]
    return incidents(spark, d).select("incident_id", F.array(*[p.cast("double") for p in parts]).alias("embedding"))


@register(
    "similar_by_vector",
    O.query(
        """SELECT n.incident_id, n.rank, n.similar_id, t.root AS root_cause_node, 'rag' AS source
        FROM near n JOIN tab t ON t.incident_id = n.similar_id""",
        *TABLE, VECTORS_SQL, NEAR_SQL,
    ),
)
def similar_by_vector(spark, d):
    """The branch with vectors."""
    found = R.similar_incidents(incidents(spark, d), materialize(_vectors(spark, d), "vectors"))
    return found.select("incident_id", "rank", "similar_id", "root_cause_node", "source")


DOC_SQL = """docs AS (SELECT incident_id, 'RootCause: ' || root || chr(10) || 'PrimaryEvent: ' || primary_event
  || CASE WHEN len(secondary) > 0 THEN chr(10) || 'SecondaryNodes: ' || array_to_string(secondary, ', ') ELSE '' END
  || CASE WHEN len(raw_logs) > 0 THEN chr(10) || 'Log: ' || array_to_string(raw_logs[1:8], chr(10) || 'Log: ') ELSE '' END
  AS document FROM tab)"""


@register(
    "similar_documents",
    O.query(
        """SELECT n.incident_id, string_agg(document, chr(10) || '---' || chr(10) ORDER BY rank) AS cases
        FROM near n JOIN docs d ON d.incident_id = n.similar_id WHERE rank <= 3 GROUP BY n.incident_id""",
        *TABLE, VECTORS_SQL, NEAR_SQL, DOC_SQL,
    ),
)
def similar_documents(spark, d):
    """A corpus put in two steps, and the cases that a prompt would show."""
    vectors = materialize(_vectors(spark, d), "vectors")
    rows = R.incident_documents(incidents(spark, d)).withColumnRenamed("root_cause_node", "root_cause").join(vectors, "incident_id")
    old = materialize(rows.filter("root_cause < 'N5'").withColumn("document", F.lit("outdated")), "corpus")
    corpus = materialize(R.corpus_put(old, incidents(spark, d), vectors), "corpus")
    found = R.similar_documents(vectors, corpus)
    return found.select("incident_id", F.array_join("similar_docs", "\n---\n").alias("cases"))


@register(
    "cache_put",
    O.query(
        """SELECT fingerprint, arg_max(incident_id, created_at || incident_id) AS report FROM fp GROUP BY fingerprint""",
        *TABLE, CACHE_SQL,
    ),
)
def cache_put(spark, d):
    """Newer reports of the same incidents replace the cached ones."""
    fresh = R.with_fingerprint(incidents(spark, d)).select("fingerprint", F.col("incident_id").alias("report"), "created_at")
    return R.cache_put(_cache(spark, d).select("fingerprint", "report", "created_at"), fresh).select("fingerprint", "report")


@register(
    "answered_prompts",
    O.query(
        f"""SELECT fingerprint, 'answer of ' || length(arg_min({PROMPT_SQL}, incident_id)) AS report
        FROM fp LEFT JOIN live USING (fingerprint) WHERE report IS NULL GROUP BY fingerprint""",
        *TABLE, CACHE_SQL,
    ),
)
def answered_prompts(spark, d):
    """U4: the caller's function gets one open prompt per fingerprint."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return "answer of " + prompts.str.len().astype(str)

    work = R.report_worklist(incidents(spark, d), _cache(spark, d), F.lit(CACHE_TIME).cast("timestamp"))
    return R.answer_prompts(work, ask)


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


# --- streams -------------------------------------------------------------------------------


def _datagrams(spark, d, parts: int, late: int = 0) -> tuple[str, int]:
    """Raw lines as JSON files in time order, as a collector leaves them, and the number of files that a part has; with ``late`` each line whose number is divisible by it
    comes one file later, with the lines after it."""
    path = _folder(spark, "datagrams")
    lines = materialize(inputs.raw_lines(spark, d).select("raw", "source_ip", "received_at", "seq"), "lines")
    first, last = lines.agg(F.min(us("received_at")), F.max(us("received_at"))).first()
    place = F.floor((us("received_at") - first) * parts / (last - first + 1))
    if late:
        place = F.least(F.lit(parts - 1), place + (F.col("seq") % late == 0).cast("int"))
    files = _file_count(lines.groupBy(place.alias("k")).count())
    for k in range(parts):  # one after another, as the stream takes files by their age
        part = lines.filter(place == k)
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").option("timestampFormat", STAMP).json(path)
    return path, files


FILE_ROWS = 500_000


def _file_count(counts: DataFrame) -> int:
    """Files of one part of a stream, so that none has many more than ``FILE_ROWS`` rows."""
    return max(1, -(-(counts.agg(F.max("count")).first()[0] or 0) // FILE_ROWS))


LIVE_SQL = """SELECT t.incident_id, t.root AS root_cause_node, t.kind, t.raw_log_count, t.recurrence_count, len(t.raw_logs) AS logs,
  CASE WHEN EXISTS (SELECT 1 FROM wm m WHERE m.domain = t.domain AND m.hostname = t.root AND m.is_recovery AND m.w >= t.w)
       THEN 'RECOVERED' ELSE t.condition END AS condition FROM full_inc t"""


def _live(spark, d, parts: int, late: int = 0, **rules) -> live.LiveJob:
    """The live job over the whole log, file by file, with a drain at the end."""
    base = _folder(spark, "live")
    T.save_version(topology(spark, d), f"{base}/topology", 1)
    job = live.LiveJob(spark, f"{base}/state", f"{base}/table", f"{base}/topology", window_sec=W_SEC, rules=RULES, **rules)
    path, files = _datagrams(spark, d, parts, late)
    lines = stream_datagrams(spark, path, maxFilesPerTrigger=str(files), timestampFormat=STAMP)
    query = job.start(lines, f"{base}/checkpoint", availableNow=True)
    query.awaitTermination()
    job.drain(query.lastProgress["batchId"])
    return job


@register("live_incidents", O.query(LIVE_SQL, *FULL, O.NUMBERED, O.LOGS))
def live_incidents(spark, d):
    """The stored table after a stream equals that of the batch."""
    job = _live(spark, d, 2)
    table = I.read_incidents(spark, job.table_path)
    return table.select("incident_id", "root_cause_node", "kind", "raw_log_count", "recurrence_count", F.size("raw_logs").cast("bigint").alias("logs"), "condition")


@register("live_late", O.query(LIVE_SQL.replace("SELECT t.incident_id,", "SELECT t.domain, t.w AS window_us,").replace("t.recurrence_count, ", ""), *FULL, O.NUMBERED, O.LOGS))
def live_late(spark, d):
    """A fifth of the lines comes a file late and reopens settled windows; all but numbers and recurrence, which depend on the
    order of arrival, equals the batch."""
    job = _live(spark, d, 2, late=5, reopen_sec=10 * 365 * 86400)
    table = I.read_incidents(spark, job.table_path)
    return table.select(
        "domain", us("window_start").alias("window_us"), "root_cause_node", "kind", "raw_log_count",
        F.size("raw_logs").cast("bigint").alias("logs"), "condition",
    )


def _site_stream(spark, d) -> DataFrame:
    """Parsed messages as a stream of files of bounded size, followed by two rows far in the future that close every window."""
    path = _folder(spark, "messages")
    keep = ["domain", "received_at", "hostname"]
    rows = messages(spark, d).select(*keep)
    first, last, n = rows.agg(F.min(us("received_at")), F.max(us("received_at")), F.count("*")).first()
    parts = max(1, -(-n // FILE_ROWS))
    if parts > 1:  # a batch holds about FILE_ROWS rows; in time order, so that none is late whatever the span of the log
        staged = _folder(spark, "staged")
        at = F.coalesce(F.floor((us("received_at") - first) * parts / (last - first + 1)), F.lit(0)).alias("place")
        rows.select(*keep, at).repartition("place").write.partitionBy("place").parquet(staged)
        for k in range(parts):
            rows = spark.read.parquet(staged).filter(F.col("place") == k).select(*keep)
            rows.repartition(1).write.mode("append").parquet(f"{path}/part=0")
    else:
        rows.repartition(1).write.parquet(f"{path}/part=0")
    for k in (1, 2):
        late = F.lit(f"2100-01-0{k} 00:00:00").cast("timestamp")
        mark = spark.range(1).select(F.lit("closing").alias("domain"), late.alias("received_at"), F.lit("none").alias("hostname"))
        mark.write.parquet(f"{path}/part={k}")
    return spark.readStream.schema("domain string, received_at timestamp, hostname string").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


STREAM_GAPS = f"""
gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY domain ORDER BY us, seq) < {W_US} THEN 0 ELSE 1 END AS opens FROM msgs),
sess AS (SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY us, seq) AS s FROM gaps)"""


@register(
    "session_stream",
    O.query(f"SELECT domain, min(us) AS window_us, max(us) + {W_US} AS until_us, count(*) AS n FROM sess GROUP BY domain, s", *INPUT, STREAM_GAPS),
)
def session_stream(spark, d):
    """Idle-gap sessions of a stream; a watermark of 40 days, as the file is not in time order."""
    found = _drained(live.session_counts(_site_stream(spark, d), W_SEC, "40 days"), "append").filter("domain <> 'closing'")
    return found.select("domain", us("window_start").alias("window_us"), us("window_end").alias("until_us"), "n")


@register(
    "tumbling_stream",
    O.query("SELECT (us // 10000000) * 10000000 AS window_us, hostname, count(*) AS n FROM msgs GROUP BY ALL", *INPUT),
)
def tumbling_stream(spark, d):
    """Fixed windows of a stream."""
    found = _drained(live.tumbling_hosts(_site_stream(spark, d), 10, "40 days"), "append").filter("domain <> 'closing'")
    return found.select(us("window_start").alias("window_us"), "hostname", "n")


@register("received_count", "SELECT count(*) AS received FROM events")
def received_count(spark, d):
    """The counter in the progress of a running stream."""
    path, files = _datagrams(spark, d, 3)
    lines = live.count_received(stream_datagrams(spark, path, maxFilesPerTrigger=str(files), timestampFormat=STAMP))
    query = lines.writeStream.format("noop").option("checkpointLocation", _folder(spark, "stream_state")).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = [p["observedMetrics"]["intake"]["received"] for p in query.recentProgress if "intake" in p["observedMetrics"]]
    return spark.createDataFrame([(sum(counts),)], "received bigint")
