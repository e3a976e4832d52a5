"""Incident numbering, recurrence, recovery and table upkeep, each over whole tables."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from alarmlens.operators.ranking import first_per_group, global_row_number
from alarmlens.runtime import is_empty, materialize

# Limits of the incident table.
STORED_LOGS = 200
RETENTION_DAYS = 90
SIMILAR_ROWS = 5
ID_PATTERN = r"^INC-(\d{8})-(\d+)$"

NATURAL_KEY = ["domain", "window_start", "emit_rank"]


# --- numbering and recurrence -----------------------------------------------------------


def number_incidents(
    incidents: DataFrame,
    stored: DataFrame | None = None,
    *,
    created_at: Column | None = None,
    root_counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``created_at``, ``incident_id`` (``INC-YYYYMMDD-NNN``) and ``recurrence_count``.

    The counter runs per day in (window, domain, emission) order and goes on from the
    stored maximum. Recurrence counts the earlier incidents of the same root, stored ones
    and those of this run. An incident that is already stored keeps its identifier, so a
    replayed run writes the same rows. ``root_counts`` (root_cause_node, incidents) holds the counts of the whole
    table; ``stored`` then needs only the rows of this run's days.
    """
    when = F.col("window_end") if created_at is None else created_at
    dated = incidents.withColumn("created_at", when)
    slim = dated.select(
        *NATURAL_KEY, "root_cause_node", F.date_format("created_at", "yyyyMMdd").alias("day")
    )
    if stored is not None:
        # Only stored rows of this run's roots matter; the roots are few against the table.
        related = stored.select(*NATURAL_KEY, "incident_id", "root_cause_node").join(
            slim.select("root_cause_node").distinct(), "root_cause_node", "left_semi"
        )
        known = related.select(*NATURAL_KEY, F.col("incident_id").alias("known_id"))
        slim = slim.join(known, NATURAL_KEY, "left")
    else:
        slim = slim.withColumn("known_id", F.lit(None).cast("string"))
    order = ["window_start", "domain", "emit_rank"]
    is_known = F.col("known_id").isNotNull().alias("is_known")
    ranked = global_row_number(slim.withColumn("is_known", is_known), ["day", "is_known"], order, "n")
    ranked = global_row_number(ranked, ["root_cause_node"], order, "nth")
    if stored is not None:
        taken = (
            stored.select(
                F.regexp_extract("incident_id", ID_PATTERN, 1).alias("day"),
                F.regexp_extract("incident_id", ID_PATTERN, 2).try_cast("bigint").alias("number"),
            )
            .groupBy("day")
            .agg(F.max("number").alias("taken"))
        )
        # Rows of this run that are stored already count once, through their rank.
        if root_counts is None:
            earlier = count_by_root(related.join(slim.select(*NATURAL_KEY), NATURAL_KEY, "left_anti"))
        else:
            again = count_by_root(related.join(slim.select(*NATURAL_KEY), NATURAL_KEY, "left_semi"))
            earlier = root_counts.join(again.withColumnRenamed("incidents", "again"), "root_cause_node", "left").select(
                "root_cause_node", (F.col("incidents") - F.coalesce("again", F.lit(0))).alias("incidents")
            )
        ranked = ranked.join(taken, "day", "left").join(earlier, "root_cause_node", "left")
    else:
        ranked = ranked.withColumn("taken", F.lit(0)).withColumn("incidents", F.lit(0))
    number = F.col("n") + F.coalesce("taken", F.lit(0))
    numbered = ranked.select(
        *NATURAL_KEY,
        F.coalesce("known_id", F.format_string("INC-%s-%03d", "day", number)).alias("incident_id"),
        (F.col("nth") - 1 + F.coalesce("incidents", F.lit(0))).alias("recurrence_count"),
    )
    return dated.join(numbered, NATURAL_KEY)


def count_by_root(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("root_cause_node").agg(F.count("*").alias("incidents"))


# --- recovery ------------------------------------------------------------------------------


def _is_recoverable() -> Column:
    return (F.col("status") == "OPEN") & F.col("condition").isin("ACTIVE", "FLAPPING")


def next_recovery(incidents: DataFrame, recoveries: DataFrame) -> DataFrame:
    """First recovery window of an incident's root at or after the incident's window.

    An as-of lookup: each (domain, root, day) is ordered on its own, and what a day
    cannot answer is taken from the first recovery of a later day.
    """
    keys = ["domain", "root_cause_node", "day"]
    day = F.to_date("window_start").alias("day")
    wanted = incidents.select(
        "domain", "root_cause_node", day, "window_start", F.lit(None).cast("timestamp").alias("recovery")
    ).distinct()
    offered = recoveries.select(
        "domain",
        F.col("hostname").alias("root_cause_node"),
        day,
        "window_start",
        F.col("window_start").alias("recovery"),
    ).distinct()
    events = wanted.unionByName(offered)
    onward = W.partitionBy(*keys).orderBy("window_start").rangeBetween(
        W.currentRow, W.unboundedFollowing
    )
    days = events.groupBy(*keys).agg(F.min("recovery").alias("first_recovery"))
    later = W.partitionBy("domain", "root_cause_node").orderBy("day").rowsBetween(
        1, W.unboundedFollowing
    )
    days = days.withColumn("later_recovery", F.min("first_recovery").over(later))
    answered = events.withColumn("same_day", F.min("recovery").over(onward)).filter("recovery is null")
    return answered.join(days, keys).select(
        "domain",
        "root_cause_node",
        "window_start",
        F.coalesce("same_day", "later_recovery").alias("recovered_window"),
    )


def recover(incidents: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Set condition RECOVERED on open incidents whose root recovered; status stays OPEN.

    ``recoveries`` has ``domain``, ``hostname`` and ``window_start``. The column
    ``recovered_window`` tells which rows changed.
    """
    found = next_recovery(incidents.filter(_is_recoverable()), recoveries).filter(
        "recovered_window is not null"
    )
    joined = incidents.join(found, ["domain", "root_cause_node", "window_start"], "left")
    changed = _is_recoverable() & F.col("recovered_window").isNotNull()
    return joined.withColumn(
        "recovered_window", F.when(changed, F.col("recovered_window"))
    ).withColumn(
        "condition",
        F.when(F.col("recovered_window").isNotNull(), "RECOVERED").otherwise(F.col("condition")),
    )


# --- table operations ----------------------------------------------------------------------


def upsert(existing: DataFrame, updates: DataFrame, key: str = "incident_id", *, stored_logs: int | None = STORED_LOGS) -> DataFrame:
    """Rows of ``updates`` replace rows with the same key; the rest stays. ``stored_logs``: logs kept per row, None for all."""
    if stored_logs is not None and "raw_logs" in updates.columns:
        updates = updates.withColumn("raw_logs", F.slice("raw_logs", 1, stored_logs))
    kept = existing.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates.select(*existing.columns))


def get_by_id(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.filter(F.col("incident_id") == incident_id)


def list_incidents(
    incidents: DataFrame,
    status: str | None = None,
    condition: str | None = None,
    from_dt=None,
    to_dt=None,
) -> DataFrame:
    """Filtered list, newest first; both time bounds are inclusive."""
    out = incidents
    if status:
        out = out.filter(F.col("status") == status)
    if condition:
        out = out.filter(F.col("condition") == condition)
    if from_dt is not None:
        out = out.filter(F.col("created_at") >= F.lit(from_dt).cast("timestamp"))
        if "created_date" in out.columns:
            out = out.filter(F.col("created_date") >= F.to_date(F.lit(from_dt).cast("timestamp")))
    if to_dt is not None:
        out = out.filter(F.col("created_at") <= F.lit(to_dt).cast("timestamp"))
        if "created_date" in out.columns:
            out = out.filter(F.col("created_date") <= F.to_date(F.lit(to_dt).cast("timestamp")))
    return out.orderBy(F.desc("created_at"), "incident_id")


def close(incidents: DataFrame, closures: DataFrame) -> DataFrame:
    """Operator close: status CLOSED for every listed ``incident_id``."""
    marks = closures.select("incident_id").distinct().withColumn("_close", F.lit(True))
    return (
        incidents.join(marks, "incident_id", "left")
        .withColumn("status", F.when(F.col("_close"), "CLOSED").otherwise(F.col("status")))
        .drop("_close")
    )


def unmatched_closures(incidents: DataFrame, closures: DataFrame) -> DataFrame:
    return closures.select("incident_id").distinct().join(incidents, "incident_id", "left_anti")


def is_purgeable(as_of: Column, days: int = RETENTION_DAYS) -> Column:
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    return (F.col("status") == "CLOSED") & (F.col("created_at") < cutoff)


def purge_closed(incidents: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop closed incidents older than the retention; open ones stay whatever their age."""
    return incidents.filter(~is_purgeable(as_of, days))


def similar_by_root(incidents: DataFrame, n: int = SIMILAR_ROWS) -> DataFrame:
    """Newest ``n`` other incidents of the same root, for every incident.

    Only the newest ``n + 1`` per root can appear, so each incident meets at most that
    many rows instead of its whole group.
    """
    newest = first_per_group(
        incidents.select("root_cause_node", F.col("incident_id").alias("similar_id"), "created_at"),
        ["root_cause_node"],
        [F.desc("created_at"), F.col("similar_id")],
        n + 1,
        "place",
    ).drop("created_at")
    pairs = incidents.select("incident_id", "root_cause_node").join(newest, "root_cause_node")
    others = pairs.filter(F.col("incident_id") != F.col("similar_id"))
    return first_per_group(others, ["incident_id"], ["place"], n).select(
        "incident_id", "rank", "similar_id"
    )


def by_ids(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """Incidents of each request's ``ids`` in the requested order; missing ones are skipped."""
    wanted = requests.select("request_id", F.posexplode("ids").alias("position", "incident_id"))
    return wanted.join(incidents, "incident_id").orderBy("request_id", "position")


def with_added_columns(incidents: DataFrame) -> DataFrame:
    """Read rows written before columns were added: supply the missing ones with defaults."""
    defaults = {
        "raw_logs": F.array().cast("array<string>"),
        "recurrence_count": F.lit(0).cast("bigint"),
        "condition": F.lit("ACTIVE"),
    }
    out = incidents
    for name, default in defaults.items():
        value = F.coalesce(F.col(name), default) if name in incidents.columns else default
        out = out.withColumn(name, value)
    return out


# --- stored table --------------------------------------------------------------------------
#
# A table is a folder of numbered version files and of data folders. A version names, for each day, the folder that holds the
# day's rows and their counts per root. A commit writes new folders first and then creates the next version file, which
# only one writer can; readers follow the newest version, so a half-written commit is never read.


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A plain folder of rows, or None while it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest version; content: schema (DDL) and days (day to data folder)."""
    folder, files = _files(spark, f"{path}/versions")
    if not files.exists(folder):
        return 0, {"schema": None, "days": {}}
    numbers = [int(n) for f in files.listStatus(folder) if (n := f.getPath().getName()).isdigit()]
    if not numbers:
        return 0, {"schema": None, "days": {}}
    newest = max(numbers)
    text = spark.read.text(f"{path}/versions/{newest:012d}", wholetext=True).first()["value"]
    return newest, json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, schema: str, days: dict[str, str]) -> None:
    """Create version ``number``. The file appears whole under its name or not at all, and never replaces another."""
    draft, files = _files(spark, f"{path}/versions/draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps({"schema": schema, "days": days}).encode()))
    stream.close()
    target, _ = _files(spark, f"{path}/versions/{number:012d}")
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise CommitConflict(f"version {number} of {path} exists")


def _read_days(spark: SparkSession, path: str, version: dict, days=None, part: str = "rows") -> DataFrame | None:
    folders = [f"{path}/data/{f}/{part}/created_date={day}" for day, f in sorted(version["days"].items()) if days is None or day in days]
    schema = version["schema"] if part == "rows" else "root_cause_node string, incidents bigint"
    if version["schema"] is None:
        return None
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_incidents(spark: SparkSession, path: str, days=None) -> DataFrame | None:
    """The stored table in its newest version, or None while there is none; ``days`` (ISO dates) reads these alone."""
    return _read_days(spark, path, _version(spark, path)[1], days)


def _days(*frames: DataFrame) -> set[str]:
    """Distinct days of the frames; their number is bounded by the retention."""
    out = set()
    for frame in frames:
        out |= {str(r["day"]) for r in frame.select(F.to_date("created_at").alias("day")).distinct().collect()}
    return out


def _write_days(spark: SparkSession, path: str, rows: DataFrame) -> dict[str, str]:
    """Write rows and counts per root by day into a new folder; day to folder."""
    if is_empty(rows):
        return {}
    name = uuid.uuid4().hex[:12]
    dated = rows.withColumn("created_date", F.to_date("created_at"))
    dated.write.partitionBy("created_date").parquet(f"{path}/data/{name}/rows")
    stored = spark.read.schema(dated.schema).parquet(f"{path}/data/{name}/rows")
    counts = stored.groupBy("created_date", "root_cause_node").agg(F.count("*").alias("incidents"))
    counts.write.partitionBy("created_date").parquet(f"{path}/data/{name}/roots")
    return {day: name for day in _days(stored)}


def save(
    spark: SparkSession, path: str, updates: DataFrame, *, stored_logs: int | None = STORED_LOGS, removed: DataFrame | None = None
) -> None:
    """Upsert into the stored table; only the days concerned are written anew.

    ``stored_logs``: logs kept in an incident's row, None for all. ``removed`` (incident_id): rows that leave the table in the
    same commit. Two writers that commit at once: the second one gets ``CommitConflict`` and has changed nothing.
    """
    updates = updates.drop("created_date")
    if stored_logs is not None and "raw_logs" in updates.columns:
        updates = updates.withColumn("raw_logs", F.slice("raw_logs", 1, stored_logs))
    updates = materialize(updates, "updates")
    number, version = _version(spark, path)
    days = _days(updates)
    existing = _read_days(spark, path, version)
    rows, schema = updates, version["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema)
    if existing is not None:
        touched = updates.select("incident_id")
        if removed is not None:
            touched = touched.unionByName(removed.select("incident_id"))
        moved = existing.select("incident_id", "created_at").join(touched, "incident_id", "left_semi")
        days |= _days(moved)
        rows = upsert(_read_days(spark, path, version, days), updates, stored_logs=None)
        if removed is not None:
            rows = rows.join(removed.select("incident_id"), "incident_id", "left_anti")
    written = _write_days(spark, path, rows)
    kept = {day: folder for day, folder in version["days"].items() if day not in days}
    _commit(spark, path, number + 1, schema, kept | written)


def purge(spark: SparkSession, path: str, as_of: Column, days: int = RETENTION_DAYS) -> int:
    """Apply the retention to the stored table and return the number of removed rows."""
    number, version = _version(spark, path)
    existing = _read_days(spark, path, version)
    if existing is None:
        return 0
    old = existing.filter(is_purgeable(as_of, days))
    touched = _days(old)
    if not touched:
        return 0
    removed = old.count()
    rows = purge_closed(_read_days(spark, path, version, touched), as_of, days)
    written = _write_days(spark, path, rows)
    kept = {day: folder for day, folder in version["days"].items() if day not in touched}
    _commit(spark, path, number + 1, version["schema"], kept | written)
    return removed


def number_against_table(spark: SparkSession, path: str, incidents: DataFrame, *, known: bool = True) -> DataFrame:
    """``number_incidents`` against the stored table without reading all of it: identifiers come from the days of this run, and
    recurrence from the counts per root that each commit keeps. ``known=False``: none of the incidents is stored, so a stored
    one at the same place of its window gives no identifier."""
    _, version = _version(spark, path)
    if version["schema"] is None:
        return number_incidents(incidents)
    days = {str(r["day"]) for r in incidents.select(F.to_date("window_end").alias("day")).distinct().collect()}
    same_days = _read_days(spark, path, version, days)
    if not known:
        same_days = same_days.withColumn("emit_rank", F.lit(None).cast("int"))
    roots = _read_days(spark, path, version, part="roots").groupBy("root_cause_node").agg(F.sum("incidents").alias("incidents"))
    return number_incidents(incidents, same_days, root_counts=roots)
