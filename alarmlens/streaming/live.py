"""Live incidents: Structured Streaming micro-batches over the batch operators.

Anchored windows chain: a window can only be settled once no earlier message can come.
Instead of holding the messages of a domain in the state of one task, each micro-batch
keeps the unsettled ones in a pending table in the shared folder, assigns windows with
the batch operator, and hands the settled windows to inference. A busy domain is thus
spread over the cluster like any other data, and a replayed micro-batch starts from the
pending table of the one before it.

With ``reopen_sec`` settled messages stay in an archive for that time. A message that comes after
its window was settled reopens the windows of its domain from there on: they are formed and
inferred again, and what differs from the stored incidents goes out as corrections.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alarmlens.functions.parse import parse_syslog
from alarmlens.operators import incidents as tables
from alarmlens.operators.closure import physical_closure
from alarmlens.operators.filters import drop_ignored, recovery_nodes
from alarmlens.operators.topology import Topology, load_latest
from alarmlens.operators.windows import DEFAULT_WINDOW_SEC, Burst, newest_per_window
from alarmlens.plans.infer import LOG_KEY, WINDOW, Rules, infer_parts
from alarmlens.plans.payloads import event_feed
from alarmlens.plans.pipeline import assign_windows
from alarmlens.plans.reports import CACHE_TTL_DAYS, cache_purge
from alarmlens.runtime import is_empty, materialize
from alarmlens.sources.lines import with_arrival_order
from alarmlens.sources.patterns import effective_patterns

#: What a stored incident says; if one of these differs after a late message, the incident has changed.
CONTENT = ["window_end", "emit_rank", "primary_event", "secondary_nodes", "raw_log_count", "raw_logs", "condition"]
CHANGES = ("new", "recovered", "changed", "withdrawn")


@dataclass
class LiveJob:
    """Folders and rules of one live job; all folders are on shared storage."""

    spark: SparkSession
    state_path: str
    table_path: str
    topology_path: str
    patterns_path: str | None = None
    window: str = "anchored"
    window_sec: float = DEFAULT_WINDOW_SEC
    burst: Burst | None = None
    delay_sec: float = 0.0
    max_size: int | None = None  # newest rows of a window that take part; the others go to a side table
    stored_logs: int = tables.STORED_LOGS  # logs in an incident's row
    reopen_sec: float | None = None  # how far behind the settled time of its domain a message still reopens windows
    time_col: str = "received_at"
    year: int | None = None
    tz: str = "UTC"
    rules: Rules = field(default_factory=Rules)
    _closures: dict = field(default_factory=dict, repr=False)
    _batch: int = field(default=0, repr=False)

    # --- state tables, one folder per micro-batch ---

    def _state(self, name: str, batch: int) -> str:
        return f"{self.state_path}/{name}/batch={batch}"

    def _read_state(self, name: str, batch: int) -> DataFrame | None:
        return tables.read_table(self.spark, self._state(name, batch))

    def _write_state(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._state(name, batch))

    def _forget(self, batch: int) -> None:
        self._delete(("pending", "settled", "horizon", "outcome"), batch)

    def _delete(self, names, batch: int) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._state(name, batch))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # --- settled messages that late ones may reopen ---

    def _current(self, name: str, before: int | None = None) -> DataFrame | None:
        """Rows of a per-batch table of windowed messages without those whose windows a later batch reopened."""
        rows = tables.read_table(self.spark, f"{self.state_path}/{name}")
        marks = tables.read_table(self.spark, f"{self.state_path}/reopened")
        if rows is None:
            return None
        if before is not None:  # a replayed micro-batch sees what stood before its first run
            rows = rows.filter(F.col("batch") < before)
            marks = marks if marks is None else marks.filter(F.col("batch") < before)
        if marks is None:
            return rows
        marks = marks.select("domain", "reopened_from", F.col("batch").alias("reopened_by"))
        again = (rows["domain"] == marks["domain"]) & (F.col("reopened_by") > F.col("batch")) & (F.col("window_start") >= F.col("reopened_from"))
        return rows.join(marks, again, "left_anti")

    def _reopen(self, late: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """``(domain, reopened_from)`` and the archived messages of these windows.

        Windows chain, so all from the last one that starts before the first late message are formed again; those
        before it end before that message and stay.
        """
        first = late.groupBy("domain").agg(F.min(self.time_col).alias("first_late"))
        archive = self._current("archive", batch)
        if archive is None:
            return first.withColumnRenamed("first_late", "reopened_from"), late.limit(0)
        starts = archive.select("domain", "window_start").join(first, "domain").filter("window_start <= first_late")
        starts = starts.groupBy("domain").agg(F.max("window_start").alias("start"))
        reopened = first.join(starts, "domain", "left").select("domain", F.coalesce("start", "first_late").alias("reopened_from"))
        reopened = materialize(reopened, "reopened")
        again = archive.join(reopened, "domain").filter("window_start >= reopened_from")
        return reopened, again.select(*late.columns)

    def _archive(self, done: DataFrame, reopened: DataFrame | None, batch: int) -> None:
        """Keep settled messages, note what was reopened, and drop batches that nothing can reach any more."""
        if reopened is not None:
            self._write_state(reopened, "reopened", batch)
        self._write_state(done, "archive", batch)
        self._write_state(done.groupBy("domain").agg(F.max("window_end").alias("newest")), "extent", batch)
        extents = tables.read_table(self.spark, f"{self.state_path}/extent")
        settled = self._read_state("settled", batch - 1)  # not this batch's, which may be replayed
        if settled is None:
            return
        reach = F.make_dt_interval(secs=F.lit(float(self.reopen_sec + self.window_sec)))
        alive = F.max(F.coalesce(F.col("newest") >= F.col("settled_until") - reach, F.lit(True)))
        ages = extents.join(settled, "domain", "left").groupBy("batch").agg(alive.alias("alive"))
        for row in ages.filter(~F.col("alive")).select("batch").collect():
            self._delete(("archive", "extent"), row["batch"])

    # --- reference data, reread for every micro-batch ---

    def _topology(self) -> tuple[Topology, DataFrame]:
        topology = load_latest(self.spark, self.topology_path)
        version = tuple(sorted(topology.edges.inputFiles()))
        if version not in self._closures:
            self._closures = {version: physical_closure(topology.nodes, topology.edges)}
        return topology, self._closures[version]

    # --- one micro-batch ---

    def process(self, lines: DataFrame, batch: int) -> None:
        """``foreachBatch`` body: parse, join the pending messages, settle what is complete."""
        parsed = parse_syslog(with_arrival_order(lines), year=self.year, tz=self.tz)
        if self.time_col == "event_ts":  # as in batch: lines without a header time go by arrival
            parsed = parsed.withColumn("event_ts", F.coalesce("event_ts", "received_at"))
        patterns = effective_patterns(self.spark, self.patterns_path)
        self.settle(materialize(drop_ignored(parsed, patterns), "batch"), batch)

    def settle(self, fresh: DataFrame, batch: int, *, everything: bool = False) -> None:
        """Settle all windows that end before the horizon; keep the other messages pending.

        The horizon of a domain is its newest message time so far minus ``delay_sec``; a domain that is read
        faster than another does not settle the other's windows.
        """
        pending = self._read_state("pending", batch - 1)
        settled = self._read_state("settled", batch - 1)
        horizon = self._horizon(fresh, batch, everything)
        reopened = None
        if settled is not None:
            joined = fresh.join(settled, "domain", "left")
            late = F.coalesce(F.col(self.time_col) <= F.col("settled_until"), F.lit(False))
            within = F.lit(False)
            if self.reopen_sec is not None:
                within = F.col(self.time_col) >= F.col("settled_until") - F.make_dt_interval(secs=F.lit(float(self.reopen_sec)))
            self._write_state(joined.filter(late & ~within).drop("settled_until"), "late", batch)
            back = joined.filter(late & within).select(*fresh.columns)
            fresh = joined.filter(~late).select(*fresh.columns)
            if self.reopen_sec is not None and not is_empty(back := materialize(back, "back")):
                reopened, again = self._reopen(back, batch)
                fresh = fresh.unionByName(back).unionByName(again)
        if pending is not None:
            fresh = pending.unionByName(fresh)
        windowed = materialize(
            assign_windows(
                materialize(fresh, "open"),
                self.window,
                self.window_sec,
                time_col=self.time_col,
                burst=self.burst,
            ),
            "windowed",
        )
        if horizon is None:
            complete = F.lit(True)
        else:
            windowed = windowed.join(horizon, "domain", "left")
            complete = F.coalesce(F.col("window_end") < F.col("horizon"), F.lit(False))
        self._write_state(
            windowed.filter(~complete).select(*fresh.columns), "pending", batch
        )
        done = windowed.filter(complete).drop("horizon")
        until = done.groupBy("domain").agg(F.max("window_end").alias("settled_until"))
        if reopened is not None:
            before = F.col("reopened_from") - F.expr("interval 1 microsecond")
            settled = settled.join(reopened, "domain", "left").select("domain", F.coalesce(before, "settled_until").alias("settled_until"))
        if settled is not None:
            until = settled.unionByName(until).groupBy("domain").agg(
                F.max("settled_until").alias("settled_until")
            )
        self._write_state(until, "settled", batch)
        if reopened is not None or not is_empty(done):
            self.publish(done, batch, reopened)
        if self.reopen_sec is not None:
            self._archive(done, reopened, batch)
        self._forget(batch - 2)

    def _horizon(self, fresh: DataFrame, batch: int, everything: bool) -> DataFrame | None:
        """``(domain, horizon)``, or nothing at the end of input, when every window is settled."""
        if everything:
            return None
        newest = F.max(self.time_col) - F.make_dt_interval(secs=F.lit(self.delay_sec))
        now = fresh.groupBy("domain").agg(newest.alias("horizon"))
        before = self._read_state("horizon", batch - 1)
        if before is not None:
            now = now.unionByName(before).groupBy("domain").agg(F.max("horizon").alias("horizon"))
        self._write_state(now, "horizon", batch)
        return self._read_state("horizon", batch)

    def publish(self, done: DataFrame, batch: int, reopened: DataFrame | None = None) -> None:
        """Infer and number, work out recoveries, then store the outcome and apply it.

        The outcome comes from the table as it was before the micro-batch and is stored before the table
        changes. A replayed micro-batch finds it and applies it again: the feed is the same, and incidents
        that were closed in between stay closed.
        """
        outcome = self._read_state("outcome", batch)
        if outcome is None:
            self._batch = batch
            self._write_state(self._outcome(done, reopened), "outcome", batch)
            outcome = self._read_state("outcome", batch)
        new, recovered, changed, withdrawn = (outcome.filter(F.col("change") == c).drop("change") for c in CHANGES)
        self._apply(new, recovered, changed, withdrawn)
        self._write_state(event_feed(new, recovered, changed=changed, withdrawn=withdrawn), "feed", batch)

    def _outcome(self, done: DataFrame, reopened: DataFrame | None = None) -> DataFrame:
        """Incidents as they become, with ``change``: new, recovered, and after late messages changed or withdrawn.

        An incident of a reopened window is the stored one of the same window, kind and root. It keeps its identifier, its
        recurrence count and a closed status; stored ones that are not found again are withdrawn.
        """
        if self.max_size:
            self._write_state(newest_per_window(done, self.max_size, time_col=self.time_col, overflow=True), "overflow", self._batch)
            done = newest_per_window(done, self.max_size, time_col=self.time_col)
        topology, physical = self._topology()
        stored = tables.read_incidents(self.spark, self.table_path)
        incidents, logs = infer_parts(
            done, topology, self.rules, physical=physical, time_col=self.time_col, log_rows=self.stored_logs
        )
        old = None
        if reopened is not None and stored is not None:
            old = materialize(stored.join(reopened, "domain").filter("window_start >= reopened_from").drop("reopened_from"), "reopened")
            incidents = materialize(incidents, "incidents")
            fresh = incidents.join(old.select(*LOG_KEY), LOG_KEY, "left_anti")
            numbered = tables.number_against_table(self.spark, self.table_path, fresh, known=False)
            kept = old.select(
                *LOG_KEY, "created_at", "incident_id", "recurrence_count",
                F.col("status").alias("_status"), F.when(F.col("status") == "CLOSED", F.col("condition")).alias("_condition"),
            )
            again = incidents.join(kept, LOG_KEY).withColumns({"status": F.col("_status"), "condition": F.coalesce("_condition", "condition")})
            numbered = numbered.unionByName(again.select(*numbered.columns))
        else:
            numbered = tables.number_against_table(self.spark, self.table_path, incidents)
        every = materialize(numbered.join(logs, LOG_KEY), "new")
        recoveries = materialize(recovery_nodes(done, topology.nodes, WINDOW), "recoveries")
        table = every
        if stored is not None:
            concerned = stored.join(
                recoveries.select("domain", F.col("hostname").alias("root_cause_node")).distinct(),
                ["domain", "root_cause_node"],
                "left_semi",
            )
            replaced = every.select("incident_id")
            if old is not None:
                replaced = replaced.unionByName(old.select("incident_id")).distinct()
            table = concerned.join(replaced, "incident_id", "left_anti").unionByName(every, allowMissingColumns=True)
        recovered = tables.recover(table, recoveries).filter("recovered_window is not null").select(*every.columns)
        if old is None:
            return every.withColumn("change", F.lit("new")).unionByName(recovered.withColumn("change", F.lit("recovered")))
        recovered = materialize(recovered, "recovered")
        before = old.select("incident_id", F.struct(*CONTENT).alias("_before"), F.col("condition").alias("_was"))
        done_again = recovered.select("incident_id", F.lit("RECOVERED").alias("_now"))
        corrected = (
            every.join(before, "incident_id")
            .join(done_again, "incident_id", "left")
            .withColumn("condition", F.coalesce("_now", "condition"))
            .filter(~F.struct(*CONTENT).eqNullSafe(F.col("_before")))
        )
        fresh_recovered = recovered.join(before.filter("_was = 'RECOVERED'"), "incident_id", "left_anti")
        gone = old.join(every.select("incident_id"), "incident_id", "left_anti")
        parts = {
            "new": every.join(before, "incident_id", "left_anti"), "recovered": fresh_recovered,
            "changed": corrected, "withdrawn": gone,
        }
        frames = [df.select(*every.columns, F.lit(change).alias("change")) for change, df in parts.items()]
        return reduce(DataFrame.unionByName, frames)

    def _apply(self, new: DataFrame, recovered: DataFrame, changed: DataFrame, withdrawn: DataFrame) -> None:
        """Add rows the table doesn't have, correct and remove reopened ones; set the condition of rows that are still open."""
        table = tables.read_incidents(self.spark, self.table_path)
        removed = None
        if table is not None:
            new = new.join(table.select("incident_id"), "incident_id", "left_anti")
            stands = table.filter("status = 'CLOSED'").select("incident_id", F.col("status").alias("_status"), F.col("condition").alias("_condition"))
            changed = changed.join(table.select("incident_id"), "incident_id", "left_semi").join(stands, "incident_id", "left")
            changed = changed.withColumns({"status": F.coalesce("_status", "status"), "condition": F.coalesce("_condition", "condition")})
            new = new.unionByName(changed.select(*new.columns))
            removed = materialize(table.select("incident_id").join(withdrawn.select("incident_id"), "incident_id", "left_semi"), "withdrawn")
        new = materialize(new, "rows")
        if not is_empty(new) or (removed is not None and not is_empty(removed)):
            tables.save(self.spark, self.table_path, new, stored_logs=self.stored_logs, removed=removed)
        table = tables.read_incidents(self.spark, self.table_path)
        if table is None:
            return
        back = (
            table.join(recovered.select("incident_id"), "incident_id", "left_semi")
            .filter(tables._is_recoverable())
            .withColumn("condition", F.lit("RECOVERED"))
        )
        back = materialize(back, "recovered")
        if not is_empty(back):
            tables.save(self.spark, self.table_path, back, stored_logs=self.stored_logs)

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the query on a stream of raw lines, e.g. ``availableNow=True``."""
        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def drain(self, last_batch: int) -> None:
        """End of input: settle every pending window."""
        pending = self._read_state("pending", last_batch)
        if pending is not None:
            self.settle(pending.limit(0), last_batch + 1, everything=True)

    def late_rows(self) -> DataFrame | None:
        """Messages that came after their window was settled and reopened nothing."""
        return tables.read_table(self.spark, f"{self.state_path}/late")

    def overflow_rows(self) -> DataFrame | None:
        """Messages beyond ``max_size`` of their window."""
        return self._current("overflow")

    def feed(self) -> DataFrame | None:
        return tables.read_table(self.spark, f"{self.state_path}/feed")


def session_counts(messages: DataFrame, gap_sec: float, delay: str = "10 seconds") -> DataFrame:
    """Idle-gap sessions of a stream with native session windows."""
    gap = f"{int(gap_sec * 1000)} milliseconds"
    return (
        messages.withWatermark("received_at", delay)
        .groupBy("domain", F.session_window("received_at", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("domain", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def tumbling_hosts(messages: DataFrame, window_sec: float = 10, delay: str = "10 seconds") -> DataFrame:
    """Messages per fixed window and host of a stream."""
    return (
        messages.withWatermark("received_at", delay)
        .groupBy(
            "domain", F.window("received_at", f"{int(window_sec * 1000)} milliseconds").alias("w"), "hostname"
        )
        .agg(F.count("*").alias("n"))
        .select("domain", F.col("w.start").alias("window_start"), "hostname", "n")
    )


def count_received(lines: DataFrame, name: str = "intake") -> DataFrame:
    """Attach the received counter; it shows up in the progress of the running query."""
    return lines.observe(name, F.count(F.lit(1)).alias("received"))


def nightly_upkeep(
    spark: SparkSession,
    table_path: str,
    as_of,
    *,
    cache: DataFrame | None = None,
    days: int = tables.RETENTION_DAYS,
    ttl_days: int = CACHE_TTL_DAYS,
) -> tuple[int, DataFrame | None]:
    """Retention of the incident table and, if given, the live part of the report cache."""
    removed = tables.purge(spark, table_path, as_of, days)
    return removed, None if cache is None else cache_purge(cache, as_of, ttl_days)
