"""Root-cause inference: windowed messages and a topology to incidents.

All graph and ownership steps run on one row per (window, host). Messages are read
twice: once for the per-host aggregate and once for the first logs of each incident.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.functions.parse import is_routing_event
from alarmlens.functions.texts import SILENT_EVENT, flapping_event
from alarmlens.operators.closure import ancestors, gained_ancestors, met_ancestors, physical_closure
from alarmlens.operators.filters import drop_recoveries, known_hosts
from alarmlens.operators.ranking import first_per_group
from alarmlens.operators.topology import Topology
from alarmlens.runtime import is_empty, materialize

WINDOW = ["domain", "window_start"]
HOST = [*WINDOW, "hostname"]

# Order of the incident kinds inside a window and number of stored logs.
FLAPPING, SILENT, REGULAR, INDEPENDENT = 1, 2, 3, 4
KIND_NAMES = {FLAPPING: "flapping", SILENT: "silent", REGULAR: "regular", INDEPENDENT: "independent"}
STORED_LOGS = 200
NO_MESSAGE = "N/A"
PLACE_MASK = (1 << 40) - 1  # bits of a hash that tells whether an ancestor may log in a window


@dataclass(frozen=True)
class Rules:
    severity_threshold: int = 5
    silent_coverage: float = 0.6
    flapping_threshold: int = 3


def host_stats(messages: DataFrame, rules: Rules = Rules(), *, time_col: str = "received_at") -> DataFrame:
    """One row per (window, active host): counts, first evidence, routing flag, flapping event.

    Aggregated first per event type, so a noisy host is reduced inside each map task.
    """
    # Time, arrival and text in one value: a shuffled row holds each of them, and a message that is the first of both kinds, once.
    at = F.struct(F.col(time_col).alias("ts"), "seq", "message")
    active = F.col("severity") <= rules.severity_threshold
    per_event = messages.groupBy(*HOST, "event_type").agg(
        F.count("*").alias("n"),
        F.count_if(active).alias("n_active"),
        F.min(F.when(active, at)).alias("first_active"),
        F.min(F.when(~F.coalesce(active, F.lit(False)), at)).alias("first_other"),
        F.max(active & is_routing_event(F.col("message"))).alias("routing"),
        F.max("window_end").alias("window_end"),
    )
    repeated = F.col("event_type").isNotNull() & (F.col("n_active") >= rules.flapping_threshold)
    if rules.flapping_threshold <= 0:
        repeated = F.lit(False)
    # Most repeated event first, then the one seen earliest.
    weight = F.struct(
        F.col("n_active"),
        -F.unix_micros("first_active.ts"),
        -F.col("first_active.seq"),
    )
    per_host = per_event.groupBy(*HOST).agg(
        F.sum("n").alias("n_logs"),
        F.sum("n_active").alias("n_active"),
        F.min("first_active").alias("first_active"),
        F.min("first_other").alias("first_other"),
        F.max("routing").alias("is_routing"),
        F.max_by(
            F.struct(F.col("event_type").alias("event"), F.col("n_active").alias("times")),
            F.when(repeated, weight),
        ).alias("flap"),
        F.max("window_end").alias("window_end"),
    )
    return per_host.filter("n_active > 0").select(
        *HOST,
        "n_logs",
        "n_active",
        F.struct("first_active.ts", "first_active.seq").alias("first_seen"),
        F.col("first_active.message").alias("active_message"),
        F.least("first_active", "first_other")["message"].alias("message"),
        "is_routing",
        "flap",
        "window_end",
    )


def _marked_ancestors(hosts: DataFrame, reach: DataFrame) -> DataFrame:
    """Proper ancestors of each active host, with whether they are active themselves."""
    evidence = hosts.select(
        *WINDOW, F.col("hostname").alias("ancestor"), F.lit(True).alias("evident")
    )
    return (
        reach.filter(F.col("hostname") != F.col("ancestor"))
        .join(evidence, [*WINDOW, "ancestor"], "left")
        .withColumn("evident", F.coalesce("evident", F.lit(False)))
    )


def _needed_cover(hosts: DataFrame, coverage: float) -> DataFrame:
    """Hosts that a silent root has to cover, per window of two or more hosts."""
    totals = hosts.groupBy(*WINDOW).agg(F.count("*").alias("n_hosts")).filter("n_hosts >= 2")
    needed = F.greatest(F.lit(2), F.floor(F.col("n_hosts") * F.lit(float(coverage))))
    return totals.select(*WINDOW, needed.alias("needed"))


def _wide_ancestors(hosts: DataFrame, physical: DataFrame, coverage: float) -> DataFrame:
    """Proper physical ancestors of each active host that have as many nodes below them as a silent root of the window has to cover."""
    proper = physical.filter(F.col("node") != F.col("ancestor"))
    sizes = proper.groupBy("ancestor").agg(F.count("*").alias("n_below")).filter("n_below >= 2")
    up = materialize(proper.join(sizes, "ancestor").select(F.col("node").alias("hostname"), "ancestor", "n_below"), "sized")
    wanted = hosts.select(*HOST).join(_needed_cover(hosts, coverage), WINDOW)
    pairs = wanted.join(up, (wanted["hostname"] == up["hostname"]) & (F.col("n_below") >= F.col("needed")))
    return pairs.select(*WINDOW, wanted["hostname"], "ancestor", F.lit(True).alias("physical"))


def silent_candidates(hosts: DataFrame, reach: DataFrame, coverage: float) -> DataFrame:
    """Inactive physical ancestors that cover enough active hosts, ranked per window.

    ``reach`` may leave out ancestors with fewer nodes below them than a candidate of the window covers.
    """
    covered = reach.filter("physical").groupBy(*WINDOW, "ancestor").agg(F.count("*").alias("covers"))
    best_first = W.partitionBy(*WINDOW).orderBy(F.desc("covers"), "ancestor")
    return (
        covered.join(_needed_cover(hosts, coverage), WINDOW)
        .filter(F.col("covers") >= F.col("needed"))
        .join(hosts.select(*WINDOW, F.col("hostname").alias("ancestor")), [*WINDOW, "ancestor"], "left_anti")
        .withColumn("rank", F.row_number().over(best_first))
        .select(*WINDOW, "ancestor", "covers", "rank")
    )


def _silent_owners(hosts: DataFrame, reach: DataFrame, candidates: DataFrame) -> DataFrame:
    """Silent root of each host: candidates take their free hosts in rank order. ``reach`` has the hosts' pairs with candidates.

    A candidate left with fewer than two hosts is skipped and takes none. Taking in
    rank order means that a host goes to its best-ranked candidate, so one minimum per
    host settles all hosts of candidates that take two or more: hosts only ever move to
    later candidates, so nobody loses any. Only the hosts of lonely candidates, which
    take exactly one, go on to the next round. All lonely candidates leave at once but those with a
    claim to the host of an earlier lonely one, which may still gain it. The number of
    rounds is the longest chain of lonely candidates that wait for one another, whatever
    the number of windows and candidates.
    """
    free = hosts.filter("flap is null").select(*HOST)
    claims = (
        reach.join(candidates.select(*WINDOW, "ancestor", "rank"), [*WINDOW, "ancestor"])
        .join(free, HOST, "left_semi")
        .select(*HOST, F.struct("rank", F.col("ancestor").alias("root")).alias("claim"), F.lit(False).alias("sure"))
    )
    claims = materialize(claims, "claims")
    settled: list[DataFrame] = []
    while True:
        owners = claims.groupBy(*HOST).agg(F.min(F.struct("claim", "sure")).alias("own")).select(*HOST, "own.*")
        stays = F.max("sure") | (F.count("*") >= 2)
        held = materialize(
            owners.drop("sure").join(owners.groupBy(*WINDOW, "claim").agg(stays.alias("stays")), [*WINDOW, "claim"]),
            "owners",
        )
        settled.append(held.filter("stays").drop("stays"))
        loose = held.filter("not stays").select(*HOST, F.col("claim").alias("owner"))
        if is_empty(loose):
            break
        state = held.select(*WINDOW, "claim", "stays").distinct()
        pool = claims.join(loose, HOST).join(state, [*WINDOW, "claim"], "left")
        pool = materialize(pool.withColumn("sure", F.coalesce("stays", "sure")), "loose_claims")
        waiting = pool.filter("not stays and claim != owner").select(*WINDOW, "claim").distinct()
        waiting = waiting.withColumn("waits", F.lit(True))
        claims = materialize(
            pool.join(waiting, [*WINDOW, "claim"], "left").filter("claim != owner or waits").select(*HOST, "claim", "sure"),
            "claims",
        )
    out = settled[0]
    for piece in settled[1:]:
        out = out.unionByName(piece)
    return out.select(*HOST, F.col("claim.root").alias("silent_root"), F.col("claim.rank").alias("silent_rank"))


def assign_hosts(
    messages: DataFrame,
    topology: Topology,
    rules: Rules = Rules(),
    *,
    physical: DataFrame | None = None,
    time_col: str = "received_at",
) -> DataFrame:
    """Every active known host of a window with the incident (kind, root) it belongs to."""
    hosts = materialize(host_stats(known_hosts(messages, topology.nodes), rules, time_col=time_col), "hosts")
    if physical is None:
        physical = physical_closure(topology.nodes, topology.edges)
    # Most ancestors are silent and cover too little of a window, so pairs are stored only where the ancestor is active or a candidate.
    met = materialize(met_ancestors(hosts, physical, WINDOW), "met")
    grown = gained_ancestors(hosts, physical, topology.edges, WINDOW, met)
    logged = hosts.select(*WINDOW, F.col("hostname").alias("ancestor"))
    evident = met.unionByName(grown.join(logged, [*WINDOW, "ancestor"], "left_semi")).filter("hostname != ancestor")
    evident = materialize(evident, "evident")
    wide = _wide_ancestors(hosts, physical, rules.silent_coverage)
    candidates = materialize(silent_candidates(hosts, wide, rules.silent_coverage), "candidates")
    tops = candidates.select("ancestor").distinct()
    over = physical.join(tops, "ancestor", "left_semi").select(F.col("node").alias("hostname"), "ancestor")
    below_tops = hosts.select(*HOST).join(over, "hostname").select(*HOST, "ancestor")
    silent = _silent_owners(hosts, below_tops.unionByName(grown), candidates)

    below = evident.select(*HOST).distinct().withColumn("has_upstream", F.lit(True))
    staged = hosts.join(silent, HOST, "left").join(below, HOST, "left")
    is_free = F.col("flap").isNull() & F.col("silent_root").isNull()
    is_root = is_free & F.col("has_upstream").isNull()
    roots = staged.filter(is_root).select(
        *WINDOW, F.col("hostname").alias("ancestor"), F.struct("first_seen", "hostname").alias("claim")
    )
    owned = (
        evident.join(roots, [*WINDOW, "ancestor"])
        .groupBy(*HOST)
        .agg(F.min("claim").alias("owner"))
    )
    owner = F.col("owner.hostname")
    kind = (
        F.when(F.col("flap").isNotNull(), FLAPPING)
        .when(F.col("silent_root").isNotNull(), SILENT)
        .when(is_root | owner.isNotNull(), REGULAR)
        .otherwise(INDEPENDENT)
    )
    root = (
        F.when(F.col("kind_no") == SILENT, F.col("silent_root"))
        .when((F.col("kind_no") == REGULAR) & ~is_root, owner)
        .otherwise(F.col("hostname"))
    )
    return (
        staged.join(owned, HOST, "left")
        .withColumn("kind_no", kind)
        .withColumn("root_cause_node", root)
        .drop("owner", "has_upstream", "silent_root")
    )


def build_incidents(assigned: DataFrame) -> DataFrame:
    """Fold assigned hosts to incidents; sizes are bounded by the topology, not by the logs."""
    is_root = F.col("hostname") == F.col("root_cause_node")
    primary = F.when(F.col("kind_no") == INDEPENDENT, F.col("message")).otherwise(F.col("active_message"))
    # Moved once, by window: the places inside a window need its incidents together anyway.
    placed = assigned.select(
        *WINDOW,
        "kind_no",
        "root_cause_node",
        "window_end",
        F.when(~is_root, F.col("hostname")).alias("secondary"),
        "n_logs",
        F.when(is_root, primary).alias("root_message"),
        F.when(is_root, F.col("flap")).alias("flap"),
        F.when(is_root, F.col("first_seen")).alias("root_seen"),
        "silent_rank",
    ).repartition(*WINDOW)
    folded = placed.groupBy(*WINDOW, "kind_no", "root_cause_node").agg(
        F.max("window_end").alias("window_end"),
        F.array_sort(F.collect_set("secondary")).alias("secondary_nodes"),
        F.sum("n_logs").alias("raw_log_count"),
        F.max("root_message").alias("root_message"),
        F.max("flap").alias("flap"),
        F.min("root_seen").alias("root_seen"),
        F.min("silent_rank").alias("silent_rank"),
    )
    event = (
        F.when(F.col("kind_no") == FLAPPING, flapping_event(F.col("flap.event"), F.col("flap.times")))
        .when(F.col("kind_no") == SILENT, F.lit(SILENT_EVENT))
        .otherwise(F.coalesce("root_message", F.lit(NO_MESSAGE)))
    )
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    order = W.partitionBy(*WINDOW).orderBy(
        "kind_no",
        "silent_rank",
        F.when(F.col("kind_no") == REGULAR, F.col("root_seen")),
        "root_cause_node",
    )
    return folded.select(
        *WINDOW,
        "window_end",
        F.row_number().over(order).alias("emit_rank"),
        names[F.col("kind_no")].alias("kind"),
        "root_cause_node",
        event.alias("primary_event"),
        "secondary_nodes",
        "raw_log_count",
        F.lit("OPEN").alias("status"),
        F.when(F.col("kind_no") == FLAPPING, "FLAPPING").otherwise("ACTIVE").alias("condition"),
    )


LOG_KEY = [*WINDOW, "kind", "root_cause_node"]


def incident_logs(messages: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every log row with the incident it belongs to, in long form and uncapped."""
    member = assigned.select(*HOST, "root_cause_node", "kind_no")
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return messages.join(member, HOST).withColumn("kind", names[F.col("kind_no")]).drop("kind_no")


def stored_logs(
    messages: DataFrame, assigned: DataFrame, n: int = STORED_LOGS, *, time_col: str = "received_at"
) -> DataFrame:
    """First ``n`` messages per incident as an ordered array.

    Cut to ``n`` per host before joining, so a storm of one host does not reach the
    join; the first ``n`` of an incident are among the first ``n`` of its hosts.
    """
    order = [F.col(time_col), F.col("seq")]
    per_host = first_per_group(messages.select(*HOST, time_col, "seq", "message"), HOST, order, n)
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    # Grouped by the key that incidents are joined on, so the logs do not move again for that join.
    member = assigned.select(*HOST, "root_cause_node", names[F.col("kind_no")].alias("kind"))
    kept = first_per_group(per_host.join(member, HOST), LOG_KEY, order, n)
    logs = F.array_sort(F.collect_list(F.struct("rank", "message")))
    return kept.groupBy(*LOG_KEY).agg(F.transform(logs, lambda x: x.message).alias("raw_logs"))


def infer(
    messages: DataFrame,
    topology: Topology,
    rules: Rules = Rules(),
    *,
    drop_recovery: bool = True,
    physical: DataFrame | None = None,
    time_col: str = "received_at",
    logs: bool = True,
) -> DataFrame:
    """Incidents of all windows at once.

    ``messages`` carry ``window_start`` and ``window_end``. Equal first-seen times are
    ordered by arrival (``seq``), equal coverage by node name. ``raw_logs`` holds the first 200 messages,
    as stored; ``raw_log_count`` counts all, and ``incident_logs`` lists all.
    """
    incidents, first_logs = infer_parts(
        messages, topology, rules, drop_recovery=drop_recovery, physical=physical, time_col=time_col
    )
    return incidents.join(first_logs, LOG_KEY) if logs else incidents


def infer_parts(
    messages: DataFrame,
    topology: Topology,
    rules: Rules = Rules(),
    *,
    drop_recovery: bool = True,
    physical: DataFrame | None = None,
    time_col: str = "received_at",
    log_rows: int = STORED_LOGS,
) -> tuple[DataFrame, DataFrame]:
    """Incidents without logs, and the logs to join on ``LOG_KEY``.

    What is derived from incidents alone, such as their numbers, comes before that join, so the
    messages are read for logs once. ``log_rows`` logs of an incident are kept.
    """
    evidence = drop_recoveries(messages) if drop_recovery else messages
    assigned = materialize(
        assign_hosts(evidence, topology, rules, physical=physical, time_col=time_col), "assigned"
    )
    return build_incidents(assigned), stored_logs(evidence, assigned, log_rows, time_col=time_col)


def simple_roots(messages: DataFrame, topology: Topology, closure: DataFrame | None = None) -> DataFrame:
    """Plain variant: no severity, sessions, flapping or silent roots, and no ownership.

    Roots are known hosts without a logging ancestor; every logging descendant is
    secondary, also when two roots share it.
    """
    seen = known_hosts(messages, topology.nodes)
    hosts = materialize(
        seen.groupBy(*HOST).agg(
            F.min_by("message", F.struct("received_at", "seq")).alias("primary_event")
        ),
        "hosts",
    )
    pairs = ancestors(topology.edges) if closure is None else closure
    above = hosts.select(*HOST).join(pairs.select(F.col("node").alias("hostname"), "ancestor"), "hostname")
    logged = hosts.select(*WINDOW, F.col("hostname").alias("ancestor"))
    # Few ancestors log in a window of their descendants. Which ones is found by short hashes, so the pairs move as one number
    # each; pairs with a hash that was met, rightly or not, are then compared in full.
    place = (F.xxhash64(*WINDOW, "ancestor").bitwiseAND(F.lit(PLACE_MASK))).alias("place")
    places = materialize(logged.select(place), "places")  # stored first: its size decides whether the pairs have to move
    met = materialize(above.select(place).join(places, "place", "left_semi").distinct(), "met")
    below = materialize(
        above.select("*", place)
        .join(met, "place", "left_semi")
        .drop("place")
        .join(logged, [*WINDOW, "ancestor"], "left_semi"),
        "below",
    )
    roots = hosts.join(below, HOST, "left_anti")
    secondary = below.groupBy(*WINDOW, F.col("ancestor").alias("hostname")).agg(
        F.array_sort(F.collect_set("hostname")).alias("secondary_nodes")
    )
    return roots.join(secondary, HOST, "left").select(
        *WINDOW,
        F.col("hostname").alias("root_cause_node"),
        "primary_event",
        F.coalesce("secondary_nodes", F.array().cast("array<string>")).alias("secondary_nodes"),
    )


def window_summary(messages: DataFrame, incidents: DataFrame) -> DataFrame:
    """Raw logs received and root causes found per window."""
    received = messages.groupBy(*WINDOW).agg(F.count("*").alias("raw_logs"))
    found = incidents.groupBy(*WINDOW).agg(F.count_distinct("root_cause_node").alias("root_causes"))
    return received.join(found, WINDOW, "left").select(
        *WINDOW, "raw_logs", F.coalesce("root_causes", F.lit(0)).alias("root_causes")
    )
