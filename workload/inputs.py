"""Log lines and topology documents derived from the shared `events` table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.functions.parse import parse_syslog
from alarmlens.operators.topology import Topology, load_topology
from alarmlens.operators.windows import anchored_windows
from alarmlens.runtime import materialize
from alarmlens.sources.topology_docs import from_column

SITE_DEVICES = 25


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _spread(df: DataFrame) -> DataFrame:
    """A shared file is one row group, hence one busy task; spread it over the idle cores.

    Inputs with at least one file per core are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _message() -> Column:
    k = F.get_json_object("props", "$.k")
    port = F.concat(F.lit("%LINK-3-UPDOWN: Interface Gi0/"), k, F.lit(", changed state to "))
    kind = F.col("event_type")
    return (
        F.when(kind == "error", F.concat(port, F.lit("down")))
        .when(kind == "signup", F.concat(F.lit("%BGP-5-ADJCHANGE: neighbor 10.0.0."), k, F.lit(" Down")))
        .when(kind == "purchase", F.concat(port, F.lit("up")))
        .when(kind == "click", F.concat(F.lit("%SYS-5-CONFIG_I: Configured from console by vty"), k))
        .otherwise(F.concat(F.lit("session "), k, F.lit(" refreshed")))
    )


def repeated_lines(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """The whole log several times over, each copy 31 days after the one before."""
    lines = raw_lines(spark, sf_dir)
    total = lines.agg(F.max("seq")).first()[0] + 1
    each = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return each.select(
        "raw",
        "source_ip",
        (F.col("received_at") + F.make_dt_interval(days=31 * F.col("copy"))).alias("received_at"),
        (F.col("seq") + total * F.col("copy")).alias("seq"),
        "domain",
    )


def raw_lines(spark: SparkSession, sf_dir: str, *, sites: int = 0) -> DataFrame:
    """One syslog line per event, in three header forms and without a header.

    Every seventh device only sends debug detail, so it is known but never active.
    ``sites`` spreads the devices over that many domains.
    """
    user, event = F.col("user_id"), F.col("event_id")
    severity = (
        F.when(user % 7 == 1, 7)
        .when(F.col("event_type").isin("error", "purchase"), 3)
        .when(F.col("event_type") == "view", 6)
        .otherwise(5)
    )
    pri = F.concat(F.lit("<"), ((16 + user % 8) * 8 + severity).cast("string"), F.lit(">"))
    host = F.concat(F.lit("N"), user.cast("string"))
    address = F.concat_ws(
        ".", F.lit("10.1"), F.floor(user / 256).cast("string"), (user % 256).cast("string")
    )
    stamp = F.concat(
        F.date_format("ts", "MMM "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
        F.date_format("ts", " HH:mm:ss"),
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = _message()
    tagged = F.concat(event.cast("string"), F.lit(": "), host, F.lit(": "), text)
    form = event % 10
    app = F.concat(F.lit(" app "), event.cast("string"), F.lit(" ID - "))
    raw = (
        F.when(form <= 4, F.concat(pri, stamp, F.lit(" "), host, F.lit(" "), text))
        .when(form == 5, F.concat(pri, stamp, F.lit(" "), address, F.lit(" "), tagged))
        .when(form <= 7, F.concat(pri, F.lit("1 "), iso, F.lit(" "), host, app, text))
        .when(form == 8, F.concat(pri, F.lit("1 "), iso, F.lit(" -"), app, tagged))
        .otherwise(text)
    )
    domain = (
        F.concat(F.lit("site"), (user % sites).cast("string")) if sites else F.lit("default")
    )
    return _spread(events(spark, sf_dir)).select(
        raw.alias("raw"),
        address.alias("source_ip"),
        F.col("ts").alias("received_at"),
        event.alias("seq"),
        domain.alias("domain"),
    )


def messages(spark: SparkSession, sf_dir: str, *, sites: int = 0) -> DataFrame:
    return parse_syslog(raw_lines(spark, sf_dir, sites=sites))


def windowed_messages(spark: SparkSession, sf_dir: str, window_sec: int = 600) -> DataFrame:
    parsed = materialize(messages(spark, sf_dir), "messages")
    return materialize(anchored_windows(parsed, window_sec), "windowed")


def topology_documents(spark: SparkSession, sf_dir: str, *, changed: bool = False) -> DataFrame:
    """Site documents as JSON text, 25 devices each.

    Device N has parent (N-1) div 4. The documents also hold what a loader has to sort
    out: repeated devices, links with three ends, links to unknown devices, sessions
    that repeat a link. ``changed`` drops and adds some links for a second version.
    """
    i = F.col("user_id")
    parent = F.floor((i - 1) / 4).cast("bigint")
    grand = F.floor((parent - 1) / 4).cast("bigint")

    def dev(n: Column) -> Column:
        return F.concat(F.lit("N"), n.cast("string"))

    role = (
        F.when(i == 0, "spine")
        .when(i <= 4, "core")
        .when(i <= 20, "distribution")
        .when(i <= 84, "access")
        .when(i <= 340, "leaf")
        .when(i % 3 == 0, "oob")
    )

    def end(n: Column) -> Column:
        return F.struct(dev(n).alias("device-id"), F.lit("Gi0/0").alias("interface-id"))

    def peer(n: Column) -> Column:
        return F.struct(dev(n).alias("device-id"))

    def device(r: Column) -> Column:
        ports = F.array(
            F.struct(
                F.lit("Gi0/0").alias("interface-id"),
                F.concat(F.lit("to "), dev(parent)).alias("description"),
                F.concat(F.lit("10.9.0."), (i % 250).cast("string")).alias("ip-address"),
            ),
            F.struct(
                F.lit("Gi0/1").alias("interface-id"),
                F.lit(None).cast("string").alias("description"),
                F.lit(None).cast("string").alias("ip-address"),
            ),
        )
        return F.struct(dev(i).alias("device-id"), r.alias("role"), ports.alias("interface"))

    def link(tag: str, *ends: Column) -> Column:
        return F.struct(
            F.concat(F.lit(tag), i.cast("string")).alias("connection-id"), F.array(*ends).alias("endpoint")
        )

    def session(tag: str, kind: Column, a: Column, b: Column) -> Column:
        return F.struct(
            F.concat(F.lit(tag), i.cast("string")).alias("session-id"),
            kind.cast("string").alias("type"),
            F.array(peer(a), peer(b)).alias("endpoint"),
        )

    devices = F.array(F.when(i % 9 == 0, device(F.lit("other"))), device(role))
    uplink = F.when(
        i >= 1, F.when(i % 5 == 0, link("c", end(i), end(parent))).otherwise(link("c", end(parent), end(i)))
    )
    if changed:
        uplink = F.when(i % 8 != 3, uplink)
    links = F.array(
        uplink,
        F.when(i % 10 == 3, link("t", end(i), end(i + 1), end(parent))),
        F.when(i % 11 == 0, link("u", end(i), end(i + 1_000_000_000))),
        F.when((i % 12 == 5) & F.lit(changed), link("x", end(grand), end(i))),
    )
    sessions = F.array(
        F.when((i % 4 == 1) & (i < F.col("last")), session("i", F.lit("ibgp"), i + 1, i)),
        F.when((i >= 5) & (i % 3 == 0), session("g", F.lit(None), i, grand)),
        F.when((i > 0) & (i % 6 == 0), session("p", F.lit("ebgp"), parent, i)),
    )
    users = events(spark, sf_dir).groupBy("user_id").agg(F.lit(1).alias("one"))
    last = users.agg(F.max("user_id")).first()[0]
    rows = users.withColumn("last", F.lit(last)).select(
        F.floor(i / SITE_DEVICES).alias("site"),
        "user_id",
        *(F.array_compact(c).alias(n) for n, c in (("d", devices), ("l", links), ("s", sessions))),
    )

    def gathered(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("user_id", F.col(name).alias("items"))))
        return F.flatten(F.transform(ordered, lambda x: x["items"]))

    docs = rows.groupBy("site").agg(*(gathered(n).alias(n) for n in "dls"))
    return docs.select(
        F.format_string("site-%05d", "site").alias("doc_id"),
        F.to_json(
            F.struct(
                F.struct(
                    F.struct(F.col("d").alias("device"), F.col("l").alias("physical-connection")).alias(
                        "physical-layer"
                    ),
                    F.struct(F.col("s").alias("bgp-session")).alias("layer3-layer"),
                ).alias("network-model")
            )
        ).alias("doc"),
    )


def topology(spark: SparkSession, sf_dir: str, *, changed: bool = False) -> Topology:
    return load_topology(from_column(topology_documents(spark, sf_dir, changed=changed), "doc"))
