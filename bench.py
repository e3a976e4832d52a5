"""Times the headline jobs on the shared tables and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from alarmlens.operators.closure import physical_closure  # noqa: E402
from alarmlens.operators.topology import Topology  # noqa: E402
from alarmlens.operators.windows import anchored_windows, session_windows  # noqa: E402
from alarmlens.plans.infer import infer  # noqa: E402
from alarmlens.plans.pipeline import run_batch  # noqa: E402
from alarmlens.runtime import build_session, materialize, release  # noqa: E402
from workload import inputs, registry  # noqa: E402


def session():
    cores = os.environ.get("BENCH_CPUS", "8")
    return build_session(
        "alarmlens-bench",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            # Partition sizes that suit the small shared tables; a cluster keeps the defaults.
            "spark.sql.files.openCostInBytes": "65536",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "65536",
        },
    )


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def generated_graph(spark, nodes: int, edges: int) -> Topology:
    """Layered graph of the size in the stated memory target, from a rule."""
    from pyspark.sql import functions as F

    node = spark.range(nodes)
    table = node.select(
        F.concat(F.lit("G"), "id").alias("id"), F.lit("other").alias("role"), F.lit(5).alias("role_priority")
    )
    per_node = edges // nodes
    links = node.filter("id >= 10").select(
        F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("k"), "id"
    ).select(
        F.concat(F.lit("G"), F.floor(F.col("id") / 10) - F.pmod(F.col("k"), F.floor(F.col("id") / 10) + 1)).alias("src"),
        F.concat(F.lit("G"), "id").alias("dst"),
        F.lit("physical").alias("edge_type"),
        F.lit(None).cast("string").alias("bgp_type"),
    ).distinct()
    return Topology(materialize(table, "nodes"), materialize(links, "edges"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, job) -> None:
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)

    topology = inputs.topology(spark, sf_dir)
    physical = physical_closure(topology.nodes, topology.edges)
    messages = materialize(inputs.messages(spark, sf_dir), "messages")
    windowed = materialize(anchored_windows(messages, 600), "windowed")
    n_events = messages.count()

    timed("parse", lambda: run(inputs.messages(spark, sf_dir)))
    timed("topology_load", lambda: inputs.topology(spark, sf_dir))
    timed("closure", lambda: physical_closure(topology.nodes, topology.edges))
    big = generated_graph(spark, 10_000, 50_000)
    timed("closure_10k_nodes", lambda: physical_closure(big.nodes, big.edges))
    timed("anchored_windows_30s", lambda: run(anchored_windows(messages, 30)))
    timed("anchored_windows_600s", lambda: run(anchored_windows(messages, 600)))
    timed("session_windows", lambda: run(session_windows(messages, 600)))
    timed("infer", lambda: run(infer(windowed, topology, physical=physical)))

    def end_to_end(lines) -> None:
        run(run_batch(lines, topology, window_sec=600, time_col="received_at", physical=physical))

    timed("end_to_end", lambda: end_to_end(inputs.raw_lines(spark, sf_dir)))
    timed("end_to_end_x20", lambda: end_to_end(inputs.repeated_lines(spark, sf_dir, 20)))
    registry.incidents(spark, sf_dir)
    for name in ("recovery_join", "similar_by_root", "report_worklist", "semantic_topk", "payload_slack"):
        timed(name, lambda: run(registry.QUERIES[name](spark, sf_dir)))

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "events": n_events,
                "events_per_second_end_to_end": round(n_events / times["end_to_end"]),
                "events_per_second_end_to_end_x20": round(20 * n_events / times["end_to_end_x20"]),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
