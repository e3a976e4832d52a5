"""Session defaults and durable intermediate results."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_RUN_ID = uuid.uuid4().hex[:12]
_SHIPPED: set[str] = set()
_TABLES: dict[str, list[str]] = {}


def build_session(app: str = "alarmlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle partitions are left to adaptive execution: many small partitions are
    merged after each shuffle and skewed ones are split.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it anywhere."""
    app_id = spark.sparkContext.applicationId
    if app_id in _SHIPPED:
        return
    _SHIPPED.add(app_id)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="alarmlens-code-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(
        os.path.join(folder, "alarmlens"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, reachable by every executor.

    It is the one named in ``spark.checkpoint.dir``. Only a local-mode session may
    run without that setting; it gets a temporary folder, removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    app_id = spark.sparkContext.applicationId
    if app_id in _LOCAL_DIRS:
        return _LOCAL_DIRS[app_id]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="alarmlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    _LOCAL_DIRS[app_id] = path
    return path


def run_dir(spark: SparkSession) -> str:
    """Folder of everything this process leaves in the shared folder; ``release`` deletes it."""
    return f"{shared_dir(spark)}/alarmlens-{_RUN_ID}"


def own_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """Name and path of a catalog table that ``release`` drops."""
    named = f"{name}_{uuid.uuid4().hex[:12]}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(named)
    return named, f"{run_dir(spark)}/{named}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the optimizer
    real file sizes, so that only sides of a checked size get broadcast.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this process wrote to the shared folder."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0
