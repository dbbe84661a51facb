"""Session helpers: one place for the SQL confs every operator relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# SQL confs the operators need regardless of who built the session.  They are
# runtime confs, so they can be set on a session the caller already owns.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Duplicate meta names: the last one wins, as in a dict assignment loop.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Arrow batches for the few Python stages: up to 10,000 narrow rows, but
    # never more than 4 MB, so batches of wide page and text rows stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime confs and make sure a checkpoint folder exists.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; only when it is unset (tests, local runs) a scratch folder is made.
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names.

    Only a ``local[...]`` session, where driver and executors are one process,
    gets a scratch folder of its own when ``spark.checkpoint.dir`` is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pagelake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the caller started from.

    ``addPyFile`` serves the zip from the driver to every executor, so no
    shared folder or PYTHONPATH is needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pagelake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pagelake-pkg-"), "pagelake_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("pagelake", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._pagelake_shipped = True


def build(app: str = "pagelake", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; clusters pass their own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.driver.memory", os.environ.get("PAGELAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
