"""Session helpers: a sensible local session for tests/bench and the
checkpoint-directory contract used by operators that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "segmint") -> SparkSession:
    """Local session used by tests and ``bench.py``. On a cluster, use the
    cluster's own session; nothing here is required by the operators."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is. Only a local-mode session without the setting (tests) gets a fresh
    private folder under the system temp directory. A non-local session
    without the setting is an error: executors must share the folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="segmint-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for written tables
    (CSV sinks, materialised intermediates)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex}")


def written(df):
    """``df`` written to the shared checkpoint folder and read back: it cuts
    lineage as a checkpoint does, but Spark then knows the true size. A
    checkpoint passes on the estimate of its plan; joins multiply estimates,
    so in a loop the number grows to millions of digits, and planning takes
    all the driver's time and memory."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def num_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def at_once(spark: SparkSession, *steps) -> tuple:
    """The results of functions that run Spark jobs, each in a thread that has
    the caller's job properties; the first error is raised once all ended."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(len(steps)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(f)) for f in steps]
    return tuple(j.result() for j in jobs)
