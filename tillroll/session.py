"""Session settings the plans rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings changed on the running session. With ANSI a bad cast or an overflow is
# an error, never a NULL or a wrong number. AQE re-plans joins from real sizes:
# a side is broadcast only when its measured size is under the threshold, and a
# hot join key is split over many tasks. Several plans aggregate on the join key
# right after the join; "force" lets AQE split a hot key there too, paying one
# extra shuffle only when a skewed partition is really found.
RUNTIME_SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Shuffles start with this many partitions and AQE merges small ones; it cannot
# cut a partition that is large without being skewed, so the start must be high.
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
CHOSEN_PARTITIONS = "spark.tillroll.chosenPartitions"  # what `tune` itself last set
TASKS_PER_CORE = 3


def tune(spark: SparkSession, initial_partitions: int | None = None) -> SparkSession:
    """Apply the settings. Name the partitions for shuffles of many terabytes, at
    about 200 MB each; left out, every core of the cluster gets a few."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    given = spark.conf.get(INITIAL_PARTITIONS, None)
    if initial_partitions is None and given in (None, spark.conf.get(CHOSEN_PARTITIONS, None)):
        initial_partitions = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            TASKS_PER_CORE * spark.sparkContext.defaultParallelism,
        )
        spark.conf.set(CHOSEN_PARTITIONS, str(initial_partitions))
    if initial_partitions is not None:
        spark.conf.set(INITIAL_PARTITIONS, str(initial_partitions))
    return spark


def local_session(cores: str = "8", app: str = "tillroll", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        # No Python call sites in error messages: they double the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the cluster's shared checkpoint folder, or, where a
    session names none, under its warehouse, which executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
