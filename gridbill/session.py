"""Spark session helpers.

The library never creates a session on its own inside an operator; callers pass
one in. ``local_session`` is a convenience for tests, the bench and notebooks.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gridbill") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Static plans estimate from compressed file sizes, which understates a
        # decompressed hash table many times; plan medium tables as shuffle joins
        # and let AQE broadcast from the measured runtime size instead.
        .config("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(10 << 20))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    On a cluster the directory must be a shared folder named by
    ``spark.checkpoint.dir``; it is read from the session and never replaced.
    Only when nothing is configured *and* the master is local (tests, the bench)
    do we pick a scratch directory of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; point it at a folder shared by all executors"
        )
    base = os.environ.get("GRIDBILL_SCRATCH") or tempfile.mkdtemp(prefix="gridbill-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def output_dir(spark: SparkSession) -> str:
    """Folder for reports and sinks: beside the shared checkpoint folder, not in it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}-output"
