"""Spark session helpers.

Library code never creates its own session; it takes the caller's. These
helpers are for tests, the bench and the entry module, and for the few
operators that need a durable folder (checkpoints, snapshots).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE coalesces the many small shuffle
# partitions of a log scan, splits skewed join partitions and switches a
# join to broadcast only when the runtime size of a side is below the
# threshold. The threshold bounds every implicit broadcast.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of the merge rounds and reused tables go away with
    # the DataFrames that own them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "errorlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("ERRORLENS_DRIVER_MEMORY", "8g")))
    conf = {**DEFAULT_CONF, **(extra or {})}
    conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="errorlens-ckpt-"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and is read as is. Only
    when it is unset (local tests) is a fresh scratch folder taken.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach "
                             "(a machine-local folder does not survive lost executors)")
        path = tempfile.mkdtemp(prefix="errorlens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def checkpoint(df):
    """Reliable checkpoint of ``df`` into the shared checkpoint folder (cuts
    the lineage; survives lost executors). Sets the folder on a session
    that has none, as a test session."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
