"""Spark session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every clicktrail job relies on: UTC wall clock, last-wins for
# duplicate map keys (the Hive map text parser), adaptive execution with
# skew-join splitting, and ANSI mode so bad input is handled by try_* calls.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce small shuffles less eagerly: CPU-bound stages over a few MB keep all cores busy;
    # at scale partitions are far above this floor and the advisory size governs
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(
    master: str = "local[8]", shuffle_partitions: int = 8, app: str = "clicktrail", checkpoint_dir: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")  # local sessions only
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (driver-made sessions included)."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked settings: keep the session's own
            pass
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local session may go without one."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) session: the server's own setting applies
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one machine, as in tests: a local folder is shared by all tasks
        configured = tempfile.mkdtemp(prefix="clicktrail-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def scale_conf(
    input_bytes: float,
    total_cores: int,
    shuffle_fraction: float = 0.3,
    target_partition_bytes: int = 256 * 1024 * 1024,
) -> dict[str, str]:
    """Session settings for a cluster run, from the input size and the total executor cores.

    * scan splits of ``target_partition_bytes`` (column pruning makes a split's
      in-memory rows a fraction of that);
    * shuffle partitions so that the shuffled bytes - ``shuffle_fraction`` of
      the input after pruning and partial aggregation - land near the same size
      per partition, at least two per core (AQE coalesces small ones and splits
      skewed ones at run time);
    * the same size as AQE's advisory partition size and skew threshold.

    Example: 100 TB on 1,000 executors x 4 cores gives ~114,000 shuffle partitions.
    """
    shuffled = input_bytes * shuffle_fraction
    parts = int(max(2 * total_cores, -(-shuffled // target_partition_bytes)))
    size = str(target_partition_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 * 1024 * 1024),
    }
