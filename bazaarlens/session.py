"""Session settings the plans count on.

Results never depend on these; only the way hot keys and small sides are treated at run time does.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import SparkSession

# AQE splits a hot join partition even when the operator above the join then needs one more
# shuffle: that shuffle carries partial aggregates, the unsplit partition would carry raw rows.
# Small shuffle partitions are merged only up to 4 MB: compressed rows grow eighty-fold in the sorts and hash tables of a
# join and an aggregate, so the 64 MB that Spark merges to by itself hold several GB in one task. Shuffles begin with many
# partitions, which AQE merges, so that a task holds no more of a larger input; a fixed few would grow with it.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "bazaarlens", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession, name: str, of: str = "") -> str:
    """A path in the folder that driver and executors share, `spark.checkpoint.dir`: the one for what is kept `of`
    something, else a new one. A local session without such a folder (tests) gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{f'{zlib.crc32(of.encode()):08x}' if of else uuid.uuid4().hex}"
