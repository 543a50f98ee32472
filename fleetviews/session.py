"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


# Bytes one shuffle partition should hold: a task sorts that much in memory.
PARTITION_BYTES = 128 * 1024 * 1024


def build_session(
    app_name: str = "fleetviews", master: str | None = None, shuffled_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the library is tested with.

    Adaptive execution makes shuffles narrower, never wider than they start. So for
    large inputs give ``shuffled_bytes``, the size of the largest shuffle expected:
    shuffles then start wide enough for it, and small ones are coalesced.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Shuffled partitions known to be this small are hashed instead of sorted.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(PARTITION_BYTES))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if shuffled_bytes:
        width = max(200, -(-shuffled_bytes // PARTITION_BYTES))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(width))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables and stream checkpoints that every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        parent = tempfile.mkdtemp(prefix="run-")
    return f"{parent.rstrip('/')}/fleetviews-{name}-{uuid.uuid4().hex}"
