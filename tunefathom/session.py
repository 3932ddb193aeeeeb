"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every operator is written for. Sizes and core counts stay with the cluster.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on a hot key is split even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers get small record batches, so wide arrays do not pile up in one batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Streams keep what they have seen on disk and in the checkpoint, not in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Rows of the library's tables take some fifteen times as much of a task's memory as of a shuffle's files.
TABLE_DEFAULTS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def apply_defaults(spark: SparkSession, more: dict[str, str] = {}) -> SparkSession:
    """Set the runtime defaults on a session somebody else has built."""
    for key, value in {**RUNTIME_DEFAULTS, **more}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tunefathom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the runtime defaults; master and partitions only where the caller names them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return apply_defaults(builder.getOrCreate())


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Without the setting only a local master gets a folder of its own: elsewhere every executor would write to its
    own disk, and later reads would see a part of the rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="tunefathom-")
    return _LOCAL_FOLDERS[application]


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder for one run of ``purpose``."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def settled(df, purpose: str):
    """Write an intermediate result to the shared folder and go on from the files.

    Used where a result is read several times: later stages, retries and lost executors start from the
    files instead of the whole lineage.
    """
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
