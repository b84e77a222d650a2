"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Runtime settings the operators rely on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No stream here emits rows when a watermark passes, so a batch without data does nothing.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # State that outlives a batch lies on disk; a batch writes its changes only.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A count of the keys, for metrics only, would look each key up again before it is put.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
BYTES_PER_PARTITION = 1 << 27


def prepare(spark: SparkSession, shuffled_bytes: int = 0) -> SparkSession:
    """Apply the runtime settings to an existing session and return it.

    Adaptive execution merges small shuffle partitions but never adds any, so a
    shuffle starts with enough of them: two per core, or one per 128 MiB where the
    caller knows the largest shuffle. A number that the session's owner chose stays
    the lower bound. ``sized_for`` raises the number by the size of the inputs.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    chosen = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL_PARTITIONS, None) or 0))
    spark.conf.set(INITIAL_PARTITIONS, str(max(chosen, 2 * cores, shuffled_bytes // BYTES_PER_PARTITION)))
    # Folders are listed by a few tasks per core and not by one task each.
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * cores))
    return spark


def input_bytes(df: DataFrame) -> int:
    """The size of a frame's inputs as the optimizer estimates it; for files that of their listing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sized_for(df: DataFrame, size: int | None = None) -> DataFrame:
    """The same frame, after shuffles were set to start with one partition per 128 MiB of it.

    Texts are larger in a shuffle than in a compressed file; a merge of partitions that turn out too
    small costs little.
    """
    conf = df.sparkSession.conf
    needed = (input_bytes(df) if size is None else size) // BYTES_PER_PARTITION
    if needed > int(conf.get(INITIAL_PARTITIONS, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(INITIAL_PARTITIONS, str(needed))
    return df


def local_session(cores: str | int = "*", name: str = "runloom", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", settings.pop("driver_memory", "12g"))
        .config("spark.sql.shuffle.partitions", settings.pop("shuffle_partitions", "8"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="runloom-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder that the session names.

    A cluster must name a folder that all executors reach. Only a local master,
    as in tests, falls back to a temporary folder of this machine.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        root = _local_root(context.applicationId)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex[:12]}")


def _path(spark: SparkSession, path: str):
    """A path and its file system as Spark's own readers find them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    found, store = _path(spark, path)
    return store.exists(found)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    found, store = _path(spark, path)
    store.create(found, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it; nothing happens if it is not there."""
    found, store = _path(spark, path)
    store.delete(found, True)
