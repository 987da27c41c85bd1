"""Spark session helpers.

On a cluster the session comes from the launcher; ``local_session`` exists
for tests and the benchmark. ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session and only invents a local folder when the master is local.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (timestamps compare with the
# oracle), AQE for runtime coalescing / skew-join splitting.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "squadron") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("SQUADRON_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a fresh scratch folder;
    a cluster session must name a shared folder itself.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="squadron-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def stage_table(df, name: str = "stage"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: one computation, lineage cut, and exact size statistics for the
    plans that read it.  Survives executor loss like any written table."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers_lock = threading.Lock()
_writers: dict[int, tuple[int, str | None]] = {}


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the queries in the block when each
    ends, as only the table they write is read again.  The session's own setting
    is restored when the last of several concurrent blocks ends."""
    with _writers_lock:
        count, own = _writers.get(id(spark)) or (0, spark.conf.get(_SHUFFLE_CLEANUP, None))
        _writers[id(spark)] = count + 1, own
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _writers_lock:
            count, own = _writers.pop(id(spark))
            if count > 1:
                _writers[id(spark)] = count - 1, own
            elif own is None:
                spark.conf.unset(_SHUFFLE_CLEANUP)
            else:
                spark.conf.set(_SHUFFLE_CLEANUP, own)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Let the folder's file system remove it when the driver ends."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def scale_conf(executors: int, cores_per_executor: int, input_bytes: int) -> dict[str, str]:
    """Settings for a cluster run, derived from its size.

    Shuffle partitions start at ~128 MB of input per partition, between three
    and ten waves of the cluster's cores (more would cost map tasks times
    reducers in blocks and map statuses on the driver), and AQE coalesces them
    at run time toward the same advisory size.  Skewed join
    partitions (5x the median and over 256 MB) are split by AQE.  Explicit
    broadcasts in this library are for fixed-size dimensions only; the
    automatic threshold stays at Spark's size check.
    """
    cores = executors * cores_per_executor
    target = 128 << 20
    partitions = min(max(3 * cores, -(-input_bytes // target)), 10 * cores)
    return {
        **CORE_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    }
