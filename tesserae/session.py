"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller already owns."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Where none is set, a session that runs in one process (tests, bench) gets a temporary
    folder that goes with it; on a cluster a folder of one machine would lose data, so
    that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scratch: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; ``clean`` removes it."""
    _scratch.append(f"{checkpoint_dir(spark).rstrip('/')}/tesserae-{uuid.uuid4().hex}")
    return _scratch[-1]


def clean(spark: SparkSession) -> int:
    """Remove what this process wrote to the shared folder, and return how many folders there were.

    For the end of a job, or between jobs of a long session: frames that were read back from
    these folders cannot be used afterwards.
    """
    removed = 0
    while _scratch:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        removed += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return removed


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends, columns still prune.

    For results that several aggregates read, where Spark would otherwise run the whole
    plan once per reader.  A lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    Its cleaner acts when the driver's JVM collects garbage, which between the rounds of a
    loop may not happen before their files have piled up.
    """
    gc.collect()
    spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """Hint a narrow table for broadcast only after counting that it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def local_session(cpus: int | str = 8, app: str = "tesserae") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    for name, value in RUNTIME_CONF.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
