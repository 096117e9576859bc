"""A run table that failed, retried and doubled writers cannot harm.

Rows are staged in a part folder of their own; a commit then lists the part's run ids in a
log, of which readers see nothing before its job has ended.  Readers go by the log: a run
counts once, in the part that committed it first, and parts nobody committed do not exist.
Nothing is renamed, overwritten or locked, so writers need not know of each other.

    runs/part=<name>/...    staged rows
    log/part=<name>/...     (run_id, committed_us) of the part, written after its rows
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

LOG = "run_id string, committed_us bigint, part string"


def _whole(spark: SparkSession, path: str) -> list[str]:
    """Part folders below ``path`` whose writing job has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=*/_SUCCESS")
    found = mark.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(mark) or []
    return sorted(f.getPath().getParent().getName()[len("part="):] for f in found)


def _parts(spark: SparkSession, path: str, parts: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*[f"{path}/part={p}" for p in parts])


def log(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, committed_us, part): the commit that counts for each run; the earliest, of equally early ones the first part by name."""
    parts = _whole(spark, f"{path}/log")
    found = _parts(spark, f"{path}/log", parts, LOG) if parts else spark.createDataFrame([], LOG)
    return found.groupBy("run_id").agg(F.min(F.struct("committed_us", "part")).alias("_c")).select("run_id", "_c.committed_us", "_c.part")


def stage(runs: DataFrame, path: str, part: str | None = None) -> str:
    """Write rows to a part of their own and return its name; they stay invisible until ``commit``.

    A part is written once: staging under the name of an existing part is an error.
    """
    part = part or uuid.uuid4().hex
    runs.withColumn("timestamp_utc", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.parquet(f"{path}/runs/part={part}")
    return part


def commit(spark: SparkSession, path: str, part: str) -> int:
    """Log the part's runs that no part has committed yet, and return how many.

    Committing a part twice changes nothing; a part without new runs gets no entry.  Where
    two writers commit the same run at once, both entries stay and the earlier one counts.
    """
    if part not in _whole(spark, f"{path}/runs"):
        raise ValueError(f"part {part} was never staged, or not to its end")
    rows = _parts(spark, f"{path}/runs", [part]).select("run_id").distinct()
    fresh = rows.join(log(spark, path).select("run_id"), "run_id", "left_anti").select("run_id", F.lit(time.time_ns() // 1000).alias("committed_us"))
    if part in _whole(spark, f"{path}/log") or fresh.isEmpty():
        return 0
    fresh.write.mode("overwrite").parquet(f"{path}/log/part={part}")   # over what an attempt that died here left behind, which nobody could see
    return _parts(spark, f"{path}/log", [part], LOG).count()


def append(runs: DataFrame, path: str) -> int:
    """Stage and commit; returns how many runs were new."""
    return commit(runs.sparkSession, path, stage(runs, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The run table: each committed run once.  A part that holds a run twice gives one of its rows."""
    parts = _whole(spark, f"{path}/log")
    if not parts:
        raise ValueError(f"{path} holds no committed run")
    rows = _parts(spark, f"{path}/runs", parts).join(log(spark, path).select("run_id", "part"), ["run_id", "part"], "left_semi")
    first = Window.partitionBy("run_id").orderBy(F.xxhash64(*[c for c in rows.columns if c != "part"]))
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "part")


def resume(plan: DataFrame, path: str) -> DataFrame:
    """Cells of the plan that no commit lists; reads the log alone, not the runs."""
    return plan.join(log(plan.sparkSession, path).select("run_id"), "run_id", "left_anti")
