"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserae import session
from tesserae.session import broadcast_if_small, checkpoint_dir, materialize, tidy

__all__ = ["broadcast_if_small", "checkpoint_dir", "claim", "cut", "drop", "fold_of", "free_name", "materialize", "pieces", "prepare", "release", "tidy"]

#: Rows handed to Python at once: texts may be very long, and workers share an executor's memory with it.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """The library's runtime settings, and small batches for whole texts."""
    session.prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def free_name(df: DataFrame, base: str = "v") -> str:
    """A column name that ``df`` does not hold, so that helper columns never clash with the caller's."""
    return f"_{base}_{uuid.uuid4().hex[:8]}"


def fold_of(column: Column, folds: int = 5) -> Column:
    """Fold of a row: crc32 of the identifier's text, modulo ``folds``."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs a re-read."""
    return materialize(df)


def drop(df: DataFrame) -> None:
    """Remove the folder behind a frame that ``cut`` gave, once nothing that is still to run reads it."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/tesserae-" in path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release() -> None:
    """Give freed memory back to the machine; Python workers live on through all stages of a job and keep it otherwise."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library: nothing to give back
        pass


#: What a worker may forget between stages: a function for each cache, by the operator that fills it.
forgetting: dict[str, Callable[[], None]] = {}
_busy = [""]


def claim(operator: str) -> None:
    """Say which operator a worker's task belongs to; the first of a new operator drops what the others remembered."""
    if _busy[0] != operator:
        for name, forget in forgetting.items():
            if name != operator:
                forget()
        _busy[0] = operator
        release()


def pieces(sizes, limit: int):
    """Slices over consecutive items whose sizes sum to about ``limit``: bounded work on any batch."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
