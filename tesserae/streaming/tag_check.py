"""The row-local tag comparison on a streaming frame of sealed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.records import check_records

SEALED = (
    "owner_id string, key_id int, rec_key string, content binary, holder string, backup binary, backup_of string, tag string, "
    "ts timestamp"
)


def read_sealed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SEALED).parquet(folder)


def flag_rates(stream: DataFrame, ring: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Checked and flagged records per event-time window; the keyring is a static side."""
    checked = check_records(stream, ring).withWatermark("ts", delay)
    return checked.groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged")
    )
