"""Run tables as text files: typed reading of whatever known columns a file has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.grid import RUN_COLUMNS

TEXT = {"run_id", "condition", "dataset", "image_name", "image_id", "tamper_class", "tamper_ratio_nominal", "recovery_variant"}
WHOLE = {"width", "height", "channels", "block_size", "key_id", "seed"}
READ = {"header": True, "nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf"}


def column_type(name: str) -> str:
    return "string" if name in TEXT else "bigint" if name in WHOLE or name.startswith("n_") else "double"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run rows with all run columns, in order: those the file's header names are typed, the others null; unknown ones are left out.

    Literals ``nan``, ``inf`` and ``-inf`` are read as numbers.
    """
    header = spark.read.options(**READ).csv(path).columns          # names alone; nothing is inferred
    known = spark.read.options(**READ).schema(", ".join(f"`{c}` {column_type(c) if c in RUN_COLUMNS else 'string'}" for c in header)).csv(path)
    return known.select(*[F.col(c) if c in header else F.lit(None).cast(column_type(c)).alias(c) for c in RUN_COLUMNS])
