"""Named queries with, where one statement can express them, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def widen(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, so that both engines show one schema."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    cols = [
        F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small)
        else F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.FloatType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return widen(fn(prepare(spark), folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def big(*names: str) -> str:
    """SQL select items cast to BIGINT under their own names."""
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


def r6(value, name: str):
    """Round to six decimals; adding zero turns -0.0 into 0.0."""
    return (F.round(value, 6) + F.lit(0.0)).alias(name)


def sql_r6(value: str, name: str) -> str:
    return f"(round({value}, 6) + 0.0)::DOUBLE AS {name}"
