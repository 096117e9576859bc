"""Ranks and cyclic neighbours that stay bounded per task when one group is huge.

A window partitioned by the group alone would sort a third of a table in one task.
Both helpers cut a group into ordered buckets, work inside a bucket, and pass only
one row per bucket between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_fraction
from ..session import broadcast_if_small, materialize

RANGE_WIDTH = 1 << 16      # distinct order keys per rank bucket
CYCLE_BUCKET = 1_000_000   # rows of a group in one cycle bucket


def dense_index(df: DataFrame, group: str, order: str, out: str, total: str, width: int = RANGE_WIDTH) -> DataFrame:
    """0-based position of each row in its group by a unique integer order column, plus the group size.

    For keys that lie fairly close: each ``width`` of them is a bucket.  Sparse keys, such as
    hashes, make nearly as many buckets as rows; they take ``dense_index_by_range``.
    """
    bucketed = df.withColumn("_b", F.floor(F.col(order) / width).cast("bigint"))
    counts = bucketed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(group)
    before = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(by_group).alias(total),
    )
    inside = Window.partitionBy(group, "_b").orderBy(order)
    return (
        bucketed.join(offsets, [group, "_b"])
        .withColumn(out, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_b", "_off")
    )


def dense_index_by_range(df: DataFrame, group: str, order: str, out: str, total: str, ranges: int) -> DataFrame:
    """``dense_index`` for keys of any kind and spread: 64-bit hashes, texts, times.

    Rows are dealt to ``ranges`` stretches of (group, key) whose bounds Spark samples, so a
    group of any size spreads over as many stretches as its share asks for, however its keys
    lie.  Only the stretches' counts (at most groups + ranges rows) meet per group.  Repeated
    keys get neighbouring positions in no fixed order; null keys come first.
    """
    placed = materialize(df.repartitionByRange(ranges, group, order).withColumn("_b", F.spark_partition_id()))
    counts = placed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(group, "_g")
    by_group = Window.partitionBy("_g")
    before = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(by_group).alias(total))
    inside = Window.partitionBy(group, "_b").orderBy(order)
    numbered = placed.withColumn("_i", F.row_number().over(inside) - 1)
    joined = numbered.join(broadcast_if_small(offsets), F.col("_g").eqNullSafe(F.col(group)) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(out, (F.col("_off") + F.col("_i")).cast("bigint")).select(*df.columns, total, out)


def cycle_neighbours(
    df: DataFrame,
    group: list[str],
    order: str,
    tie: str,
    carry: list[str],
    bucket: Column | None = None,
    carry_prev: list[str] | None = None,
) -> DataFrame:
    """Next and previous row of each row on the cycle that orders a group by ``order, tie``.

    Adds ``next_<col>`` for every column of ``carry`` and ``prev_<col>`` for those of
    ``carry_prev`` (the same where not given).  Without ``bucket`` a group must be of
    bounded size (one page, one document).  For unbounded groups pass a bucket that never
    falls along the order; the group is then cut into buckets, lead/lag work inside a
    bucket, and a bucket's ends get one sentinel row each from the neighbouring buckets, so
    rows are shuffled once and never joined.
    """
    back = carry if carry_prev is None else carry_prev
    if bucket is None:
        inside = Window.partitionBy(*group).orderBy(order, tie)
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        steps = [("next", c, F.lead(F.struct(c)).over(inside), F.first(c).over(whole)) for c in carry]
        steps += [("prev", c, F.lag(F.struct(c)).over(inside), F.last(c).over(whole)) for c in back]
        return df.select(*df.columns, *[
            F.when(step.isNull(), edge).otherwise(step[c]).alias(f"{side}_{c}") for side, c, step, edge in steps
        ])

    rows = df.withColumn("_b", bucket)
    ends = rows.groupBy(*group, "_b").agg(
        F.min(F.struct(F.col(order).alias("_d"), F.col(tie).alias("_t"), F.struct(*carry).alias("_row"))).alias("_first"),
        F.max(F.struct(F.col(order).alias("_d"), F.col(tie).alias("_t"), F.struct(*back).alias("_row"))).alias("_last"),
    )
    along = Window.partitionBy(*group).orderBy("_b")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select(
        *group, "_b",
        F.coalesce(F.lag("_last").over(along), F.last("_last").over(whole)).alias("_before"),
        F.coalesce(F.lead("_first").over(along), F.first("_first").over(whole)).alias("_after"),
    )
    before = edges.select(*group, "_b", F.lit(0).alias("_s"), *[F.col(f"_before._row.{c}").alias(c) for c in back])
    after = edges.select(*group, "_b", F.lit(2).alias("_s"), *[F.col(f"_after._row.{c}").alias(c) for c in carry])
    inside = Window.partitionBy(*group, "_b").orderBy("_s", order, tie)
    both = rows.withColumn("_s", F.lit(1)).unionByName(before, allowMissingColumns=True).unionByName(after, allowMissingColumns=True)
    added = [F.lead(c).over(inside).alias(f"next_{c}") for c in carry] + [F.lag(c).over(inside).alias(f"prev_{c}") for c in back]
    return both.select(*df.columns, "_s", *added).filter(F.col("_s") == 1).drop("_s")


def digest_bucket(digest: str, buckets: int | Column) -> Column:
    """Bucket of a uniform hex digest; even whatever the group's size."""
    return F.floor(hash_fraction(F.col(digest)) * buckets).cast("bigint")


def hot_groups(df: DataFrame, group: str, rows_per_bucket: int = CYCLE_BUCKET) -> DataFrame:
    """(group, buckets) of the groups of more than ``rows_per_bucket`` rows; reads the group column alone."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket)
    return sizes.select(group, F.ceil(F.col("_n") / rows_per_bucket).cast("bigint").alias("buckets"))
