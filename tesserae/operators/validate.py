"""What may be sealed: one validator for block tables, whoever made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.keyring import with_key

CHANNELS, SIDES, LEAST_BLOCKS = (1, 3), (4, 8), 3


def submission_reason(depth: Column, channels: Column, block: Column, variant: Column, k: Column) -> Column:
    """First rule a submission breaks, by its declared properties; null if none."""
    return (
        F.when(depth != 8, "depth").when(~channels.isin(*CHANNELS), "channels").when(~block.isin(*SIDES), "block")
        .when((variant == "C") & (block != 8), "variant").when(k < LEAST_BLOCKS, "too_small")
    )


def effective_variant(variant: Column, block: Column) -> Column:
    """Variant C exists for blocks of side 8; smaller ones fall back to A."""
    return F.when((variant == "C") & (block != 8), "A").otherwise(variant)


def validate_blocks(blocks: DataFrame, variant: str, ring: DataFrame | None = None) -> DataFrame:
    """(owner_id, reason, n) of owners that cannot be sealed as they are; the first rule that fails, and the rows that break it.

    The rules of ``submission_reason`` first, then what only the rows show: ``geometry`` (the
    declared sizes contradict each other or differ between rows), ``samples`` (not block x
    block values from 0 to 255), ``missing`` (cells without a row), ``repeated`` (cells with
    several), ``key`` (a key the ring does not hold).  One aggregation by owner, combined
    where the rows are read; an empty table has no rejects.
    """
    rows = blocks if ring is None else with_key(blocks, ring).select(*blocks.columns, F.col("tag_in").isNull().alias("_lost"))
    lost = F.col("_lost") if ring is not None else F.lit(False)
    side = F.col("block").cast("long")
    bad = F.coalesce((F.size("px") != side * side) | F.exists("px", lambda v: v.isNull() | (v < 0) | (v > 255)), F.lit(True))
    shape = F.struct("height", "width", "block", "k", "ncols")
    crooked = ~F.coalesce(
        (F.col("height") * F.col("width") == F.col("k") * side * side) & (F.col("width") == F.col("ncols") * side) & (F.col("idx") >= 0) & (F.col("idx") < F.col("k"))
        & (F.col("r") == F.floor(F.col("idx") / F.col("ncols"))) & (F.col("c") == F.col("idx") % F.col("ncols")), F.lit(False),
    )
    # cells in two steps, so that the distinct ones of a large owner are counted by many tasks
    cells = rows.groupBy("owner_id", "ch", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.min(shape).alias("low"), F.max(shape).alias("high"), F.count_if(crooked).alias("crooked"), F.count_if(bad).alias("bad"), F.count_if(lost).alias("lost"),
    )
    owners = cells.groupBy("owner_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("ch").alias("top"), F.min("ch").alias("bottom"), F.sum("crooked").alias("crooked"), F.sum("bad").alias("bad"),
        F.sum("lost").alias("lost"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("n") - 1).alias("more"),
    )
    channels, k = F.col("top") + 1, F.col("low.k")
    declared = submission_reason(F.lit(8), channels, F.col("low.block"), F.lit(variant), k)
    missing = k * channels - F.col("cells")
    skew = (F.col("low") != F.col("high")) | (F.col("bottom") < 0)
    reason = (
        F.when(declared.isNotNull(), declared).when(skew | (F.col("crooked") > 0), "geometry").when(F.col("bad") > 0, "samples")
        .when(missing != 0, "missing").when(F.col("more") > 0, "repeated").when(F.col("lost") > 0, "key")
    )
    count = (
        F.when(reason == "geometry", F.col("crooked")).when(reason == "samples", F.col("bad")).when(reason == "missing", missing)
        .when(reason == "repeated", F.col("more")).when(reason == "key", F.col("lost")).otherwise(F.col("n"))
    )
    return owners.select("owner_id", reason.alias("reason"), count.cast("long").alias("n")).filter("reason IS NOT NULL")


def require_valid(blocks: DataFrame, variant: str, ring: DataFrame | None = None) -> None:
    """Raise where any owner has a reason."""
    found = validate_blocks(blocks, variant, ring).limit(5).collect()
    if found:
        raise ValueError(f"owners that cannot be sealed: {[(r.owner_id, r.reason) for r in found]}")
