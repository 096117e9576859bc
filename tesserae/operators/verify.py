"""Verify: recompute tags over what is really there, localize, and explain each decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays
from ..functions.pixels import budget
from ..sources.keyring import with_key
from .partner import with_neighbours
from .seal import tag_hex

GRID = ["owner_id", "key_id", "height", "width", "block", "k", "ncols", "idx", "r", "c"]


def check_tags(received: DataFrame, ring: DataFrame, variant: str | Column, block: int = 8, bound: bool = True) -> DataFrame:
    """Row-local comparison: adds stored_tag, stored_desc, fresh_tag and mismatch.

    A block of an unknown key, without pixels or with a null field mismatches like any other
    that does not verify; no received row is lost.
    """
    n_tag = budget(block)[1] // 8
    keep = received.columns
    split = received.withColumn("_low", arrays.low_bytes(block)("px")).withColumn(
        "stored_tag", F.lower(F.hex(F.substring("_low", 1, n_tag)))
    ).withColumn("stored_desc", F.substring("_low", n_tag + 1, budget(block)[2] // 8))
    fresh = tag_hex(variant, block, F.col("px"), F.col("stored_desc") if bound else None)
    return (
        with_key(split, ring)
        .withColumn("fresh_tag", fresh)
        .withColumn("mismatch", ~F.coalesce(F.col("stored_tag") == F.col("fresh_tag"), F.lit(False)))
        .select(*keep, "stored_tag", "stored_desc", "fresh_tag", "mismatch")
    )


def raw_flags(checked: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Channel-OR of mismatches: one row per block."""
    return checked.groupBy(*(extra or []), *GRID).agg(F.bool_or("mismatch").alias("raw"))


# How many of the eight neighbours lie inside the grid: 3, 5 or 8 (fewer on thin grids).
VALID_NEIGHBOURS = """
    cast((least(r + 1, k div ncols - 1) - greatest(r - 1, 0) + 1) * (least(c + 1, ncols - 1) - greatest(c - 1, 0) + 1) - 1 AS bigint)
"""

# The block itself, and a vote for each neighbour if it is flagged.
OWN = "named_struct('r', r, 'c', c, 'raw', raw, 'vote', 0)"
VOTES = ", ".join(
    f"named_struct('r', r + {dy}, 'c', c + {dx}, 'raw', cast(null AS boolean), 'vote', 1)"
    for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx
)


def refine(flags: DataFrame, tau: int = 7, clear_isolated: bool = False, extra: list[str] | None = None) -> DataFrame:
    """Fill blocks whose neighbours are (nearly) all flagged, judged on the raw mask.

    Flagged blocks send a vote to each neighbour; one aggregation on the block key counts
    them, so the grid is never joined with itself.
    """
    keys = (extra or []) + GRID
    sent = flags.withColumn("_m", F.expr(f"explode(CASE WHEN raw THEN array({OWN}, {VOTES}) ELSE array({OWN}) END)"))
    placed = sent.filter("_m.r >= 0 AND _m.c >= 0 AND _m.c < ncols AND _m.r * ncols < k").selectExpr(
        *[c for c in keys if c not in ("idx", "r", "c")], "_m.r * ncols + _m.c AS idx", "_m.*"
    )
    counted = placed.groupBy(*keys).agg(F.expr("bool_or(raw) AS raw"), F.expr("sum(vote) AS s"))
    kept = "(raw AND s > 0)" if clear_isolated else "raw"
    return counted.selectExpr("*", f"{VALID_NEIGHBOURS} AS nvalid").selectExpr("*", f"ceil({tau}D * nvalid / 8) AS needed").selectExpr(
        "*", f"{kept} OR (NOT raw AND s >= needed) AS flagged"
    )


def localize(checked: DataFrame, refined: bool = True, tau: int = 7, clear_isolated: bool = False,
             extra: list[str] | None = None) -> DataFrame:
    """Block mask: raw and flagged per block."""
    flags = raw_flags(checked, extra)
    if not refined:
        return flags.withColumn("flagged", F.col("raw"))
    return refine(flags, tau, clear_isolated, extra).drop("s", "nvalid", "needed")


def owner_verdicts(mask: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """TAMPERED if any block is flagged; a rate above 0.9 suggests wrong parameters instead."""
    return (
        mask.groupBy(*(extra or []), "owner_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("flagged").alias("flagged"),
            F.count_if("raw").alias("raw_flagged"),
        )
        .withColumn("verifying", F.col("total") - F.col("flagged"))
        .withColumn("rate", F.col("flagged") / F.col("total"))
        .withColumn("raw_rate", F.col("raw_flagged") / F.col("total"))
        .withColumn("suspect_parameters", F.col("raw_rate") > 0.9)
        .withColumn("verdict", F.when(F.col("flagged") > 0, "TAMPERED").otherwise("AUTHENTIC"))
    )


def with_partner_state(checked: DataFrame, mask: DataFrame, ring: DataFrame, extra: list[str] | None = None,
                       pairs: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """Per block and channel: the mask, its holder's flag, and the block's own backup read from the holder.

    Mask and stored backups are columns of this frame, hence frozen before anything is
    repaired.  The owner join is a lead along the cycle.  In owners that lack a block
    nobody can tell the partners: all that is flagged there is unrecoverable.
    """
    extra = extra or []
    flags = mask.select(*extra, "owner_id", "idx", "raw", "flagged")
    joined = checked.join(flags, extra + ["owner_id", "idx"])
    out = with_neighbours(joined, ring, ["idx", "stored_desc", "flagged"], extra + ["owner_id", "ch"], pairs, plain)
    return (
        out.withColumnRenamed("next_idx", "holder")
        .withColumnRenamed("next_stored_desc", "own_desc")
        .withColumn("holder_flagged", F.coalesce("next_flagged", F.lit(True)))
        .drop("next_flagged", "prev_idx", "prev_stored_desc", "prev_flagged")
        .withColumn("recoverable", F.col("flagged") & ~F.col("holder_flagged"))
        .withColumn("unrecoverable", F.col("flagged") & F.col("holder_flagged"))
    )


def partner_state_of_mask(mask: DataFrame, ring: DataFrame, extra: list[str] | None = None,
                          pairs: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """The same from mask and map alone; no pixel column is read."""
    out = with_neighbours(mask, ring, ["idx", "flagged"], (extra or []) + ["owner_id"], pairs, plain)
    return (
        out.withColumnRenamed("next_idx", "holder").withColumn("holder_flagged", F.coalesce("next_flagged", F.lit(True)))
        .drop("next_flagged", "prev_idx", "prev_flagged")
        .withColumn("recoverable", F.col("flagged") & ~F.col("holder_flagged"))
        .withColumn("unrecoverable", F.col("flagged") & F.col("holder_flagged"))
    )


def recoverability(state: DataFrame, by: list[str]) -> DataFrame:
    """rho = 1 - |U|/|T|, 1.0 when nothing is flagged."""
    return (
        state.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.count_if("flagged").alias("tampered"),
            F.count_if("recoverable").alias("recovered"),
            F.count_if("unrecoverable").alias("unrecoverable"),
        )
        .withColumn(
            "rho",
            F.when(F.col("tampered") == 0, F.lit(1.0)).otherwise(
                1.0 - F.col("unrecoverable") / F.greatest(F.col("tampered"), F.lit(1))
            ),
        )
    )


def audit(state: DataFrame) -> DataFrame:
    """The evidence behind each decision.  A block counts as matched when its tags match in every channel."""
    decision = (
        F.when(F.col("flagged") & ~F.col("raw"), "FLAGGED_BY_REFINEMENT")
        .when(~F.col("flagged"), "AUTHENTIC")
        .when(F.col("holder_flagged"), "UNRECOVERABLE")
        .otherwise("RECOVERABLE")
    )
    reason = (
        F.when(F.col("flagged") & ~F.col("raw"), F.lit("all tags match; flagged by its neighbours, repair would overwrite authentic content"))
        .when(~F.col("flagged"), F.lit("stored and recomputed tags are equal"))
        .when(F.col("holder_flagged"), F.concat(F.lit("tag differs and block "), F.col("holder"), F.lit(", which holds the backup, is flagged too")))
        .otherwise(F.concat(F.lit("tag differs; backup read from intact block "), F.col("holder")))
    )
    return state.select(
        "owner_id", "ch", "idx", "stored_tag", "fresh_tag",
        (~F.col("mismatch")).alias("tag_matched"),
        "raw", "flagged", "holder", "holder_flagged",
        decision.alias("decision"), reason.alias("reason"),
    )


def expand_mask(mask: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Block mask -> pixel mask (owner_id, y, x, flagged); one narrow generator, no join."""
    side = F.col("block")
    return mask.withColumn("_p", F.explode(F.sequence(F.lit(0), (side * side - 1).cast("int")))).select(
        *(extra or []), "owner_id",
        (F.col("r") * side + F.floor(F.col("_p") / side)).cast("bigint").alias("y"),
        (F.col("c") * side + F.col("_p") % side).cast("bigint").alias("x"),
        "flagged",
    )
