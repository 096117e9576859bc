"""Repair from partners, exact restore from an archive, and labelled imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.backup import decode

MARKER = 0


def marker(px: Column, block: int = 8) -> Column:
    """Pixels that say "lost"; also where the block itself is absent."""
    return F.coalesce(F.transform(px, lambda v: F.lit(MARKER)), F.array_repeat(F.lit(MARKER), block * block))


def repair(state: DataFrame, variant: str | list[str], block: int = 8) -> DataFrame:
    """Add px_repaired: decoded backup where recoverable, marker where not, otherwise as received.

    Decoded pixels have cleared low bits, so a repaired block never verifies as authentic.
    Rows that need no decoding hand NULL to the decoder.  With several variants the frame
    names each row's own in a column ``variant``.
    """
    df = state
    names = [variant] if isinstance(variant, str) else variant
    for v in names:
        mine = F.col("recoverable") & (F.lit(True) if len(names) == 1 else F.col("variant") == v)
        df = df.withColumn(f"_decoded_{v}", decode(F.when(mine, F.col("own_desc")), v, block))
    decoded = [f"_decoded_{v}" for v in names]
    return df.withColumn(
        "px_repaired",
        F.when(F.col("recoverable"), F.coalesce(*decoded))
        .when(F.col("unrecoverable"), marker(F.col("px"), block))
        .otherwise(F.col("px")),
    ).drop(*decoded)


def restore(received: DataFrame, mask: DataFrame, archive: DataFrame) -> DataFrame:
    """Flagged and absent blocks from the archive, the rest as received; ``differs`` marks any leftover difference.

    Every archived block comes back; those the received copy lacks count as flagged.
    """
    keys = ["owner_id", "ch", "idx"]
    flags = mask.select("owner_id", "idx", F.col("flagged").alias("_flag"))
    stored = archive.select(*keys, F.col("px").alias("px_archive"))
    flagged = F.col("px").isNull() | F.coalesce("_flag", F.lit(True))
    return (
        stored.join(received, keys, "left")
        .join(flags, ["owner_id", "idx"], "left")
        .withColumn("flagged", flagged)
        .drop("_flag")
        .withColumn("px_restored", F.when(F.col("flagged"), F.col("px_archive")).otherwise(F.col("px")))
        .withColumn("differs", F.col("px_restored") != F.col("px_archive"))
    )


def impute_unrecoverable(state: DataFrame) -> DataFrame:
    """Mean of intact neighbour blocks for unrecoverable ones, in a column no metric reads.

    Intact blocks send their pixel sum to unrecoverable neighbours' keys; one aggregation
    collects it.  The result is labelled filling, not recovered content.
    """
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda s, v: s + v)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    keys = ["owner_id", "ch", "ncols", "k"]
    own = F.struct(
        F.col("r").alias("r"), F.col("c").alias("c"), F.col("unrecoverable").alias("wanted"),
        F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("n"),
    )
    sent = [
        F.struct((F.col("r") + dy).alias("r"), (F.col("c") + dx).alias("c"), F.lit(False).alias("wanted"),
                 F.col("_t").alias("total"), F.size("px").cast("bigint").alias("n"))
        for dy, dx in steps
    ]
    rows = state.withColumn("_t", total).withColumn(
        "_m", F.explode(F.when(F.col("flagged"), F.array(own)).otherwise(F.array(own, *sent)))
    )
    inside = (
        (F.col("_m.r") >= 0) & (F.col("_m.c") >= 0) & (F.col("_m.c") < F.col("ncols"))
        & (F.col("_m.r") * F.col("ncols") < F.col("k"))
    )
    placed = rows.filter(inside).select(*keys, "_m.*")
    return (
        placed.groupBy(*keys, "r", "c")
        .agg(F.bool_or("wanted").alias("wanted"), F.sum("total").alias("total"), F.sum("n").alias("n"))
        .filter("wanted")
        .select(
            "owner_id", "ch",
            (F.col("r") * F.col("ncols") + F.col("c")).alias("idx"),
            F.col("n").alias("support_px"),
            F.when(F.col("n") > 0, F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("imputed_value"),
        )
    )
