"""Seal: back up every block in its partner and tag what each block physically carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays
from ..functions.backup import VARIANT_CODE, with_backup
from ..functions.hashing import hmac_hex
from ..functions.pixels import budget, psnr, squared_error
from ..sources.keyring import with_key
from .partner import with_neighbours
from .validate import require_valid

# Format marks of the bound and of the older, unbound tag message.
MARK_BOUND = b"WGT2"
MARK_UNBOUND = b"WGT1"


def variant_code(variant: str | Column) -> Column:
    """One byte naming the variant, given by name or by a column of names."""
    if isinstance(variant, str):
        return F.lit(bytes([VARIANT_CODE[variant]]))
    codes = [x for name, code in VARIANT_CODE.items() for x in (F.lit(name), F.lit(bytes([code])))]
    return F.element_at(F.create_map(*codes), variant)


def tag_message(variant: str | Column, block: int, px: Column, carried: Column | None) -> Column:
    """Everything a tag vouches for; ``carried=None`` is the unbound form, for audits only."""
    mark = MARK_BOUND if carried is not None else MARK_UNBOUND
    shape = F.expr(
        f"unhex(concat('{mark.hex()}', lpad(hex(height), 4, '0'), lpad(hex(width), 4, '0'), '{block:04x}', lpad(hex(ch), 2, '0')))"
    )
    owner = F.expr(
        "concat(unhex(concat(lpad(hex(idx), 8, '0'), lpad(hex(octet_length(owner_id)), 4, '0'))), encode(owner_id, 'UTF-8'))"
    )
    fields = [shape, variant_code(variant), owner, arrays.high_bytes(block)(px)]
    return F.concat(*fields, *([carried] if carried is not None else []))


def tag_hex(variant: str | Column, block: int, px: Column, carried: Column | None) -> Column:
    """Truncated keyed tag as lower-case hex; needs tag_in and tag_out on the row."""
    digest = hmac_hex(F.col("tag_in"), F.col("tag_out"), tag_message(variant, block, px, carried))
    return F.substring(digest, 1, budget(block)[1] // 4)


def seal(blocks: DataFrame, ring: DataFrame, variant: str, block: int = 8, bound: bool = True,
         extra: list[str] | None = None, pairs: DataFrame | None = None, plain: bool = False, strict: bool = False) -> DataFrame:
    """Blocks -> sealed blocks; ``extra`` names columns besides owner_id that tell copies apart.

    Adds holder, carries, desc (the block's own backup), carried (its partner's, which it
    stores), tag, and px_sealed with tag and carried backup in the two low bits.  The
    carry join is a lag along the cycle, so map and carry share one shuffle.  Partners are
    kept apart; ``plain`` takes the mere keyed order and ``pairs`` any map of the caller's
    (all readers of the blocks must be given the same).  Blocks of a key that the ring does
    not hold, and owners that lack a block, are left out; ``validate_blocks`` lists them,
    and ``strict`` raises for them and for any other reason it knows.
    """
    if strict:
        require_valid(blocks, variant, ring)
    keep = [c for c in blocks.columns]
    coded = with_backup(blocks, variant, block)
    placed = with_neighbours(coded, ring, ["idx", "desc"], (extra or []) + ["owner_id", "ch"], pairs, plain).filter("prev_idx IS NOT NULL")
    placed = placed.select(
        *keep, "desc", F.col("next_idx").alias("holder"), F.col("prev_idx").alias("carries"),
        F.col("prev_desc").alias("carried"),
    )
    tagged = with_key(placed, ring, known_only=True).withColumn(
        "tag", tag_hex(variant, block, F.col("px"), F.col("carried") if bound else None)
    )
    payload = F.concat(F.unhex("tag"), F.col("carried"))
    return tagged.withColumn("px_sealed", arrays.with_low_bytes(block)(F.col("px"), payload)).select(
        *keep, F.lit(variant).alias("variant"), "desc", "holder", "carries", "carried", "tag", "px_sealed"
    )


def as_received(sealed: DataFrame) -> DataFrame:
    """What travels: block identity and the sealed pixels under the name ``px``."""
    return sealed.drop("px", "desc", "holder", "carries", "carried", "tag").withColumnRenamed("px_sealed", "px")


def seal_summary(sealed: DataFrame) -> DataFrame:
    """Per owner and variant: blocks, fidelity, and proof that the upper planes are untouched."""
    touched = F.exists(
        F.zip_with("px", "px_sealed", lambda a, b: a.bitwiseAND(252) != b.bitwiseAND(252)), lambda x: x
    )
    return (
        sealed.withColumn("_sq", squared_error(F.col("px"), F.col("px_sealed")))
        .withColumn("_touched", touched)
        .groupBy("owner_id", "variant")
        .agg(
            F.count(F.lit(1)).alias("n_blocks"),
            F.sum("_sq").alias("sum_sq"),
            F.sum(F.size("px").cast("bigint")).alias("n_px"),
            F.count_if("_touched").alias("msb_changed"),
        )
        .withColumn("wm_psnr", psnr(F.col("sum_sq"), F.col("n_px")))
    )
