"""Who stores whose backup: a keyed single cycle over the blocks of an owner.

``holder`` of block i is the block that stores i's backup; ``carries`` is the block
whose backup i stores.  Every owner has exactly one cycle.

Damage is contiguous, so a block and its holder are kept apart.  The raster order of an
owner's k blocks is cut into four strips of nearly equal size, and the cycle goes to and fro
between the first and the third, then between the fourth and the second, in keyed order
within each strip (for odd k the middle block joins the two halves).  Every edge then spans
at least k / 4 places of the raster order, which is a quarter of the rows or, where it is
fewer, as large a share of the columns: no partner is nearer than a quarter of the shorter
side.  Nothing is drawn and repaired, so no round is repeated and no page is too large.

The plain keyed cycle, in which neighbours may be partners, is kept for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hmac_hex
from ..sources.keyring import with_key
from .ordering import cycle_neighbours


def map_digest() -> Column:
    """Keyed position of a block; bound to geometry, owner and index but not to the channel."""
    message = F.expr(
        "concat(unhex(concat(lpad(hex(height), 4, '0'), lpad(hex(width), 4, '0'), lpad(hex(block), 4, '0'), lpad(hex(k), 8, '0'), "
        "lpad(hex(octet_length(owner_id)), 4, '0'))), encode(owner_id, 'UTF-8'), unhex(lpad(hex(idx), 8, '0')))"
    )
    return hmac_hex(F.col("map_in"), F.col("map_out"), message)


# Sizes of the four strips of k blocks, the even part of k first; an odd block out stands at raster place q0 + q1.
EVEN = "greatest(k - k % 2, 2)"
Q1 = f"((({EVEN} - 2) div 2) div 2)"
Q2 = f"(({EVEN} - 2) div 2 - {Q1})"
ODD_OUT = f"(k % 2 = 1 AND k > 1 AND idx = {Q2} + 1 + {Q1})"
SPOT = f"(idx - CASE WHEN k % 2 = 1 AND k > 1 AND idx > {Q2} + 1 + {Q1} THEN 1 ELSE 0 END)"
STRIP = (
    f"CASE WHEN {ODD_OUT} THEN 4 WHEN {SPOT} <= {Q2} THEN 0 WHEN {SPOT} <= {Q2} + {Q1} THEN 1 WHEN {SPOT} <= {Q2} + {Q1} + {Q2} THEN 2 ELSE 3 END"
)
# Beside the odd block out stand the first and the last block, the ones farthest from it.
TURN = "CASE WHEN k % 2 = 1 AND _strip = 0 AND idx = 0 THEN 1 WHEN k % 2 = 1 AND _strip = 3 AND idx = k - 1 THEN -1 ELSE 0 END"
PLACE = (
    f"CASE _strip WHEN 0 THEN 2 * _j WHEN 2 THEN 2 * _j + 1 WHEN 4 THEN 2 * {Q2} + 1 "
    f"ELSE 2 * {Q2} + 1 + CASE WHEN k > 1 THEN k % 2 ELSE 0 END + 2 * _j + CASE _strip WHEN 3 THEN 0 ELSE 1 END END"
)


def with_place(keyed: DataFrame, group: list[str]) -> DataFrame:
    """Add ``_place``, the position on the separated cycle, from ``_digest``; one shuffle by group serves what follows too."""
    inside = Window.partitionBy(*group, "_strip").orderBy("_turn", "_digest", "idx")
    placed = keyed.repartition(*group).withColumn("_strip", F.expr(STRIP)).withColumn("_turn", F.expr(TURN))
    return placed.withColumn("_j", F.row_number().over(inside) - 1).withColumn("_place", F.expr(PLACE).cast("bigint")).drop("_strip", "_turn", "_j")


def with_neighbours(blocks: DataFrame, ring: DataFrame, carry: list[str], group: list[str] | None = None,
                    pairs: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """Add next_/prev_ columns along the keyed cycle.  Owners are pages of bounded size.

    Partners are kept apart unless ``plain`` asks for the mere keyed order; with ``pairs``
    (owner_id, idx, holder, carries) the neighbours come from that map.  The map is defined
    on whole owners: where a block is missing or doubled no row of its group gets
    neighbours (``complete_blocks`` fills such groups up first).
    """
    keep, group = blocks.columns, group or ["owner_id", "ch"]
    if pairs is None:
        keyed = with_key(blocks, ring).withColumn("_digest", map_digest()).select(*keep, "_digest")
        if plain:
            return cycle_neighbours(keyed, group, "_digest", "idx", carry).drop("_digest")
        rows = with_place(keyed, group).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*group)))
        added = [f"{side}_{c}" for side in ("next", "prev") for c in carry]
        found = cycle_neighbours(rows, group, "_place", "idx", carry)
        return found.select(*keep, *[F.when(F.col("_rows") == F.col("k"), F.col(c)).alias(c) for c in added])
    out = blocks.join(pairs.select("owner_id", "idx", F.col("holder").alias("_next"), F.col("carries").alias("_prev")), ["owner_id", "idx"])
    for side in ("next", "prev"):
        other = blocks.select(*group, F.col("idx").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in carry])
        out = out.join(other, [*group, f"_{side}"])
    return out.select(*keep, *[f"{side}_{c}" for side in ("next", "prev") for c in carry])


def partner_map(blocks: DataFrame, ring: DataFrame, plain: bool = False) -> DataFrame:
    """(owner_id, idx, holder, carries, ...), one row per block, shared by all channels."""
    base = blocks.filter(F.col("ch") == 0).drop("px", "ch")
    out = with_neighbours(base, ring, ["idx"], ["owner_id"], plain=plain)
    return out.withColumnRenamed("next_idx", "holder").withColumnRenamed("prev_idx", "carries")


def centroid(idx: Column, ncols: Column, block: Column) -> tuple[Column, Column]:
    """(y, x) of a block's centre in pixels."""
    half = (block - 1) / 2
    return F.floor(idx / ncols) * block + half, (idx % ncols) * block + half


def squared_distance(a: Column, b: Column) -> Column:
    """Squared centre distance of two blocks of one grid, in pixels."""
    ncols, block = F.col("ncols"), F.col("block")
    dr = (F.floor(a / ncols) - F.floor(b / ncols)) * block
    dc = (a % ncols - b % ncols) * block
    return (dr * dr + dc * dc).cast("bigint")


def map_checks(pairs: DataFrame, d_min: Column | None = None) -> DataFrame:
    """Per owner: size, least and mean separation, edges shorter than the wanted distance."""
    wanted = d_min if d_min is not None else F.least(F.col("height"), F.col("width")) * 0.25
    d2 = squared_distance(F.col("idx"), F.col("holder"))
    return pairs.withColumn("d2", d2).withColumn("short", F.col("d2") < wanted * wanted).groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.countDistinct("holder").alias("n_holders"),
        F.sqrt(F.min("d2")).alias("min_sep"),
        F.avg(F.sqrt("d2")).alias("mean_sep"),
        F.count_if("short").alias("violations"),
    )


def quadrant(idx: Column) -> tuple[Column, Column]:
    nrows = F.col("k") / F.col("ncols")
    return F.floor(idx / F.col("ncols")) * 2 >= nrows, (idx % F.col("ncols")) * 2 >= F.col("ncols")


def map_leak(pairs: DataFrame) -> DataFrame:
    """Share of partners in the same and in the diagonal quadrant."""
    ay, ax = quadrant(F.col("idx"))
    by, bx = quadrant(F.col("holder"))
    return pairs.withColumn("same", (ay == by) & (ax == bx)).withColumn("diag", (ay != by) & (ax != bx)).groupBy(
        "owner_id"
    ).agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if("same").alias("same_quadrant"),
        F.count_if("diag").alias("diagonal_quadrant"),
        F.avg(F.col("same").cast("double")).alias("same_share"),
        F.avg(F.col("diag").cast("double")).alias("diagonal_share"),
    )
