"""Labelled damage: truth is the intended region, fixed before a byte is written.

Region geometry and fill bytes come from hashes of the owner and a base seed, so every
executor derives the same damage without a shared random stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays
from ..functions.hashing import derive_seed, uniform, utf8
from ..functions.pixels import let
from ..session import broadcast_if_small

BASE_SEED = "20260811"


def pixel_yx(p: Column) -> tuple[Column, Column]:
    side = F.col("block")
    return F.col("r") * side + F.floor(p / side), F.col("c") * side + p % side


def positions() -> Column:
    return F.sequence(F.lit(0), (F.col("block") * F.col("block") - 1).cast("int"))


def with_seed(blocks: DataFrame, cls: Column, ratio: Column, base: str = BASE_SEED) -> DataFrame:
    """Seed of one damage case; ``ratio`` is its text form, such as '0.25'."""
    return blocks.withColumn("seed", derive_seed(F.lit(base), F.col("stem"), cls, ratio))


def with_rectangle(blocks: DataFrame, ratio: Column) -> DataFrame:
    """Random rectangle of a given area share, aspect log-uniform in [1/2, 2], clamped, not grid-aligned."""
    df = blocks.withColumn("_area", ratio.cast("double") * F.col("height") * F.col("width"))
    for name in ("aspect", "y", "x"):
        df = df.withColumn(f"_{name}", uniform(F.col("seed"), name))
    sized = df.selectExpr(
        *blocks.columns, "_y", "_x",
        "greatest(1, least(height, cast(rint(sqrt(_area / power(2.0D, _aspect * 2.0D - 1.0D))) AS bigint))) AS _rh",
        "greatest(1, least(width, cast(rint(sqrt(_area * power(2.0D, _aspect * 2.0D - 1.0D))) AS bigint))) AS _rw",
    )
    return sized.selectExpr(
        *blocks.columns, "cast(floor(_y * (height - _rh + 1)) AS bigint) AS y0", "cast(floor(_x * (width - _rw + 1)) AS bigint) AS x0",
        "_rh", "_rw",
    ).selectExpr(*blocks.columns, "y0", "x0", "y0 + _rh AS y1", "x0 + _rw AS x1")


def with_preset(blocks: DataFrame, kind: Column, ratio: Column) -> DataFrame:
    """Corner or centred square of a given area share, clipped to the picture, at least one pixel."""
    h, w = F.col("height"), F.col("width")
    size = F.greatest(F.lit(1), F.rint(F.sqrt(ratio.cast("double") * h * w)).cast("bigint"))
    size = F.least(size, h, w)
    corner = kind == "corner"
    mid = lambda n: F.greatest(F.lit(0), F.floor(n / 2) - F.floor(size / 2))
    y0 = F.when(corner, F.lit(0)).otherwise(mid(h)).cast("bigint")
    x0 = F.when(corner, F.lit(0)).otherwise(mid(w)).cast("bigint")
    return (
        blocks.withColumn("y0", y0).withColumn("x0", x0)
        .withColumn("y1", F.least(h, F.col("y0") + size)).withColumn("x1", F.least(w, F.col("x0") + size))
    )


def rectangle_truth(df: DataFrame) -> DataFrame:
    return df.withColumn("truth_px", arrays.inside_rectangle("r", "c", "block", "y0", "x0", "y1", "x1"))


def noise_bytes() -> Column:
    """Fresh bytes of a block: two digests of (seed, owner, channel, index)."""
    base = F.concat_ws("|", F.col("seed").cast("string"), "owner_id", F.col("ch").cast("string"), F.col("idx").cast("string"))
    digest = lambda n: F.sha2(utf8(F.concat(base, F.lit(f"|{n}"))), 256)
    return arrays.leading_bytes(F.unhex(F.concat(digest(0), digest(1))), F.col("block"))


def write_inside(df: DataFrame, fill: Column) -> DataFrame:
    """Replace pixels where truth_px holds; px_before keeps the former ones."""
    return (
        df.withColumn("_fill", fill).withColumn("_mixed", arrays.mixed("px", "_fill", "truth_px", "block"))
        .withColumn("px_before", F.col("px")).withColumn("px", F.col("_mixed")).drop("_mixed", "_fill")
    )


def inject_noise(blocks: DataFrame, ratio: Column, cls: str = "noise", base: str = BASE_SEED) -> DataFrame:
    df = rectangle_truth(with_rectangle(with_seed(blocks, F.lit(cls), ratio, base), ratio))
    return write_inside(df, noise_bytes())


def inject_solid(blocks: DataFrame, ratio: Column, base: str = BASE_SEED) -> DataFrame:
    df = rectangle_truth(with_rectangle(with_seed(blocks, F.lit("solid"), ratio, base), ratio))
    return write_inside(df, F.transform("px", lambda v: F.lit(0)))


def inject_preset(blocks: DataFrame, kind: str, ratio: Column, base: str = BASE_SEED) -> DataFrame:
    df = rectangle_truth(with_preset(with_seed(blocks, F.lit(kind), ratio, base), F.lit(kind), ratio))
    return write_inside(df, noise_bytes())


def truth_blocks(damaged: DataFrame, rule: str = "any") -> DataFrame:
    """Pixel truth -> block truth, by any pixel or by majority; all channels share one truth."""
    share = F.size(F.filter("truth_px", lambda t: t)) / F.size("truth_px")
    return damaged.withColumn("truth", share > 0 if rule == "any" else share >= 0.5)


# -- splice ------------------------------------------------------------------

def splice_sources(blocks: DataFrame) -> DataFrame:
    """(owner_id, source_id): the next owner of equal shape, wrapping; NULL if there is none.

    Owners of one shape may be many, so the cycle is cut into buckets of pages.
    """
    from .ordering import cycle_neighbours

    owners = blocks.filter((F.col("idx") == 0) & (F.col("ch") == 0)).select(
        "owner_id", "stem", "label", "page", "height", "width"
    )
    bucket = F.struct(F.col("label").alias("l"), F.floor(F.col("page") / 4096).alias("p"))
    out = cycle_neighbours(owners, ["height", "width"], "label", "page", ["owner_id"], bucket)
    return out.select(
        "owner_id", "stem", "height", "width",
        F.when(F.col("next_owner_id") != F.col("owner_id"), F.col("next_owner_id")).alias("source_id"),
    )


def inject_splice(blocks: DataFrame, sources: DataFrame, donors: DataFrame, ratio: Column,
                  keys: list[str] | None = None, same: list[str] | None = None, base: str = BASE_SEED) -> DataFrame:
    """The same rectangle from another owner; without one, the rectangle mirrored through the centre.

    ``donors`` holds (owner_id, *same, ch, idx, px).  Each damaged block asks for the one
    (aligned) or at most four (mirrored) donor blocks under it, by an equi-join.
    """
    keys, same = keys or ["owner_id"], same or []
    df = rectangle_truth(with_rectangle(with_seed(blocks, F.lit("splice"), ratio, base), ratio))
    df = df.join(sources.select("owner_id", "source_id"), "owner_id", "left")
    mirrored = F.col("source_id").isNull()
    dy = F.when(mirrored, F.col("height") - F.col("y1") - F.col("y0")).otherwise(F.lit(0))
    dx = F.when(mirrored, F.col("width") - F.col("x1") - F.col("x0")).otherwise(F.lit(0))
    df = df.withColumn("_dy", dy).withColumn("_dx", dx)
    place = ["r", "c", "block", "ncols", "_dy", "_dx", "truth_px"]
    asks = (
        df.filter(F.array_contains("truth_px", True))
        .withColumn("_under", arrays.blocks_under(*place))
        .select(
            *keys, *[c for c in same if c not in keys], "ch", "idx", *place,
            F.coalesce("source_id", "owner_id").alias("_from"), F.explode("_under").alias("_sidx"),
        )
    )
    give = donors.select(
        F.col("owner_id").alias("_from"), *same, "ch", F.col("idx").alias("_sidx"), F.col("px").alias("_spx")
    )
    got = asks.join(give, ["_from", *same, "ch", "_sidx"]).withColumn("_part", arrays.taken_from(*place, "_sidx", "_spx"))
    parts = got.groupBy(*keys, "ch", "idx").agg(F.flatten(F.collect_list("_part")).alias("_fill"))
    out = df.join(parts.select(*keys, "ch", "idx", "_fill"), [*keys, "ch", "idx"], "left")
    out = out.withColumn("px_before", F.col("px")).withColumn("px", arrays.overlaid("px", "_fill", "block"))
    return out.drop("_dy", "_dx", "_fill", "source_id")


# -- refill ------------------------------------------------------------------

RING = 5


def inject_refill(blocks: DataFrame, ratio: Column, keys: list[str] | None = None, base: str = BASE_SEED) -> DataFrame:
    """Synthetic filling whose mean and spread match a five-pixel ring outside the rectangle.

    Ring and filling sums are exact integers from one aggregation per owner and channel.
    """
    keys = keys or ["owner_id"]
    df = rectangle_truth(with_rectangle(with_seed(blocks, F.lit("crop_refill"), ratio, base), ratio))
    df = df.withColumn("_field", noise_bytes())
    sums = arrays.ring_sums(RING)("px", "_field", "r", "c", "block", "y0", "x0", "y1", "x1")
    names = [f"_{part}{of}" for part in "rwp" for of in "nsq"]
    stats = df.select(*keys, "ch", sums.alias("_sums")).groupBy(*keys, "ch").agg(
        *[F.sum(F.element_at("_sums", n + 1)).alias(name) for n, name in enumerate(names)]
    )
    pick = lambda s: F.when(F.col("_rn") > 0, F.col(f"_r{s}")).otherwise(F.col(f"_w{s}"))
    spread = lambda n, s, q: F.sqrt((n * q - s * s).cast("double")) / F.greatest(n, F.lit(1))
    stats = stats.select(
        *keys, "ch",
        (pick("s") / pick("n")).alias("_bm"), spread(pick("n"), pick("s"), pick("q")).alias("_bs"),
        (F.col("_ps") / F.greatest("_pn", F.lit(1))).alias("_pm"), spread(F.col("_pn"), F.col("_ps"), F.col("_pq")).alias("_pd"),
    ).withColumn("_pd", F.when(F.col("_pd") > 1e-6, F.col("_pd")).otherwise(F.lit(1.0)))
    df = df.join(stats, [*keys, "ch"])
    fill = arrays.matched("_field", "block", "_pm", "_pd", "_bm", "_bs")
    return write_inside(df, fill).drop("_field", "_bm", "_bs", "_pm", "_pd")


# -- blob --------------------------------------------------------------------

def _circles() -> Column:
    """Three to six discs around a common centre: array<struct<angle, frac>>."""
    draw = lambda name, i: uniform(F.col("seed"), f"{name}{i}")
    discs = F.array(*[
        F.struct((draw("angle", i) * 6.283185307179586).alias("angle"), (draw("frac", i) * 0.8).alias("frac"))
        for i in range(6)
    ])
    count = (F.floor(uniform(F.col("seed"), "discs") * 4) + 3).cast("int")
    return F.slice(discs, F.lit(1), count)


def _with_discs(df: DataFrame) -> DataFrame:
    """Disc centres and radius in whole pixels for the current radius."""
    r = F.col("_radius")
    return df.withColumn("_ri", F.greatest(F.lit(1), F.rint(r).cast("bigint"))).withColumn(
        "_discs",
        F.transform("_circles", lambda d: F.struct(
            F.rint(F.col("_cy") + F.sin(d["angle"]) * d["frac"] * r).cast("bigint").alias("y"),
            F.rint(F.col("_cx") + F.cos(d["angle"]) * d["frac"] * r).cast("bigint").alias("x"),
        )),
    )


def blob_discs(blocks: DataFrame, ratio: Column, keys: list[str] | None = None, base: str = BASE_SEED) -> DataFrame:
    """Per owner: discs after three measure-and-rescale rounds.  Reads one row of geometry an owner; nothing is shuffled between rounds."""
    keys = keys or ["owner_id"]
    owners = blocks.filter((F.col("idx") == 0) & (F.col("ch") == 0))
    owners = with_seed(owners, F.lit("inpaint_removal"), ratio, base).select(
        *keys, "height", "width", "block", "k", "ncols", "seed", ratio.cast("double").alias("_share")
    )
    owners = (
        owners.withColumn("_circles", _circles())
        .withColumn("_cy", (uniform(F.col("seed"), "cy") * 0.5 + 0.25) * F.col("height"))
        .withColumn("_cx", (uniform(F.col("seed"), "cx") * 0.5 + 0.25) * F.col("width"))
        .withColumn("_radius", F.sqrt(F.col("_share") * F.col("height") * F.col("width") / (F.size("_circles") * 3.141592653589793)))
    )
    owners = owners.repartition(owners.sparkSession.sparkContext.defaultParallelism, *keys)
    rows = F.floor(F.col("k") / F.col("ncols")) * F.col("block")
    for _ in range(3):
        owners = _with_discs(owners).withColumn("_area", arrays.discs_area("_discs", "_ri", rows, F.col("ncols") * F.col("block")))
        got = F.col("_area") / (F.col("height") * F.col("width"))
        grow = F.when(got <= 1e-9, F.lit(2.0)).otherwise(F.sqrt(F.col("_share") / F.greatest(got, F.lit(1e-9))))
        owners = owners.withColumn("_radius", F.col("_radius") * grow).drop("_area", "_discs", "_ri")
    return _with_discs(owners).select(*keys, "seed", "_discs", "_ri")


def inject_blob(blocks: DataFrame, ratio: Column, keys: list[str] | None = None, base: str = BASE_SEED,
                geometry: DataFrame | None = None) -> DataFrame:
    """Removal of a union of discs, filled along pixel rows between the nearest kept pixels.

    Each block publishes the outermost kept pixel of each of its rows; a window along the
    block row hands them on, so pixels are never exploded and a partition is one block row.
    ``geometry`` may name a cheaper frame with the same keys to place the discs from.
    """
    from pyspark.sql import Window

    keys = keys or ["owner_id"]
    df = blocks.join(blob_discs(geometry if geometry is not None else blocks, ratio, keys, base), keys).withColumn("truth_px", arrays.inside_discs("r", "c", "block", "_discs", "_ri"))
    df = df.withColumn("_kept", arrays.outermost_kept("px", "truth_px", "c", "block"))
    row = Window.partitionBy(*keys, "ch", "r").orderBy("c")
    before, after = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(1, Window.unboundedFollowing)
    end = lambda i: F.when(F.element_at("_kept", i) >= 0, F.element_at("_kept", i))
    rows, none = arrays.ROWS, F.lit(-1).cast("bigint")
    df = df.select("*", *[end(i + 1).alias(f"_e{i}") for i in range(2 * rows)])
    df = df.select(
        "*",
        F.array(*[F.coalesce(F.last(f"_e{rows + i}", ignorenulls=True).over(before), none) for i in range(rows)]).alias("_left"),
        F.array(*[F.coalesce(F.first(f"_e{i}", ignorenulls=True).over(after), none) for i in range(rows)]).alias("_right"),
    )
    out = df.withColumn("px_before", F.col("px")).withColumn("px", arrays.filled_along("px", "truth_px", "c", "block", "_left", "_right"))
    return out.drop("_kept", "_left", "_right", "_discs", "_ri", *[f"_e{i}" for i in range(2 * rows)])


# -- scattered patches, single bits, whole blocks ----------------------------

def inject_scatter(blocks: DataFrame, ratio: Column, base: str = BASE_SEED) -> DataFrame:
    """Block-sized noise patches at hashed pixel origins, as many as the area share needs.

    A patch overlaps at most four blocks; it is sent to those by key.
    """
    df = with_seed(blocks, F.lit("scatter"), ratio, base)
    side = F.col("block")
    count = F.ceil(ratio.cast("double") * F.col("height") * F.col("width") / (side * side)).cast("bigint")
    owners = df.filter((F.col("idx") == 0) & (F.col("ch") == 0)).select(
        "owner_id", "height", "width", "block", "ncols", "seed", F.explode(F.sequence(F.lit(1).cast("bigint"), count)).alias("_i")
    )
    from ..functions.hashing import hash_fraction

    at = lambda axis, limit: F.floor(hash_fraction(F.sha2(utf8(F.concat_ws(
        "|", F.col("seed").cast("string"), F.lit(axis), F.col("_i").cast("string"))), 256)) * (limit - side + 1)).cast("bigint")
    patches = owners.withColumn("py", at("py", F.col("height"))).withColumn("px0", at("px", F.col("width")))
    corner = lambda oy, ox: (
        F.floor((F.col("py") + oy * (side - 1)) / side) * F.col("ncols") + F.floor((F.col("px0") + ox * (side - 1)) / side)
    ).cast("bigint")
    touched = F.array_distinct(F.array(*[corner(oy, ox) for oy in (0, 1) for ox in (0, 1)]))
    hits = (
        patches.select("owner_id", "py", "px0", F.explode(touched).alias("idx"))
        .groupBy("owner_id", "idx").agg(F.collect_set(F.struct("py", "px0")).alias("_patches"))
    )
    df = df.join(hits, ["owner_id", "idx"], "left")

    def inside(p):
        y, x = pixel_yx(p)
        return F.coalesce(
            F.exists("_patches", lambda o: (y >= o["py"]) & (y < o["py"] + side) & (x >= o["px0"]) & (x < o["px0"] + side)),
            F.lit(False),
        )

    df = df.withColumn("truth_px", F.transform(positions(), inside)).drop("_patches")
    return write_inside(df, noise_bytes())


def inject_bitflip(blocks: DataFrame, share: float = 0.2, base: str = BASE_SEED) -> DataFrame:
    """Flip bit 4 of one centre pixel in mutually isolated blocks.

    A block is chosen when its digest is below the share and the least among its
    neighbours' digests; those are computed, not joined.
    """
    df = with_seed(blocks, F.lit("bitflip"), F.lit(str(share)), base)
    digest = lambda idx: F.sha2(utf8(F.concat_ws("|", F.col("seed").cast("string"), idx.cast("string"))), 256)
    nrows = F.col("k") / F.col("ncols")
    others = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                y, x = F.col("r") + dy, F.col("c") + dx
                ok = (y >= 0) & (y < nrows) & (x >= 0) & (x < F.col("ncols"))
                others.append(F.when(ok, digest(y * F.col("ncols") + x)))
    from ..functions.hashing import hash_fraction

    mine = digest(F.col("idx"))
    chosen = (hash_fraction(mine) < share) & F.coalesce(mine < F.least(*others), F.lit(True))
    centre = (F.col("block") / 2 * F.col("block") + F.col("block") / 2).cast("int")
    df = df.withColumn("_hit", chosen & (F.col("ch") == 0))
    df = df.withColumn("truth_px", let(F.col("_hit"), lambda h: F.transform(positions(), lambda p: h & (p == centre))))
    return write_inside(df, F.transform("px", lambda v: v.bitwiseXOR(4))).drop("_hit")


def centre_block() -> Column:
    nrows = F.floor(F.col("k") / F.col("ncols"))
    return (F.floor(nrows / 2) * F.col("ncols") + F.floor(F.col("ncols") / 2)).cast("bigint")


def nearest_block(blocks: DataFrame) -> DataFrame:
    """(owner_id, dst, src, diff): the block whose pixel sum is closest to the centre block's, itself excluded."""
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda s, v: s + v)
    sums = blocks.filter(F.col("ch") == 0).select("owner_id", "idx", centre_block().alias("dst"), total.alias("total"))
    target = sums.filter(F.col("idx") == F.col("dst")).select("owner_id", F.col("total").alias("wanted"))
    gap = F.abs(F.col("total") - F.col("wanted"))
    best = F.min(F.struct(gap.alias("diff"), F.col("idx").alias("src")))
    return (
        sums.filter(F.col("idx") != F.col("dst")).join(target, "owner_id")
        .groupBy("owner_id", "dst").agg(best.alias("b")).select("owner_id", "dst", "b.src", "b.diff")
    )


def nearest_other(blocks: DataFrame) -> DataFrame:
    """(owner_id, dst, src, diff) for every block: the other block of its owner whose pixel sum is closest, ties to the smaller index.

    A block's nearest sum is its own, if another block has it, or one of the two beside it
    in order.  An owner has at most 255 x pixels + 1 different sums, so the ordered pass
    sees a bounded number of rows, and no block meets all others.  Blocks alone in their
    owner have no row.
    """
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda s, v: s + v)
    sums = blocks.filter(F.col("ch") == 0).select("owner_id", "idx", total.alias("total"))
    equal = Window.partitionBy("owner_id", "total")
    first = F.min("idx").over(equal)
    twins = sums.withColumn("twin", F.when(F.col("idx") > first, first).otherwise(F.lead("idx").over(equal.orderBy("idx"))))
    along = Window.partitionBy("owner_id").orderBy("total")
    steps = sums.groupBy("owner_id", "total").agg(F.min("idx").alias("first"))
    side = lambda fn: F.when(fn("total").over(along).isNotNull(), F.struct(F.abs(fn("total").over(along) - F.col("total")).alias("diff"), fn("first").over(along).alias("src")))
    beside = steps.select("owner_id", "total", F.least(side(F.lag), side(F.lead)).alias("b"))
    found = twins.join(beside, ["owner_id", "total"]).select(
        "owner_id", F.col("idx").alias("dst"), F.coalesce("twin", "b.src").alias("src"), F.when(F.col("twin").isNotNull(), 0).otherwise(F.col("b.diff")).cast("bigint").alias("diff")
    )
    return found.filter("src IS NOT NULL")


TILE = 8   # blocks along a side of a tile


def regions_cover(blocks: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """(owner_id, idx, n_regions, mask) of every block that a region touches; any number of regions an owner.

    ``regions`` is (owner_id, y0, x0, y1, x1) in pixels, ends excluded; empty ones touch
    nothing.  Regions are dealt to the tiles (squares of blocks) they touch and meet the
    blocks of those tiles by an equi-join, so a region is compared with blocks near it, not
    with all of its owner.  ``mask`` has a bit for each pixel, raster order, lowest first,
    inside any region; masks are or-ed on the map side, so a block under all regions of a
    hot owner costs one row a task.
    """
    grid = blocks.filter(F.col("ch") == 0).select("owner_id", "idx", "r", "c", "block", F.floor(F.col("r") / tile).alias("_ty"), F.floor(F.col("c") / tile).alias("_tx"))
    side = grid.groupBy("owner_id").agg(F.max("block").alias("_side"), F.max("_ty").alias("_my"), F.max("_tx").alias("_mx"))
    span = F.col("_side") * tile
    near = lambda a, b, top: F.sequence(F.greatest(F.floor(F.col(a) / span), F.lit(0)), F.least(F.floor((F.col(b) - 1) / span), F.col(top)))
    whole = regions.select("owner_id", "y0", "x0", "y1", "x1").filter("y1 > y0 AND x1 > x0 AND y1 > 0 AND x1 > 0").join(broadcast_if_small(side), "owner_id")
    whole = whole.filter((F.col("y0") < (F.col("_my") + 1) * span) & (F.col("x0") < (F.col("_mx") + 1) * span))
    dealt = whole.withColumn("_ty", F.explode(near("y0", "y1", "_my"))).withColumn("_tx", F.explode(near("x0", "x1", "_mx")))
    low = lambda edge, at: F.greatest(F.col(edge) - F.col(at) * F.col("block"), F.lit(0))
    high = lambda edge, at: F.least(F.col(edge) - F.col(at) * F.col("block"), F.col("block"))
    met = grid.join(dealt, ["owner_id", "_ty", "_tx"]).select(
        "owner_id", "idx", "block", low("y0", "r").cast("int").alias("_a"), high("y1", "r").cast("int").alias("_b"), low("x0", "c").cast("int").alias("_l"), high("x1", "c").cast("int").alias("_h"),
    ).filter("_b > _a AND _h > _l")
    row = "shiftleft(shiftleft(1L, _h - _l) - 1L, _l)"
    bits = F.expr(f"aggregate(sequence(_a, _b - 1), 0L, (m, y) -> m | shiftleft({row}, block * y))")
    return met.withColumn("_bits", bits).groupBy("owner_id", "idx").agg(F.count(F.lit(1)).alias("n_regions"), F.bit_or("_bits").alias("mask"))


def transplant(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """Copy whole sealed blocks inside their owner; ``moves`` is (owner_id, dst, src)."""
    taken = blocks.join(moves.select("owner_id", "dst", F.col("src").alias("idx")), ["owner_id", "idx"]).select(
        "owner_id", F.col("dst").alias("idx"), "ch", F.col("px").alias("_moved")
    )
    df = blocks.join(taken, ["owner_id", "ch", "idx"], "left").withColumn("px_before", F.col("px"))
    moved = F.col("_moved").isNotNull()
    return (
        df.withColumn("truth_px", F.transform("px", lambda v: moved))
        .withColumn("px", F.coalesce("_moved", "px")).drop("_moved")
    )


def destroy_blocks(blocks: DataFrame, targets: DataFrame, base: str = BASE_SEED) -> DataFrame:
    """Overwrite whole blocks with noise; ``targets`` is (owner_id, idx)."""
    df = with_seed(blocks, F.lit("coincidence"), F.lit("0"), base)
    df = df.join(targets.select("owner_id", "idx", F.lit(True).alias("_hit")), ["owner_id", "idx"], "left")
    df = df.withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    df = df.withColumn("truth_px", F.transform("px", lambda v: F.col("_hit"))).drop("_hit")
    return write_inside(df, noise_bytes())


def damage_summary(damaged: DataFrame, keys: list[str]) -> DataFrame:
    """Achieved area share, and region pixels that kept their value in every channel by coincidence."""
    masks = arrays.change_masks("px", "px_before", "truth_px")
    per_block = damaged.select(*keys, "idx", masks.alias("_m")).groupBy(*keys, "idx").agg(
        F.max(F.element_at("_m", 1)).alias("n_px"), F.first(F.element_at("_m", 2), ignorenulls=True).alias("t"), F.bit_and(F.element_at("_m", 3)).alias("same"),
    )
    bits = lambda c: F.bit_count(c).cast("bigint")
    return (
        per_block.select(*keys, "n_px", bits(F.col("t")).alias("hit"), bits(F.col("t").bitwiseAND(F.col("same"))).alias("kept"))
        .groupBy(*keys)
        .agg(F.sum("n_px").alias("n_px"), F.sum("hit").alias("n_region_px"), F.sum("kept").alias("n_coincidental_px"))
        .withColumn("achieved_ratio", F.col("n_region_px") / F.col("n_px"))
    )
