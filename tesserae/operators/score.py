"""Scores of masks and fidelity from block arrays; pixels are not exploded.

The scored frame has one row per block and channel with px_before (what was sealed),
px (what was received), px_repaired, truth_px, raw, flagged and unrecoverable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays
from ..functions.pixels import psnr, squared_error


def count_true(flags: Column | str) -> Column:
    return F.size(F.filter(flags, lambda t: t)).cast("bigint")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part/whole, or a fixed value where there is nothing to divide by."""
    return F.when(whole > 0, part / F.greatest(whole, F.lit(1))).otherwise(F.lit(empty))


def loc_scores(prefix: str = "", tp="tp", fp="fp", fn="fn", tn="tn") -> list[Column]:
    """Precision, recall and IoU are 1.0 with nothing to count, F1 and FPR 0.0."""
    tp, fp, fn, tn = (F.col(c) for c in (tp, fp, fn, tn))
    p, r = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    return [
        p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), f1.alias(f"{prefix}f1"),
        ratio(tp, tp + fp + fn, 1.0).alias(f"{prefix}iou"), ratio(fp, fp + tn, 0.0).alias(f"{prefix}fpr"),
    ]


def confusion(pred: Column, truth: Column, weight: Column | None = None) -> dict[str, Column]:
    n = weight if weight is not None else F.lit(1)
    cell = lambda cond: F.sum(F.when(cond, n).otherwise(F.lit(0))).cast("bigint")
    return {"tp": cell(pred & truth), "fp": cell(pred & ~truth), "fn": cell(~pred & truth), "tn": cell(~pred & ~truth)}


def confusion_counts(scored: DataFrame, keys: list[str], rule: str = "any") -> DataFrame:
    """Counts at raw-block, block and pixel level, in one aggregation over one channel's rows."""
    df = scored.filter(F.col("ch") == 0)
    hit = count_true("truth_px")
    n = F.size("truth_px").cast("bigint")
    truth = hit > 0 if rule == "any" else hit * 2 >= n
    df = df.withColumn("_t", truth).withColumn("_hit", hit).withColumn("_miss", n - hit)
    aggs = [c.alias(f"raw_{k}") for k, c in confusion(F.col("raw"), F.col("_t")).items()]
    aggs += [c.alias(f"block_{k}") for k, c in confusion(F.col("flagged"), F.col("_t")).items()]
    px = lambda cond, col: F.sum(F.when(cond, F.col(col)).otherwise(F.lit(0))).cast("bigint")
    aggs += [
        px(F.col("flagged"), "_hit").alias("px_tp"), px(F.col("flagged"), "_miss").alias("px_fp"),
        px(~F.col("flagged"), "_hit").alias("px_fn"), px(~F.col("flagged"), "_miss").alias("px_tn"),
    ]
    return df.groupBy(*keys).agg(*aggs)


def all_loc_scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    cols = []
    for level, name in (("raw_", "raw_block_"), ("block_", "block_"), ("px_", "px_")):
        cols += loc_scores(name, *[f"{level}{c}" for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*keys, *cols)


def masked_error(a: str, b: str, mask: str) -> Column:
    """Sum of squared differences where a boolean array holds."""
    zipped = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(mask).alias("m"))
    return F.aggregate(
        zipped, F.lit(0).cast("bigint"),
        lambda s, z: s + F.when(z["m"], ((z["a"] - z["b"]) * (z["a"] - z["b"])).cast("bigint")).otherwise(F.lit(0).cast("bigint")),
    )


def fidelity_sums(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Every squared-error sum and pixel count the repair metrics need, in one pass."""
    df = (
        scored.withColumn("_n", F.size("px").cast("bigint")).withColumn("_errors", arrays.errors("px_before", "px_repaired", "px", "truth_px"))
        .select("*", *[F.element_at("_errors", n + 1).alias(name) for n, name in enumerate(("_hit", "_whole", "_left", "_in"))])
    )
    un = F.col("unrecoverable")
    one = F.col("ch") == 0
    total = lambda c: F.sum(c).cast("bigint")
    pick = lambda cond, c: total(F.when(cond, F.col(c)).otherwise(F.lit(0)))
    return df.groupBy(*keys).agg(
        total(F.col("_n")).alias("n_all"),
        total(F.col("_whole")).alias("sq_marked"),
        total(F.when(un, F.col("_left")).otherwise(F.col("_whole"))).alias("sq_unmarked"),
        pick(~un, "_in").alias("sq_opt"), pick(~un, "_hit").alias("n_opt"),
        total(F.col("_in")).alias("sq_pes"), total(F.col("_hit")).alias("n_pes"),
        pick(one, "_hit").alias("n_tampered_px"), pick(one & un, "_n").alias("n_unrecoverable_px"),
    )


def fidelity(sums: DataFrame, keys: list[str]) -> DataFrame:
    rho = F.when(
        F.col("n_tampered_px") > 0, 1.0 - F.col("n_unrecoverable_px") / F.greatest("n_tampered_px", F.lit(1))
    ).otherwise(F.lit(1.0))
    return sums.select(
        *keys,
        rho.alias("rho_px"),
        psnr(F.col("sq_opt"), F.col("n_opt")).alias("psnr_in_region"),
        psnr(F.col("sq_pes"), F.col("n_pes")).alias("psnr_pessimistic"),
        psnr(F.col("sq_marked"), F.col("n_all")).alias("psnr_whole_marked"),
        psnr(F.col("sq_unmarked"), F.col("n_all")).alias("psnr_whole_unmarked"),
        "n_tampered_px", "n_unrecoverable_px",
    )


def msb_preserved_misses(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Missed blocks whose upper planes the damage left identical in every channel, and misses in all."""
    same = F.element_at(arrays.change_masks("px", "px_before", "truth_px"), 4) == 1
    per_block = scored.groupBy(*keys, "idx").agg(
        F.bool_or(count_true("truth_px") > 0).alias("t"), F.bool_or("flagged").alias("f"), F.bool_and(same).alias("s")
    )
    miss = F.col("t") & ~F.col("f")
    return per_block.groupBy(*keys).agg(
        F.count_if(miss & F.col("s")).alias("n_msb_preserved_miss_blocks"), F.count_if(miss).alias("n_missed_blocks")
    )


def truth_compare(stored: DataFrame, received: DataFrame, mask: DataFrame) -> DataFrame:
    """Where the received copy differs from the stored one, per owner; used for scoring only.

    Blocks the received copy lacks count as changed in every pixel, and as flagged.
    """
    a = stored.select("owner_id", "ch", "idx", F.col("px").alias("px_stored"))
    both = a.join(received.select("owner_id", "ch", "idx", "px"), ["owner_id", "ch", "idx"], "left")
    changed = F.zip_with("px", "px_stored", lambda x, y: x != y)
    both = both.withColumn("_d", F.when(F.col("px").isNull(), F.transform("px_stored", lambda y: F.lit(True))).otherwise(changed))
    per_block = both.groupBy("owner_id", "idx").agg(F.collect_list("_d").alias("_ds")).withColumn(
        "_any",
        F.aggregate(F.slice("_ds", F.lit(2), F.size("_ds")), F.element_at("_ds", 1), lambda acc, s: F.zip_with(acc, s, lambda p, q: p | q)),
    )
    joined = per_block.withColumn("changed", count_true("_any")).withColumn("n", F.size("_any").cast("bigint")).join(
        mask.select("owner_id", "idx", "flagged"), ["owner_id", "idx"], "left"
    ).withColumn("flagged", F.coalesce("flagged", F.lit(True)))
    cells = confusion(F.col("flagged"), F.col("changed") > 0)
    return joined.groupBy("owner_id").agg(
        F.sum("changed").alias("changed_px"), F.sum("n").alias("total_px"),
        F.count_if(F.col("changed") > 0).alias("changed_blocks"), *[c.alias(k) for k, c in cells.items()],
    ).withColumn("changed_ratio", F.col("changed_px") / F.col("total_px"))


def error_by_region(scored: DataFrame) -> DataFrame:
    """Squared error per class of block and its share of the whole."""
    cls = (
        F.when(F.col("unrecoverable"), "unrecoverable").when(F.col("flagged") & (count_true("truth_px") == 0), "clean_in_flagged")
        .when(F.col("flagged"), "recovered").otherwise("untouched")
    )
    sums = scored.withColumn("region", cls).withColumn("_sq", squared_error(F.col("px_before"), F.col("px_repaired"))).groupBy(
        "region"
    ).agg(F.sum("_sq").alias("sum_sq"), F.sum(F.size("px").cast("bigint")).alias("n_px"), F.count(F.lit(1)).alias("n_blocks"))
    total = sums.agg(F.sum("sum_sq").alias("total"))
    # four classes at most on one side, one row on the other
    return sums.join(F.broadcast(total)).select(
        "region", "n_blocks", "n_px", "sum_sq", (F.col("sum_sq") / F.col("n_px")).alias("mse"),
        ratio(F.col("sum_sq"), F.col("total"), 0.0).alias("share"),
    )


# -- structural similarity ---------------------------------------------------

WINDOW = 7
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _ssim_sums(pages: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Per key: sum and number of the similarities of all windows, of those in the truth, and of those in the kept truth."""
    along = Window.partitionBy(*keys, "ch", "_r").orderBy("_c")
    across = Window.partitionBy(*keys, "ch", "_c").orderBy("_r")
    rows = pages.select("*", *[step(c).over(along).alias(f"{c}{part}") for part, step in (("_left", F.lag), ("_right", F.lead)) for c in ("a", "b")])
    sums = arrays.row_sums(side, WINDOW)("a_left", "a", "a_right", "b_left", "b", "b_right")
    rows = rows.select(*keys, "ch", "_r", "_c", "truth", "keep", sums.alias("h"))
    boxes = rows.select("*", F.lag("h").over(across).alias("h_up"), F.lead("h").over(across).alias("h_down"))
    parts = boxes.select(*keys, arrays.similarity_sums(side, WINDOW, C1, C2)("h_up", "h", "h_down", "truth", "keep").alias("s"))
    return parts.groupBy(*keys).agg(*[F.sum(f"s.{name}").alias(name) for name in SUMS])


SUMS = arrays.SIMILARITIES.names


def ssim(df: DataFrame, keys: list[str], a: str, b: str, truth: Column | None = None, keep: Column | None = None, sides: tuple[int, ...] = (8, 4)) -> DataFrame:
    """Mean 7x7 structural similarity of two pictures per key: whole, over truth, over kept truth.

    Window sums are separable.  A block takes the pixels of its left and right neighbours to
    sum along rows, then those sums of its upper and lower neighbours to sum across them, so
    a task holds one row or column of blocks of a page at a time, never a page; windows that
    leave the page are null.  ``sides`` are the block sides that occur.
    """
    pages = df.select(
        *keys, "ch", "block", F.floor(F.col("idx") / F.col("ncols")).cast("long").alias("_r"), (F.col("idx") % F.col("ncols")).cast("long").alias("_c"),
        F.col(a).cast("array<int>").alias("a"), F.col(b).cast("array<int>").alias("b"),
        (truth if truth is not None else F.lit(None)).cast("array<boolean>").alias("truth"), (keep if keep is not None else F.lit(True)).alias("keep"),
    )
    sums = None
    for side in sides:
        one = _ssim_sums(pages.filter(F.col("block") == side).drop("block"), keys, side)
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in SUMS])
    mean = lambda s: F.when(
        F.col(f"{s}_n") > 0, F.col(f"{s}_sum") / F.greatest(f"{s}_n", F.lit(1))
    ).otherwise(F.lit(float("nan")))
    return sums.select(
        *keys, mean("ssim").alias("ssim"), mean("opt").alias("ssim_in_region"), mean("pes").alias("ssim_pessimistic")
    )
