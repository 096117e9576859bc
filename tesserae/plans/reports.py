"""Grouped summaries of the run table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .grid import CLASSES


def finite(col: str) -> Column:
    return F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) != float("inf"))


#: Statistics add whole billionths, which are the same in any order; values from EXACT_BELOW on are added as doubles.
BILLION, EXACT_BELOW = 1_000_000_000, 1e6


def stats(col: str, prefix: str | None = None) -> list[Column]:
    """mean, population std, n and skipped over finite values; std 0.0 below two values, mean NaN at none."""
    p = prefix or col
    v = F.when(finite(col), F.col(col))
    n = F.count(v)
    whole = F.when(F.abs(v) < EXACT_BELOW, F.rint(v * BILLION).cast("decimal(20,0)"))
    exact = F.coalesce(F.max(F.abs(v)) < EXACT_BELOW, F.lit(False))
    total, squares = F.sum(whole), F.sum((whole * whole).cast("decimal(38,0)"))
    wide = total.cast("decimal(38,0)")
    spread = F.try_subtract(F.try_multiply(squares, n.cast("decimal(20,0)")), F.try_multiply(wide, wide)).cast("double")
    size = F.greatest(n, F.lit(1)).cast("double")
    return [
        F.coalesce(F.when(exact, total.cast("double") / size / BILLION).otherwise(F.avg(v)), F.lit(float("nan"))).alias(f"{p}_mean"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.coalesce(F.when(exact, F.sqrt(spread) / size / BILLION), F.stddev_pop(v))).alias(f"{p}_std"),
        n.alias(f"{p}_n"),
        F.count_if(~finite(col)).alias(f"{p}_skipped"),
    ]


def aggregate_by(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    cols = [c for v in values for c in stats(v)]
    return runs.groupBy(*keys).agg(*cols) if keys else runs.agg(*cols)


def fidelity(runs: DataFrame) -> DataFrame:
    """Sealed fidelity per image and variant side by side, plus the mean in which each image counts once."""
    src = runs.filter("block_size = 8 AND key_id = 0")
    per_image = src.groupBy("image_name").pivot("recovery_variant", ["A", "B"]).agg(
        F.avg("wm_psnr").alias("psnr"), F.avg("wm_ssim").alias("ssim")
    )
    names = ["A_psnr", "A_ssim", "B_psnr", "B_ssim"]
    mean = per_image.agg(F.lit("(mean)").alias("image_name"), *[F.avg(n).alias(n) for n in names])
    return per_image.unionByName(mean)


LOCALIZATION = [
    "block_precision", "block_recall", "block_f1", "block_iou", "recoverability_rate", "psnr_in_region", "psnr_whole_unmarked",
]


def localization(runs: DataFrame) -> DataFrame:
    """Variant A on the main grid by class and share; PSNR never without rho."""
    src = runs.filter("condition = 'tamper' AND recovery_variant = 'A' AND block_size = 8")
    src = src.withColumn("achieved", F.col("tamper_ratio_achieved").cast("double"))
    order = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("tamper_class")).cast("bigint")
    return aggregate_by(src, ["tamper_class", "tamper_ratio_nominal"], LOCALIZATION + ["achieved"]).withColumn(
        "class_rank", order
    ).orderBy("class_rank", "tamper_ratio_nominal")


def mean_pm_std(mean: Column, std: Column, digits: int) -> Column:
    """'1.234 ± 0.056' as text, halves up; '--' without data.  For measures that are not negative."""

    def fixed(x: Column) -> Column:
        n = F.floor(x * 10**digits + 0.500001).cast("bigint")
        return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))

    text = F.concat(fixed(mean), F.lit(" ± "), fixed(std))
    return F.when(mean.isNull() | F.isnan(mean), "--").otherwise(text)


def localization_text(table: DataFrame) -> DataFrame:
    """Cells of a localization table as text.  A cell with a PSNR names its rho; without a rho it is refused."""
    cell = lambda c, digits: mean_pm_std(F.col(f"{c}_mean"), F.col(f"{c}_std"), digits)
    rho = F.when(F.col("recoverability_rate_n") > 0, cell("recoverability_rate", 3))
    with_rho = lambda c: F.when(
        rho.isNull(), F.raise_error(F.lit(f"{c} is not shown without a recoverability rate")).cast("string")
    ).otherwise(F.concat(cell(c, 2), F.lit(" dB at rho "), rho))
    return table.select(
        "tamper_class", "tamper_ratio_nominal", *[cell(c, 4).alias(c) for c in ("block_precision", "block_recall", "block_f1", "block_iou")],
        *[with_rho(c).alias(c) for c in ("psnr_in_region", "psnr_whole_unmarked")],
    )


def null_condition(runs: DataFrame) -> DataFrame:
    """False positives on intact input and the rule-of-three bound 3/n."""
    src = runs.filter("condition = 'null'")
    n, fp = F.sum("n_blocks_total"), F.sum("n_false_positive_blocks")
    per = lambda x: F.when(n > 0, x / F.greatest(n, F.lit(1)))
    return src.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("image_name").alias("n_images"),
        F.countDistinct("recovery_variant").alias("n_variants"), F.countDistinct("key_id").alias("n_keys"),
        n.alias("n_block_checks"), fp.alias("n_false_positives"), per(fp).alias("block_fpr"),
        F.avg("px_fpr").alias("px_fpr"), per(F.lit(3.0)).alias("rule_of_three"),
    )


def block_size(runs: DataFrame) -> DataFrame:
    """Blocks of side 8 and 4 on the subset."""
    src = runs.filter("condition = 'tamper' AND recovery_variant = 'A' AND dataset = 'subset'")
    return aggregate_by(src, ["block_size"], ["block_precision", "px_precision", "px_iou", "recoverability_rate", "psnr_in_region"])


# Figures cited from the literature (method, sealed PSNR, sealed SSIM, recovered PSNR, note).
PUBLISHED = (
    ("AuSR1 (Aminuddin & Ernawan 2022)", "45.57", "~0.99", "27.64", "worst case reported; 2x2 blocks"),
    ("Wu et al. (CMC 2025)", ">41", "--", ">30 @ 50% tamper", "0% FPR/FNR, 100% detection rate"),
    ("Korus & Dziech (IEEE TIP 2013)", "--", "--", "37 @ 50% damage", "fountain codes, >10,000 images"),
)


def comparison(runs: DataFrame) -> DataFrame:
    """Measured variant A beside cited figures; measured cells are computed, cited ones are text."""
    main = "recovery_variant = 'A' AND block_size = 8"
    half = f"{main} AND condition = 'tamper' AND tamper_ratio_nominal = '0.50'"
    hit = f"{main} AND condition = 'tamper'"

    def mean(where, col):
        return F.avg(F.when(F.expr(where) & finite(col), F.col(col)))

    ours = runs.agg(
        F.lit("measured, variant A").alias("method"), mean(f"{main} AND key_id = 0", "wm_psnr").alias("wm_psnr"),
        mean(f"{main} AND key_id = 0", "wm_ssim").alias("wm_ssim"), mean(half, "psnr_whole_unmarked").alias("recovered_psnr"),
        mean(half, "psnr_whole_marked").alias("marked_psnr"), mean(hit, "block_precision").alias("block_precision"),
        mean(hit, "block_recall").alias("block_recall"), mean(hit, "px_precision").alias("px_precision"),
    )
    cited = runs.sparkSession.createDataFrame(PUBLISHED, "method string, cited_psnr string, cited_ssim string, cited_recovered string, note string")
    return ours.unionByName(cited, allowMissingColumns=True)


def series(runs: DataFrame) -> DataFrame:
    """Summary by variant, class and share, as for plots; buckets without rows are absent."""
    src = runs.filter("condition = 'tamper'")
    return aggregate_by(
        src, ["recovery_variant", "block_size", "tamper_class", "tamper_ratio_nominal"],
        ["block_recall", "px_precision", "recoverability_rate", "psnr_whole_marked"],
    )


def map_policy(states: dict[str, DataFrame]) -> DataFrame:
    """rho per damaged share under several map policies."""
    from ..operators.verify import recoverability

    out = None
    for policy, df in states.items():
        one = recoverability(df, ["nominal"]).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out
