"""The evaluation grid: seal once per key, damage, verify, repair and score every cell in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import run_id
from ..functions.pixels import psnr, squared_error
from ..operators import inject, repair, score, seal, verify
from ..session import materialize
from ..sources.carriers import split_blocks
from . import runlog

CLASSES = ("splice", "inpaint_removal", "crop_refill", "noise")
RATIOS = ("0.10", "0.25", "0.50")
VARIANTS = ("A", "B")
N_KEYS = 5
BASE_SEED = 20260811

CELL = ["run_id", "condition", "tamper_class", "nominal", "variant", "block_size", "run_key", "dataset", "stem"]

# The columns of a run row, in order.
RUN_COLUMNS = (
    "run_id condition dataset image_name image_id width height channels tamper_class tamper_ratio_nominal "
    "tamper_ratio_achieved recovery_variant block_size key_id seed wm_psnr wm_ssim raw_block_precision raw_block_recall "
    "raw_block_f1 raw_block_iou raw_block_fpr block_precision block_recall block_f1 block_iou block_fpr px_precision "
    "px_recall px_f1 px_iou px_fpr recoverability_rate psnr_in_region ssim_in_region psnr_pessimistic ssim_pessimistic "
    "psnr_whole_marked psnr_whole_unmarked ssim_whole_marked n_tampered_blocks n_unrecoverable_blocks n_tampered_px "
    "n_unrecoverable_px n_coincidental_unchanged_px n_msb_preserved_miss_blocks n_false_positive_blocks n_blocks_total"
).split()


def dataset() -> Column:
    """A quarter of the owners form the subset that the small-block ablation uses."""
    return F.when(F.col("label") % 4 == 0, "subset").otherwise("rest")


def any_of(values) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def cells(blocks: DataFrame) -> DataFrame:
    """One row per run: main, null and ablation groups, with deterministic ids."""
    owners = blocks.filter((F.col("idx") == 0) & (F.col("ch") == 0)).select("stem", dataset().alias("dataset"))

    def damage(df, variants, block):
        df = df.withColumn("tamper_class", any_of(CLASSES)).withColumn("nominal", any_of(RATIOS))
        df = df.withColumn("variant", any_of(variants)).withColumn("run_key", F.lit(0))
        return df.withColumn("condition", F.lit("tamper")).withColumn("block_size", F.lit(block))

    null = owners.withColumn("variant", any_of(VARIANTS)).withColumn("run_key", any_of(range(N_KEYS)))
    null = null.withColumn("tamper_class", F.lit("")).withColumn("nominal", F.lit(""))
    null = null.withColumn("condition", F.lit("null")).withColumn("block_size", F.lit(8))
    grid = damage(owners, VARIANTS, 8).unionByName(null).unionByName(damage(owners.filter("dataset = 'subset'"), ("A",), 4))
    parts = [F.col(c) for c in ("stem", "condition", "tamper_class", "nominal", "variant", "block_size", "run_key")]
    return grid.withColumn("run_id", run_id(*parts)).select(*CELL)


def group_of() -> Column:
    return (
        F.when(F.col("condition") == "null", "null").when(F.col("block_size") == 8, "main")
        .when(F.col("block_size") == 4, "ablation").otherwise("unknown")
    )


def _with_keys(blocks: DataFrame, keys) -> DataFrame:
    return blocks.withColumn("key_id", any_of(keys))


def scored_family(blocks: DataFrame, plan: DataFrame, ring: DataFrame, variants: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """(scored blocks, fidelity of the sealed pictures) of all runs with one block side.

    Sealing depends on picture, key and variant only, so it is done once per such triple
    and joined to the runs that share it.
    """
    mine = plan.filter(F.col("block_size") == block).drop("block_size", "dataset").withColumnRenamed("run_key", "key_id")
    keyed = _with_keys(blocks, range(N_KEYS) if block == 8 else (0,))
    sealed = None
    for v in variants:
        one = seal.seal(keyed, ring, v, block, extra=["key_id"]).select(*keyed.columns, "variant", "px_sealed")
        sealed = one if sealed is None else sealed.unionByName(one)
    sealed = materialize(sealed)
    picture = ["stem", "key_id", "variant"]
    whole = sealed.groupBy(*picture).agg(
        F.sum(squared_error(F.col("px"), F.col("px_sealed"))).alias("_sq"), F.sum(F.size("px").cast("bigint")).alias("_n")
    ).select(*picture, psnr(F.col("_sq"), F.col("_n")).alias("wm_psnr"))
    like = score.ssim(sealed, picture, "px", "px_sealed").select(*picture, F.col("ssim").alias("wm_ssim"))
    marks = whole.join(like, picture).withColumn("block_size", F.lit(block))

    donors = sealed.drop("px").withColumnRenamed("px_sealed", "px")
    runs = donors.join(mine, picture)
    places = blocks.drop("px", "key_id").join(mine.filter("tamper_class = 'inpaint_removal'"), "stem")
    keys, ratio = ["run_id", "owner_id"], F.col("nominal")
    of = lambda cls: runs.filter(F.col("tamper_class") == cls)
    quiet = of("").withColumn("px_before", F.col("px")).withColumn("truth_px", F.transform("px", lambda v: F.lit(False)))
    damaged = [
        inject.inject_splice(of("splice"), inject.splice_sources(blocks), donors, ratio, keys, ["key_id", "variant"]),
        inject.inject_blob(of("inpaint_removal"), ratio, keys, geometry=places),
        inject.inject_refill(of("crop_refill"), ratio, keys),
        inject.inject_noise(of("noise"), ratio),
    ] + ([quiet] if block == 8 else [])
    cols = [*blocks.columns, "variant", "run_id", "truth_px", "px_before"]
    received = damaged[0].select(*cols)
    for one in damaged[1:]:
        received = received.unionByName(one.select(*cols))
    # read three times below: by the mask, by the owner's state and through the holder
    checked = materialize(verify.check_tags(received, ring, F.col("variant"), block))
    mask = verify.localize(checked, extra=["run_id"])
    state = verify.with_partner_state(checked, mask, ring, extra=["run_id"])
    fixed = repair.repair(state, variants, block).select(
        "run_id", "owner_id", "ch", "idx", "block", "ncols", "px", "px_before", "px_repaired", "truth_px", "raw", "flagged",
        "recoverable", "unrecoverable",
    )
    return fixed, marks


def fixed_point(n: Column, of: Column) -> Column:
    """n/of as text with six decimals, rounded half up in integers."""
    micro = F.floor((n * 2_000_000 + of) / (of * 2)).cast("bigint")
    return F.concat(F.floor(micro / 1_000_000).cast("string"), F.lit("."), F.lpad((micro % 1_000_000).cast("string"), 6, "0"))


def run_table(blocks: DataFrame, ring: DataFrame) -> DataFrame:
    """Every run of the grid as one row."""
    blocks = materialize(blocks)   # placed once: cells, sealing, splice sources and geometry read it
    plan = materialize(cells(blocks))
    four = materialize(split_blocks(blocks.filter(F.col("label") % 4 == 0)))
    scored, marks = None, None
    for src, variants, block in ((blocks, list(VARIANTS), 8), (four, ["A"], 4)):
        s, m = scored_family(src, plan, ring, variants, block)
        scored = s if scored is None else scored.unionByName(s)
        marks = m if marks is None else marks.unionByName(m)
    scored = materialize(scored)
    key = ["run_id"]
    counts = score.confusion_counts(scored, key)
    parts = [
        score.all_loc_scores(counts, key).join(
            counts.select(
                "run_id", F.col("block_fp").alias("n_false_positive_blocks"),
                (F.col("block_tp") + F.col("block_fp") + F.col("block_fn") + F.col("block_tn")).alias("n_blocks_total"),
            ), key,
        ),
        verify.recoverability(scored.filter("ch = 0"), key).select(
            "run_id", F.col("rho").alias("recoverability_rate"), F.col("tampered").alias("n_tampered_blocks"),
            F.col("unrecoverable").alias("n_unrecoverable_blocks"),
        ),
        score.fidelity(score.fidelity_sums(scored, key), key).drop("rho_px"),
        score.msb_preserved_misses(scored, key).drop("n_missed_blocks"),
        score.ssim(scored, key, "px_before", "px_repaired", F.col("truth_px"), ~F.col("unrecoverable")).withColumnRenamed(
            "ssim", "ssim_whole_marked"
        ),
        inject.damage_summary(scored, key).select(
            "run_id", F.col("n_coincidental_px").alias("n_coincidental_unchanged_px"),
            fixed_point(F.col("n_region_px"), F.col("n_px")).alias("_achieved"),
        ),
    ]
    out = plan.join(marks.withColumnRenamed("key_id", "run_key"), ["stem", "run_key", "variant", "block_size"])
    owners = blocks.filter((F.col("idx") == 0) & (F.col("ch") == 0)).select("stem", "width", "height")
    out = out.join(owners, "stem")
    for part in parts:
        out = out.join(part, key)
    damaged = F.col("condition") == "tamper"
    return out.select(
        "run_id", "condition", "dataset", F.col("stem").alias("image_name"),
        F.concat_ws("|", "stem", F.concat("height", F.lit("x"), "width"), F.col("block_size").cast("string")).alias("image_id"),
        "width", "height", F.lit(1).cast("bigint").alias("channels"), "tamper_class", F.col("nominal").alias("tamper_ratio_nominal"),
        F.when(damaged, F.col("_achieved")).otherwise(F.lit("")).alias("tamper_ratio_achieved"),
        F.col("variant").alias("recovery_variant"), "block_size", F.col("run_key").alias("key_id"), F.lit(BASE_SEED).alias("seed"),
        *RUN_COLUMNS[RUN_COLUMNS.index("wm_psnr"):],
    )


def resume(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Cells whose run_id is not in the finished table yet."""
    return plan.join(done.select("run_id"), "run_id", "left_anti")


def append_runs(runs: DataFrame, path: str) -> int:
    """Append finished runs with a UTC timestamp, each once whatever is retried or doubled; returns how many were new."""
    return runlog.append(runs, path)
