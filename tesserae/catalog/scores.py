"""Queries that score masks and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inject, score, seal
from . import sqlkit as S
from .cases import case, case_sql, repaired, repaired_sql
from .registry import query, r6, sql_r6

OWNER = ["owner_id"]
ARGS = dict(channels=3, ratio="0.50")


def scored(spark, d):
    """Three-channel case with half the picture damaged, so that every class of block occurs."""
    return repaired(case(spark, d, **ARGS))


def scored_sql():
    return repaired_sql(**ARGS)


def sql_scores(prefix: str, level: str, shown=sql_r6) -> str:
    tp, fp, fn, tn = (f"{level}_{c}" for c in ("tp", "fp", "fn", "tn"))
    p = f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 1.0 END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 1.0 END"
    f1 = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"
    iou = f"CASE WHEN {tp} + {fp} + {fn} > 0 THEN {tp} / ({tp} + {fp} + {fn}) ELSE 1.0 END"
    fpr = f"CASE WHEN {fp} + {tn} > 0 THEN {fp} / ({fp} + {tn}) ELSE 0.0 END"
    return ", ".join(shown(e, f"{prefix}{n}") for e, n in ((p, "precision"), (r, "recall"), (f1, "f1"), (iou, "iou"), (fpr, "fpr")))


@query(
    "truth_to_blocks",
    case_sql().select(
        """SELECT owner_id, idx::BIGINT AS idx, hit::BIGINT AS hit, hit > 0 AS any_rule, hit / 64 >= 0.5 AS majority_rule
           FROM (SELECT owner_id, idx, len(list_filter(truth_px, lambda t: t)) AS hit FROM dmg WHERE ch = 0)"""
    ),
)
def truth_to_blocks(spark, d):
    """Pixel truth reduced to blocks by any pixel and by majority."""
    df = case(spark, d).damaged.filter("ch = 0")
    a = inject.truth_blocks(df, "any").withColumnRenamed("truth", "any_rule")
    m = inject.truth_blocks(a, "majority").withColumnRenamed("truth", "majority_rule")
    return m.select("owner_id", "idx", score.count_true("truth_px").alias("hit"), "any_rule", "majority_rule")


@query("confusion_counts", scored_sql().confusion("rep", "cf").select("SELECT * FROM cf"))
def confusion_counts(spark, d):
    """True and false positives and negatives for raw blocks, blocks and pixels."""
    return score.confusion_counts(scored(spark, d), OWNER)


@query(
    "loc_scores",
    scored_sql().confusion("rep", "cf").select(
        f"SELECT owner_id, {sql_scores('raw_block_', 'raw')}, {sql_scores('block_', 'block')}, {sql_scores('px_', 'px')} FROM cf"
    ),
)
def loc_scores(spark, d):
    """Precision, recall, F1, IoU and false-positive rate at three levels."""
    s = score.all_loc_scores(score.confusion_counts(scored(spark, d), OWNER), OWNER)
    return s.select("owner_id", *[r6(F.col(c), c) for c in s.columns if c != "owner_id"])


@query(
    "msb_preserved_miss",
    scored_sql().select(
        """SELECT owner_id, count_if(t AND NOT f AND same)::BIGINT AS n_msb_preserved_miss_blocks, count_if(t AND NOT f)::BIGINT AS n_missed_blocks
           FROM (SELECT owner_id, idx, bool_or(len(list_filter(truth_px, lambda z: z)) > 0) AS t, bool_or(raw) AS f,
                 bool_and(list_transform(px, lambda v: v & 252) = list_transform(px_before, lambda w: w & 252)) AS same FROM rep GROUP BY ALL)
           GROUP BY owner_id"""
    ),
)
def msb_preserved_miss(spark, d):
    """Missed blocks that damage left unchanged in the upper planes, judged on the raw mask."""
    raw = scored(spark, d).withColumn("flagged", F.col("raw"))
    return score.msb_preserved_misses(raw, OWNER)


@query(
    "truth_compare",
    case_sql().add("two", "SELECT c.*, r.px AS stored FROM chk c JOIN (SELECT owner_id, ch, idx, px FROM rcv) r USING (owner_id, ch, idx)").select(
        f"""SELECT owner_id, sum(ch_px)::BIGINT AS changed_px, (64 * count(*))::BIGINT AS total_px, count_if(ch_px > 0)::BIGINT AS changed_blocks,
            count_if(flagged AND ch_px > 0)::BIGINT AS tp, count_if(flagged AND ch_px = 0)::BIGINT AS fp, count_if(NOT flagged AND ch_px > 0)::BIGINT AS fn,
            count_if(NOT flagged AND ch_px = 0)::BIGINT AS tn, {sql_r6('sum(ch_px) / (64 * count(*))', 'changed_ratio')}
            FROM (SELECT owner_id, idx, len(list_filter(range(64), lambda i: px[(i+1)::INT] <> stored[(i+1)::INT])) AS ch_px FROM two)
            JOIN (SELECT owner_id, idx, flagged FROM mask) USING (owner_id, idx) GROUP BY owner_id"""
    ),
)
def truth_compare(spark, d):
    """Received against stored copy: changed pixels, blocks, and how the mask agrees."""
    c = case(spark, d)
    out = score.truth_compare(seal.as_received(c.sealed), c.damaged, c.mask)
    return out.withColumn("changed_ratio", F.round("changed_ratio", 6))


SUMS = scored_sql().fidelity_sums("rep", "fs")


@query(
    "psnr",
    case_sql(channels=3).select(
        f"SELECT owner_id, sum({S.sq_err('px_before', 'px')})::BIGINT AS sum_sq, {sql_r6(S.psnr('sum(' + S.sq_err('px_before', 'px') + ')', '(64 * count(*))'), 'psnr')} FROM dmg GROUP BY owner_id"
    ),
)
def psnr_query(spark, d):
    """Whole-frame PSNR of the damaged copy."""
    from ..functions.pixels import psnr, squared_error

    g = case(spark, d, channels=3).damaged.groupBy("owner_id").agg(
        F.sum(squared_error(F.col("px_before"), F.col("px"))).alias("sum_sq"), F.sum(F.size("px").cast("bigint")).alias("n")
    )
    return g.select("owner_id", "sum_sq", r6(psnr(F.col("sum_sq"), F.col("n")), "psnr"))


@query("psnr_masked", SUMS.select(f"SELECT owner_id, n_opt, {sql_r6(S.psnr('sq_opt', 'n_opt'), 'psnr_in_region')}, n_pes, {sql_r6(S.psnr('sq_pes', 'n_pes'), 'psnr_pessimistic')} FROM fs"))
def psnr_masked(spark, d):
    """PSNR over the damaged region, without and with the unrecoverable part."""
    from ..functions.pixels import psnr

    f = score.fidelity_sums(scored(spark, d), OWNER)
    return f.select(
        "owner_id", "n_opt", r6(psnr(F.col("sq_opt"), F.col("n_opt")), "psnr_in_region"),
        "n_pes", r6(psnr(F.col("sq_pes"), F.col("n_pes")), "psnr_pessimistic"),
    )


@query(
    "psnr_marked_unmarked",
    SUMS.select(f"SELECT owner_id, {sql_r6(S.psnr('sq_marked', 'n_all'), 'psnr_whole_marked')}, {sql_r6(S.psnr('sq_unmarked', 'n_all'), 'psnr_whole_unmarked')} FROM fs"),
)
def psnr_marked_unmarked(spark, d):
    """Whole-frame PSNR with unrecoverable blocks marked, and left as received."""
    f = score.fidelity(score.fidelity_sums(scored(spark, d), OWNER), OWNER)
    return f.select("owner_id", r6(F.col("psnr_whole_marked"), "psnr_whole_marked"), r6(F.col("psnr_whole_unmarked"), "psnr_whole_unmarked"))


@query(
    "ssim",
    S.Sql().keyring().vectors("fa", 3, 4).seal("fa", "sealed", "B").ssim("sealed", "ss", "px", "px_sealed").select(
        f"SELECT owner_id, {sql_r6('ssim', 'ssim')} FROM ss"
    ),
)
def ssim_query(spark, d):
    """Structural similarity of sealed and plain pictures, mean over channels."""
    from ..sources import carriers
    from ..sources.keyring import keyring

    s = seal.seal(carriers.vector_blocks(spark, d, 3, 4), keyring(spark), "B")
    return score.ssim(s, OWNER, "px", "px_sealed").select("owner_id", r6(F.col("ssim"), "ssim"))


SSIM_REP = scored_sql().ssim("rep", "ss", "px_before", "px_repaired", truth="truth_px", keep="NOT unrecoverable")


@query(
    "ssim_masked",
    SSIM_REP.select(f"SELECT owner_id, {sql_r6('ssim_in_region', 'ssim_in_region')}, {sql_r6('ssim_pessimistic', 'ssim_pessimistic')} FROM ss"),
)
def ssim_masked(spark, d):
    """Similarity map averaged over the damaged region inside the border strip."""
    s = score.ssim(scored(spark, d), OWNER, "px_before", "px_repaired", F.col("truth_px"), ~F.col("unrecoverable"))
    return s.select("owner_id", r6(F.col("ssim_in_region"), "ssim_in_region"), r6(F.col("ssim_pessimistic"), "ssim_pessimistic"))


FIDELITY = ["rho_px", "psnr_in_region", "psnr_pessimistic", "psnr_whole_marked", "psnr_whole_unmarked"]
RHO_PX = "CASE WHEN n_tampered_px > 0 THEN 1.0 - n_unrecoverable_px / n_tampered_px ELSE 1.0 END"


@query(
    "recovery_metrics",
    SSIM_REP.fidelity_sums("rep", "fs").select(
        f"""SELECT owner_id, {sql_r6(RHO_PX, 'rho_px')}, {sql_r6(S.psnr('sq_opt', 'n_opt'), 'psnr_in_region')}, {sql_r6(S.psnr('sq_pes', 'n_pes'), 'psnr_pessimistic')},
            {sql_r6(S.psnr('sq_marked', 'n_all'), 'psnr_whole_marked')}, {sql_r6(S.psnr('sq_unmarked', 'n_all'), 'psnr_whole_unmarked')}, n_tampered_px, n_unrecoverable_px,
            {sql_r6('ssim', 'ssim_whole')}, {sql_r6('ssim_in_region', 'ssim_in_region')}, {sql_r6('ssim_pessimistic', 'ssim_pessimistic')} FROM fs JOIN ss USING (owner_id)"""
    ),
)
def recovery_metrics(spark, d):
    """Repair quality, always together with the recoverability rate."""
    rep = scored(spark, d)
    f = score.fidelity(score.fidelity_sums(rep, OWNER), OWNER)
    s = score.ssim(rep, OWNER, "px_before", "px_repaired", F.col("truth_px"), ~F.col("unrecoverable"))
    out = f.join(s.withColumnRenamed("ssim", "ssim_whole"), OWNER)
    return out.select(
        "owner_id", *[r6(F.col(c), c) for c in FIDELITY], "n_tampered_px", "n_unrecoverable_px",
        *[r6(F.col(c), c) for c in ("ssim_whole", "ssim_in_region", "ssim_pessimistic")],
    )


@query(
    "error_by_region",
    scored_sql().add(
        "er",
        f"""SELECT region, count(*) AS n_blocks, 64 * count(*) AS n_px, sum(sq) AS sum_sq FROM (SELECT {S.sq_err('px_before', 'px_repaired')} AS sq,
            CASE WHEN unrecoverable THEN 'unrecoverable' WHEN flagged AND len(list_filter(truth_px, lambda t: t)) = 0 THEN 'clean_in_flagged'
            WHEN flagged THEN 'recovered' ELSE 'untouched' END AS region FROM rep) GROUP BY region""",
    ).select(
        f"SELECT region, n_blocks::BIGINT AS n_blocks, n_px::BIGINT AS n_px, sum_sq::BIGINT AS sum_sq, {sql_r6('sum_sq / n_px', 'mse')}, "
        f"{sql_r6('CASE WHEN sum(sum_sq) OVER () > 0 THEN sum_sq / sum(sum_sq) OVER () ELSE 0.0 END', 'share')} FROM er"
    ),
)
def error_by_region(spark, d):
    """Where the remaining squared error sits."""
    e = score.error_by_region(scored(spark, d))
    return e.select("region", "n_blocks", "n_px", "sum_sq", r6(F.col("mse"), "mse"), r6(F.col("share"), "share"))
