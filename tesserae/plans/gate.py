"""Data-quality gate: a table of checks evaluated in one aggregate pass over the runs.

Status rules: nothing to check is SKIP; a broken hard or structural rule is FAIL; a broken
soft rule is WARN and never fails the gate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .grid import group_of


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    where: str          # SQL predicate over run rows
    metric: str         # SQL expression
    stat: str           # mean, min, max, sum, count
    lo: float | None = None
    hi: float | None = None


MAIN = "condition = 'tamper' AND block_size = 8"
TAMPER = "condition = 'tamper'"

# Bands of the published image corpus.  Another corpus brings its own table.
CHECKS = (
    Check("wm_psnr mean A", "hard", f"{MAIN} AND recovery_variant = 'A'", "wm_psnr", "mean", 42.8, 43.6),
    Check("wm_psnr mean B", "hard", f"{MAIN} AND recovery_variant = 'B'", "wm_psnr", "mean", 43.9, 44.6),
    Check("wm_psnr max A", "hard", f"{MAIN} AND recovery_variant = 'A'", "wm_psnr", "max", None, 44.30),
    Check("wm_psnr max B", "hard", f"{MAIN} AND recovery_variant = 'B'", "wm_psnr", "max", None, 44.70),
    Check("wm_ssim min A", "hard", f"{MAIN} AND recovery_variant = 'A'", "wm_ssim", "min", 0.96, None),
    Check("wm_ssim min B", "hard", f"{MAIN} AND recovery_variant = 'B'", "wm_ssim", "min", 0.96, None),
    Check("null false positives", "hard", "condition = 'null'", "n_false_positive_blocks", "sum", 0, 0),
    Check("block_precision mean", "hard", TAMPER, "block_precision", "mean", 0.98, None),
    Check("block_recall mean", "hard", TAMPER, "block_recall", "mean", 0.97, None),
    Check("psnr_whole_unmarked mean 0.10", "hard", f"{TAMPER} AND tamper_ratio_nominal = '0.10'", "psnr_whole_unmarked", "mean", 28, 40),
    Check("psnr_whole_unmarked mean 0.25", "hard", f"{TAMPER} AND tamper_ratio_nominal = '0.25'", "psnr_whole_unmarked", "mean", 22, 36),
    Check("psnr_whole_unmarked mean 0.50", "hard", f"{TAMPER} AND tamper_ratio_nominal = '0.50'", "psnr_whole_unmarked", "mean", 13, 32),
    Check("psnr_in_region mean", "hard", TAMPER, "psnr_in_region", "mean", 22, 36),
    Check("rho not finite", "hard", "TRUE", "CASE WHEN isnan(recoverability_rate) OR abs(recoverability_rate) = double('Infinity') THEN 1 ELSE 0 END", "sum", 0, 0),
    Check("marked above unmarked rate", "soft", "NOT isnan(psnr_whole_marked) AND NOT isnan(psnr_whole_unmarked)",
          "CASE WHEN psnr_whole_marked > psnr_whole_unmarked + 1e-6 THEN 1.0D ELSE 0.0D END", "mean", None, 0.15),
    Check("psnr_in_region below 18", "soft", "TRUE", "CASE WHEN NOT isnan(psnr_in_region) AND psnr_in_region < 18 THEN 1 ELSE 0 END", "sum", 0, 0),
    Check("coincidental px above half a percent", "soft", f"{TAMPER} AND n_tampered_px > 0",
          "CASE WHEN n_coincidental_unchanged_px > 0.005D * n_tampered_px THEN 1 ELSE 0 END", "sum", 0, 0),
    Check("msb-preserved misses", "soft", "TRUE", "n_msb_preserved_miss_blocks", "sum", 0, 0),
    Check("px_precision mean", "soft", TAMPER, "px_precision", "mean", 0.80, None),
)

RESULT = "name string, severity string, status string, value double, lo double, hi double, n bigint, skipped bigint"


def status(severity: str, ok: Column, n: Column) -> Column:
    bad = "WARN" if severity == "soft" else "FAIL"
    return F.when(n == 0, "SKIP").when(ok, "PASS").otherwise(bad)


def evaluate(runs: DataFrame, checks=CHECKS) -> DataFrame:
    """All checks from a single aggregation; non-finite values are skipped and counted."""
    aggs = []
    for i, c in enumerate(checks):
        v = F.when(F.expr(c.where), F.expr(c.metric).cast("double"))
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        fn = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[c.stat]
        aggs += [
            fn(F.when(finite, v)).alias(f"v{i}"), F.count_if(finite).alias(f"n{i}"),
            F.count_if(F.expr(c.where) & ~finite).alias(f"s{i}"),
        ]
    one = runs.agg(*aggs)
    rows = []
    for i, c in enumerate(checks):
        v, n = F.col(f"v{i}"), F.col(f"n{i}")
        ok = F.lit(True)
        if c.lo is not None:
            ok = ok & (v >= c.lo)
        if c.hi is not None:
            ok = ok & (v <= c.hi)
        rows.append(F.struct(
            F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), status(c.severity, ok, n).alias("status"),
            v.alias("value"), F.lit(c.lo).cast("double").alias("lo"), F.lit(c.hi).cast("double").alias("hi"),
            n.alias("n"), F.col(f"s{i}").alias("skipped"),
        ))
    return one.select(F.inline(F.array(*rows)))


def _row(df: DataFrame, name: str, severity: str, ok: Column, value: Column, n: Column, lo=None, hi=None) -> DataFrame:
    return df.select(
        F.lit(name).alias("name"), F.lit(severity).alias("severity"), status(severity, ok, n).alias("status"),
        value.cast("double").alias("value"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"),
        n.cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("skipped"),
    )


def monotone_means(runs: DataFrame) -> DataFrame:
    """Mean recoverability per nominal share and whether it falls from one share to the next."""
    from pyspark.sql import Window

    means = runs.filter(TAMPER).groupBy("tamper_ratio_nominal").agg(
        F.avg("recoverability_rate").alias("rho"), F.count(F.lit(1)).alias("n")
    )
    # one row per nominal share
    before = F.lag("rho").over(Window.orderBy("tamper_ratio_nominal"))
    return means.withColumn("ok", F.coalesce(F.col("rho") <= before, F.lit(True)))


def check_monotone(runs: DataFrame) -> DataFrame:
    one = monotone_means(runs).agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n"), F.min("rho").alias("v"))
    enough = F.when(F.col("n") == 3, F.col("n")).otherwise(F.lit(0))
    return _row(one, "rho falls with the damaged share", "hard", F.col("ok"), F.col("v"), enough)


def row_counts(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows found and expected per group of the grid."""
    found = runs.groupBy(group_of().alias("grp")).agg(F.count(F.lit(1)).alias("found"))
    wanted = plan.groupBy(group_of().alias("grp")).agg(F.count(F.lit(1)).alias("expected"))
    both = wanted.join(found, "grp", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.select("grp", zero(F.col("found")).alias("found"), zero(F.col("expected")).alias("expected")).withColumn(
        "status", F.when(F.col("found") == F.col("expected"), "PASS").otherwise("FAIL")
    )


def missing_cells(runs: DataFrame, plan: DataFrame, shown: int = 3) -> DataFrame:
    """Expected cells that were not run: how many per group, and the first few of them."""
    from pyspark.sql import Window

    gone = plan.join(runs.select("run_id"), "run_id", "left_anti").withColumn("grp", group_of())
    counts = gone.groupBy("grp").agg(F.count(F.lit(1)).alias("n_missing"))
    order = Window.partitionBy("grp").orderBy("cell")
    label = F.concat_ws("|", "stem", "tamper_class", "nominal", "variant", F.col("run_key").cast("string"))
    first = gone.withColumn("cell", label).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown)
    return first.join(counts, "grp").select("grp", "n_missing", "rank", "cell")


def duplicates(runs: DataFrame) -> DataFrame:
    """Run ids that occur more than once."""
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def paired_columns(columns: list[str]) -> bool:
    """In-region PSNR and recoverability are reported together or not at all."""
    return ("recoverability_rate" in columns) == ("psnr_in_region" in columns)


def report(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Every check as a row, structural ones first in kind."""
    counts = row_counts(runs.select("run_id", "condition", "block_size"), plan).agg(
        F.count_if(F.col("status") == "FAIL").alias("bad"), F.sum("found").alias("v"), F.sum("expected").alias("n")
    )
    dup = duplicates(runs).agg(F.count(F.lit(1)).alias("v"))
    pair = paired_columns(runs.columns)
    out = evaluate(runs)
    out = out.unionByName(_row(counts, "row counts", "structural", F.col("bad") == 0, F.col("v"), F.col("n")))
    out = out.unionByName(_row(dup, "duplicate run_id", "structural", F.col("v") == 0, F.col("v"), F.lit(1), 0, 0))
    out = out.unionByName(
        _row(dup, "column pairing", "structural", F.lit(pair), F.lit(1.0 if pair else 0.0), F.lit(1), 1, 1)
    )
    return out.unionByName(check_monotone(runs))


def verdict(results: DataFrame) -> DataFrame:
    """Rows per status, and the overall answer: no FAIL."""
    return results.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP", "WARN")],
        F.bool_and(F.col("status") != "FAIL").alias("passed"),
    )


def write_if_passed(results: DataFrame, reports: dict[str, DataFrame], folder: str) -> bool:
    """Reports are written only behind a passed gate; the gate's own rows always are."""
    results.write.mode("overwrite").parquet(f"{folder}/gate")
    passed = bool(verdict(results).first()["passed"])
    if passed:
        for name, df in reports.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return passed
