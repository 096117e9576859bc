"""Rate-distortion fit of backup bit tables over coefficient rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.backup import dct
from ..functions.pixels import msb

# Widest field, loading factors in sigmas, bits to hand out, floor for the mean.
MAX_BITS = 8
LOADS = tuple(1.2 + 4.8 * i / 48 for i in range(49))
BUDGET_BITS = 95
DC_FLOOR = 7

DIGITS = 4096   # parts of each histogram of a selection by rank


def coefficient_rows(blocks: DataFrame) -> DataFrame:
    """(coef array, energy of all but the first coefficient) per block."""
    df = blocks.select(msb(F.col("px")).alias("_m")).select(dct("_m").alias("coef"))
    energy = F.aggregate(F.slice("coef", 2, 63), F.lit(0.0), lambda s, c: s + c * c)
    return df.withColumn("energy", F.round(energy, 6))


def _finite(df: DataFrame, col: str) -> DataFrame:
    value = F.col(col).cast("double")
    return df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def _ends(rows: DataFrame):
    return rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).first()


def _select(rows: DataFrame, ends, rank: int) -> float:
    low, high = ends.low, ends.high
    while low < high:
        part = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * DIGITS), F.lit(DIGITS - 1))
        counted = rows.filter(F.col("v").between(low, high)).groupBy(part.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(counted.collect(), key=lambda r: r.d):   # at most DIGITS rows
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def exact_rank(df: DataFrame, col: str, rank: int) -> float:
    """The value of a 0-based rank among the finite values of a column, by repeated histograms.

    Each pass counts the values left in DIGITS equal parts of their range, with the least and
    greatest value of each part, and goes on inside the part that holds the rank, until it
    holds one value.  What reaches the driver is one row a part; the range shrinks at least
    by their number, so a handful of passes narrows doubles to one.  The column is read once
    a pass, so costly expressions are best written out first.
    """
    rows = _finite(df, col)
    ends = _ends(rows)
    if not 0 <= rank < ends.n:
        raise ValueError(f"rank {rank} of {ends.n} values")
    return _select(rows, ends, rank)


def exact_median(df: DataFrame, col: str) -> float:
    """Median of the finite values, exactly: the middle one, or the mean of the two in the middle; NaN without values."""
    rows = _finite(df, col)
    ends = _ends(rows)
    if not ends.n:
        return float("nan")
    low = _select(rows, ends, (ends.n - 1) // 2)
    if ends.n % 2:
        return low
    beside = rows.agg(F.count_if(F.col("v") <= low).alias("upto"), F.min(F.when(F.col("v") > low, F.col("v"))).alias("above")).first()
    return (low + (low if beside.upto > ends.n // 2 else beside.above)) / 2


def with_mode(rows: DataFrame, median: float) -> DataFrame:
    return rows.withColumn("mode", F.when(F.col("energy") <= median, 0).otherwise(1))


def position_stats(rows: DataFrame) -> DataFrame:
    """(mode, z, n, sigma, energy) for every position."""
    flat = rows.select("mode", F.posexplode("coef").alias("z", "c"))
    return flat.groupBy("mode", "z").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("c").alias("sigma"), F.avg(F.col("c") * F.col("c")).alias("energy")
    )


def curves(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(mode, z, bits, err, step): least mean squared error of each width over all loading factors.

    Candidate steps are a fixed 2x64x8x49 table.  Each task sums errors per candidate over
    its Arrow batches and only those sums are shuffled; a join with the candidates would
    multiply every coefficient row by 392.
    """
    sigma = np.zeros((2, 64))
    for r in stats.select("mode", "z", "sigma").collect():   # 128 rows
        sigma[r["mode"], r["z"]] = r["sigma"]
    widths, loads = np.arange(1, MAX_BITS + 1), np.array(LOADS)
    step = np.maximum(2 * loads[None, None, None, :] * sigma[:, :, None, None] / (2.0 ** widths)[None, None, :, None], 1e-6)

    def sums(batches):
        total, count = np.zeros(step.shape), np.zeros(2, dtype="int64")
        for pdf in batches:
            coef, mode = np.stack(pdf["coef"].to_numpy()) if len(pdf) else np.empty((0, 64)), pdf["mode"].to_numpy()
            for m in (0, 1):
                c = coef[mode == m]
                count[m] += len(c)
                for z in range(64):
                    x = c[:, z][:, None]
                    for w, bits in enumerate(widths):
                        s = step[m, z, w][None, :]
                        half = 1 << (int(bits) - 1)
                        q = np.clip(np.rint(np.round(x / s, 9)), -half, half - 1)
                        total[m, z, w] += ((q * s - x) ** 2).sum(axis=0)
        m, z, w, j = np.meshgrid(*[np.arange(n) for n in step.shape], indexing="ij")
        yield pd.DataFrame({
            "mode": m.ravel(), "z": z.ravel(), "bits": widths[w.ravel()], "load": j.ravel(), "step": step.ravel(),
            "err": total.ravel(), "n": count[m.ravel()],
        })

    part = rows.select("coef", "mode").mapInPandas(sums, "mode int, z int, bits int, load int, step double, err double, n bigint")
    mean = part.groupBy("mode", "z", "bits", "load", "step").agg((F.sum("err") / F.greatest(F.sum("n"), F.lit(1))).alias("err"))
    best = F.min(F.struct(F.round("err", 6).alias("err"), F.col("load"), F.col("step")))
    return mean.groupBy("mode", "z", "bits").agg(best.alias("b")).select("mode", "z", "bits", "b.err", "b.step")


def allocate(curve: DataFrame, stats: DataFrame) -> DataFrame:
    """(mode, z, bits, step): best marginal gains under the budget, with a floor for the mean.

    Gains come from the lower convex hull of each position's curve, so taking the largest
    gains takes every position's bits in order.  All frames here have a fixed size.
    """
    points = curve.select("mode", "z", "bits", "err").unionByName(
        stats.select("mode", "z", F.lit(0).alias("bits"), F.round("energy", 6).alias("err"))
    )
    a = points.select("mode", "z", F.col("bits").alias("i"), F.col("err").alias("ei"))
    b = points.select("mode", "z", F.col("bits").alias("j"), F.col("err").alias("ej"))
    spans = points.join(a, ["mode", "z"]).join(b, ["mode", "z"]).filter("i <= bits AND bits <= j")
    chord = F.when(F.col("i") == F.col("j"), F.col("ei")).otherwise(
        F.col("ei") + (F.col("ej") - F.col("ei")) * (F.col("bits") - F.col("i")) / F.greatest(F.col("j") - F.col("i"), F.lit(1))
    )
    hull = spans.groupBy("mode", "z", "bits").agg(F.min(chord).alias("hull"))
    gain = F.round(F.lag("hull").over(Window.partitionBy("mode", "z").orderBy("bits")) - F.col("hull"), 6)
    free = hull.withColumn("gain", gain).filter((F.col("bits") > 0) & ~((F.col("z") == 0) & (F.col("bits") <= DC_FLOOR)))
    rank = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("gain"), "z", "bits"))
    taken = free.filter("gain > 0").withColumn("rank", rank).filter(F.col("rank") <= BUDGET_BITS - DC_FLOOR)
    given = taken.groupBy("mode", "z").agg(F.max("bits").alias("bits"))
    floors = stats.filter("z = 0").select("mode", "z", F.lit(DC_FLOOR).alias("bits"))
    bits = given.unionByName(floors).groupBy("mode", "z").agg(F.max("bits").alias("bits"))
    return bits.join(curve, ["mode", "z", "bits"]).select("mode", "z", "bits", "step", "err")
