"""Which runs keep their pictures: the staged frames of chosen cells, and of no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Columns of a scored frame that are stages, in the order they come about.
STAGES = {"sealed": "px_before", "received": "px", "repaired": "px_repaired"}
RATIO, VARIANT, BLOCK = "0.25", "A", 8


def chosen_cells(plan: DataFrame, stem: str | None = None) -> DataFrame:
    """Cells of the plan whose frames are kept: one picture, every class, one share and one variant.

    Without ``stem`` the picture of the smallest name is taken.
    """
    cells = plan.filter((F.col("condition") == "tamper") & (F.col("nominal") == RATIO) & (F.col("variant") == VARIANT) & (F.col("block_size") == BLOCK))
    if stem is not None:
        return cells.filter(F.col("stem") == stem)
    first = cells.agg(F.min("stem").alias("stem"))
    return cells.join(F.broadcast(first), "stem", "left_semi")   # one row


def stages(scored: DataFrame, cells: DataFrame) -> DataFrame:
    """(run_id, stage, owner_id, ch, idx, px): five stages of every kept block; frames of other runs are dropped where they are read.

    Sealed, received and repaired pixels, the truth and the mask (255 where it holds).
    """
    kept = scored.join(cells.select("run_id"), "run_id", "left_semi")
    white = lambda flag: F.when(flag, 255).otherwise(0)
    mask: dict[str, Column] = {"truth": F.transform("truth_px", white), "mask": F.transform("px", lambda v: white(F.col("flagged")))}
    every = {name: F.col(c) for name, c in STAGES.items()} | mask
    each = F.array(*[F.struct(F.lit(name).alias("stage"), F.transform(px, lambda v: v.cast("int")).alias("px")) for name, px in every.items()])
    return kept.select("run_id", "owner_id", "ch", "idx", F.explode(each).alias("_s")).select("run_id", "_s.stage", "owner_id", "ch", "idx", "_s.px")


def keep(scored: DataFrame, cells: DataFrame, path: str) -> None:
    """Write the stages, a folder for each run and stage; a second write of the same cells replaces those folders alone."""
    out = stages(scored, cells).repartition("run_id", "stage")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "stage").parquet(path)
