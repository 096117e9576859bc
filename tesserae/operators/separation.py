"""The separated map with a distance of the caller's choice, relaxed where an owner cannot meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .partner import partner_map, squared_distance

MAX_RELAXATIONS = 10


def separated_map(blocks: DataFrame, ring: DataFrame, d_min: Column | None = None) -> DataFrame:
    """(owner_id, idx, holder, carries, d_min, relaxations, violations).

    The map is the separated cycle of ``partner``, which meets a quarter of the shorter side
    (the default) in every grid.  A larger wanted distance is halved until the owner's
    nearest partners meet it; ``d_min`` is the distance met and ``violations`` counts the
    edges below it.  An owner that needs more than ten halvings, or has one block alone,
    raises an error.
    """
    wanted = (d_min if d_min is not None else F.least("height", "width") * 0.25).cast("double")
    owner = Window.partitionBy("owner_id")
    rows = partner_map(blocks, ring).withColumn("_d", F.sqrt(squared_distance(F.col("idx"), F.col("holder")))).withColumn("_wanted", wanted)
    rows = rows.withColumn("_least", F.min("_d").over(owner))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_RELAXATIONS + 1)), F.lit(0),
        lambda n, _: F.when(F.col("_wanted") * F.pow(F.lit(0.5), n) > F.col("_least"), n + 1).otherwise(n),
    )
    failed = F.concat(F.col("owner_id"), F.lit(": partners stay too close"))
    rows = rows.withColumn("relaxations", steps).withColumn("relaxations", F.when(F.col("relaxations") > MAX_RELAXATIONS, F.raise_error(failed).cast("int")).otherwise(F.col("relaxations")))
    rows = rows.withColumn("d_min", F.col("_wanted") * F.pow(F.lit(0.5), "relaxations"))
    return rows.select("owner_id", "idx", "holder", "carries", "d_min", "relaxations", F.count_if(F.col("_d") < F.col("d_min")).over(owner).alias("violations"))
