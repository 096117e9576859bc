from pyspark.sql import functions as F

from tesserae.functions.backup import decode, with_backup
from tesserae.operators import inject, score, verify
from tesserae.session import materialize

from conftest import make_blocks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_pixel_is_computed_by_an_interpreted_lambda(spark, blocks, ring):
    """The run table took 6 ms of a core for each block row, nearly all of it in array lambdas."""
    ratio = F.lit("0.25")
    damaged = [inject.inject_noise(blocks, ratio), inject.inject_refill(blocks, ratio), inject.inject_splice(blocks, inject.splice_sources(blocks), blocks, ratio)]
    sealed = [verify.check_tags(blocks, ring, "A"), with_backup(blocks, "A", 8), with_backup(blocks, "B", 8)]
    for df in [*damaged, *sealed, score.ssim(blocks, ["owner_id"], "px", "px")]:
        assert "lambdafunction" not in plan_of(df)


def test_discs_are_measured_without_rows_of_blocks(spark, blocks):
    assert "Generate" not in plan_of(inject.blob_discs(blocks, F.lit("0.25")))


def test_discs_cover_what_their_blocks_cover(spark, blocks):
    discs = materialize(inject.blob_discs(blocks, F.lit("0.25")))
    damaged = inject.inject_blob(blocks, F.lit("0.25"))
    hit = {r.owner_id: r.n for r in damaged.groupBy("owner_id").agg(F.sum(F.size(F.filter("truth_px", lambda t: t))).alias("n")).collect()}
    size = {r.owner_id: (r.height, r.width) for r in blocks.select("owner_id", "height", "width").distinct().collect()}
    for r in discs.collect():
        h, w = size[r.owner_id]
        assert hit[r.owner_id] == sum(any((y - d.y) ** 2 + (x - d.x) ** 2 <= r._ri ** 2 for d in r._discs) for y in range(h) for x in range(w))


def test_blocks_without_whole_pixels_do_not_verify(spark, ring):
    good = make_blocks(spark, 2, 2, lambda ch, i: [i] * 64)
    bad = good.withColumn("px", F.when(F.col("idx") == 0, F.lit(None)).when(F.col("idx") == 1, F.transform("px", lambda v, i: F.when(i > 0, v)))
                          .when(F.col("idx") == 2, F.slice("px", 1, 63)).otherwise(F.col("px")))
    rows = {r.idx: r for r in verify.check_tags(materialize(bad), ring, "A").collect()}
    assert len(rows) == 4 and all(rows[i].mismatch for i in (0, 1, 2)) and rows[3].fresh_tag is not None


def test_sides_of_both_kinds_in_one_batch(spark):
    both = make_blocks(spark, 2, 2, lambda ch, i: range(64)).unionByName(make_blocks(spark, 2, 2, lambda ch, i: range(16), block=4, owner="small"))
    out = inject.inject_noise(both.coalesce(1), F.lit("0.50")).collect()
    assert {len(r.px) for r in out} == {64, 16} and all(len(r.px) == len(r.truth_px) for r in out)
    assert all(a == b for r in out for a, b, t in zip(r.px, r.px_before, r.truth_px) if not t)


def test_backups_give_null_for_null(spark):
    rows = make_blocks(spark, 1, 2, lambda ch, i: [100] * 64)
    for variant in "AB":
        stored = materialize(with_backup(rows.withColumn("px", F.when(F.col("idx") == 0, F.col("px"))), variant, 8))
        found = {r.idx: r.px for r in stored.select("idx", decode(F.col("desc"), variant, 8).alias("px")).collect()}
        assert found[1] is None and len(found[0]) == 64 and all(abs(v - 100) <= 4 for v in found[0])


def test_variant_c_needs_one_python_worker_a_task(spark, blocks):
    """Five chained functions kept five workers a core, and their memory, alive at once."""
    from tesserae.functions.backup import encode_c

    plan = plan_of(encode_c(blocks.withColumn("m", F.col("px")), "m", "desc"))
    assert plan.count("EvalPython") == 1
