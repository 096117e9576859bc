import pytest
from pyspark.sql import functions as F

from conftest import make_blocks
from tesserae.functions import backup, pixels
from tesserae.operators import inject, partner, repair, seal, separation, verify
from tesserae.session import materialize

PICTURES = {
    "smooth": lambda ch, i: [(i + p + 10 * ch) % 256 for p in range(64)],
    "black": lambda ch, i: [0] * 64,
    "white": lambda ch, i: [255] * 64,
    "checker": lambda ch, i: [255 * ((p // 8 + p) % 2) for p in range(64)],
    "busy": lambda ch, i: [(7919 * (p + 64 * i + ch)) % 251 for p in range(64)],
}


@pytest.mark.parametrize("variant", ["A", "B", "C"])
def test_intact_copies_raise_no_flag(spark, ring, variant):
    """Null condition on hard pictures, grey and colour, judged on the raw mask."""
    out = None
    for name, px in PICTURES.items():
        for channels in (1, 3):
            b = make_blocks(spark, 4, 4, px, channels, owner=f"{name}{channels}", key_id=channels)
            out = b if out is None else out.unionByName(b)
    s = materialize(seal.seal(out, ring, variant))
    checked = verify.check_tags(seal.as_received(s), ring, variant)
    assert checked.filter("mismatch").count() == 0
    assert seal.seal_summary(s).filter("msb_changed > 0").count() == 0


@pytest.mark.parametrize("variant", ["A", "B"])
def test_small_blocks(spark, ring, blocks, variant):
    from tesserae.sources.carriers import split_blocks

    s = seal.seal(split_blocks(blocks), ring, variant, 4)
    assert verify.check_tags(seal.as_received(s), ring, variant, 4).filter("mismatch").count() == 0


def test_direction_canary(spark, ring, blocks):
    """Swapping the two map directions leaves every tag valid, so it is checked on its own."""
    s = materialize(seal.seal(blocks, ring, "B"))
    checked = verify.check_tags(seal.as_received(s), ring, "B")
    back = partner.with_neighbours(checked, ring, ["idx", "stored_desc"])
    both = back.join(s.select("owner_id", "ch", "idx", "desc"), ["owner_id", "ch", "idx"])
    assert both.filter("next_stored_desc <> desc").count() == 0
    assert both.filter("prev_stored_desc = desc").count() < both.count()


def test_every_bound_field_matters(spark, ring, blocks):
    """One changed field at a time must break every tag of the picture."""
    s = materialize(seal.as_received(seal.seal(blocks, ring, "B")))
    n = s.count()
    changes = {
        "height": F.col("height") + 8, "width": F.col("width") + 8, "ch": F.col("ch") + 1, "idx": F.col("idx") + 1,
        "owner_id": F.concat("owner_id", F.lit("x")), "key_id": ((F.col("key_id") + 1) % 5).cast("int"),
        "px": F.transform("px", lambda v, i: F.when(i == 63, v.bitwiseXOR(4)).otherwise(v)),
    }
    for name, value in changes.items():
        assert verify.check_tags(s.withColumn(name, value), ring, "B").filter("mismatch").count() == n, name
    assert verify.check_tags(s, ring, "A").filter("mismatch").count() == n
    backup_bit = s.withColumn("px", F.transform("px", lambda v, i: F.when(i == 40, v.bitwiseXOR(1)).otherwise(v)))
    assert verify.check_tags(backup_bit, ring, "B").filter("mismatch").count() == n


def test_aligned_wipe_flags_exactly_its_blocks(spark, ring):
    b = make_blocks(spark, 16, 16, PICTURES["busy"])
    s = seal.as_received(seal.seal(b, ring, "A"))
    inside = (F.col("r") >= 4) & (F.col("r") < 8) & (F.col("c") >= 4) & (F.col("c") < 8)
    wiped = s.withColumn("px", F.when(inside, F.transform("px", lambda v: F.lit(0))).otherwise(F.col("px")))
    mask = verify.localize(verify.check_tags(wiped, ring, "A"))
    assert mask.filter("flagged").count() == 16
    assert mask.filter(F.col("flagged") & ~inside).count() == 0


def test_repair_marks_and_never_reverifies(spark, ring, blocks):
    s = seal.as_received(seal.seal(blocks, ring, "B"))
    dmg = inject.inject_noise(s, F.lit("0.25"))
    checked = materialize(verify.check_tags(dmg, ring, "B"))
    state = verify.with_partner_state(checked, verify.localize(checked), ring)
    rep = materialize(repair.repair(state, "B"))
    assert rep.filter("NOT flagged AND px_repaired <> px").count() == 0
    assert rep.filter("unrecoverable AND exists(px_repaired, v -> v <> 0)").count() == 0
    assert rep.filter("recoverable").count() > 0
    again = verify.check_tags(
        rep.select(*dmg.columns, "recoverable", "px_repaired").withColumn("px", F.col("px_repaired")), ring, "B"
    )
    assert again.filter("recoverable AND NOT mismatch").count() == 0


def test_repair_with_variant_c(spark, ring, blocks):
    s = seal.as_received(seal.seal(blocks, ring, "C"))
    checked = materialize(verify.check_tags(inject.inject_noise(s, F.lit("0.25")), ring, "C"))
    rep = repair.repair(verify.with_partner_state(checked, verify.localize(checked), ring), "C")
    assert rep.filter("recoverable AND size(px_repaired) = 64").count() == rep.filter("recoverable").count() > 0
    assert rep.filter("NOT flagged AND px_repaired <> px").count() == 0


def test_refinement_rules(spark):
    def mask(rows):
        n = len(rows[0])
        data = [("o", 0, len(rows) * 8, n * 8, 8, len(rows) * n, n, r * n + c, r, c, bool(v)) for r, line in enumerate(rows) for c, v in enumerate(line)]
        df = spark.createDataFrame(
            data, "owner_id string, key_id int, height bigint, width bigint, block int, k bigint, ncols bigint, idx bigint, r bigint, c bigint, raw boolean"
        )
        return {(x["r"], x["c"]): x for x in verify.refine(df).collect()}, {
            (x["r"], x["c"]): x["flagged"] for x in verify.refine(df, clear_isolated=True).collect()
        }

    hole = [[1] * 5 for _ in range(5)]
    hole[2][2] = 0
    kept, _ = mask(hole)
    assert kept[(2, 2)]["flagged"] and not kept[(2, 2)]["raw"]
    corner = [[1] * 5 for _ in range(5)]
    corner[0][0] = 0
    kept, _ = mask(corner)
    assert kept[(0, 0)]["flagged"] and kept[(0, 0)]["nvalid"] == 3 and kept[(0, 0)]["needed"] == 3
    assert kept[(0, 2)]["needed"] == 5 and kept[(2, 2)]["needed"] == 7
    alone = [[0] * 5 for _ in range(5)]
    alone[2][2] = 1
    kept, cleared = mask(alone)
    assert kept[(2, 2)]["flagged"] and not cleared[(2, 2)]
    assert sum(x["flagged"] for x in kept.values()) == 1


def one_cycle(pairs):
    nxt = dict(pairs)
    assert sorted(nxt.values()) == sorted(nxt)
    at, seen = next(iter(nxt)), 0
    while True:
        at, seen = nxt[at], seen + 1
        if at == next(iter(nxt)):
            return seen == len(nxt)


def test_plain_map_is_one_cycle(spark, ring, blocks):
    rows = partner.partner_map(blocks, ring).collect()
    for owner in {r["owner_id"] for r in rows}:
        mine = [r for r in rows if r["owner_id"] == owner]
        assert one_cycle([(r["idx"], r["holder"]) for r in mine])
        holder = {r["idx"]: r["holder"] for r in mine}
        assert all(holder[r["carries"]] == r["idx"] for r in mine)


@pytest.mark.parametrize("shape", [(64, 64), (48, 64), (3, 3), (1, 2), (1, 3), (5, 5), (7, 3), (2, 9), (13, 17), (1, 40), (6, 6)])
def test_separated_map(spark, ring, shape):
    nrows, ncols = shape
    b = make_blocks(spark, nrows, ncols, lambda ch, i: [0] * 64)
    rows = separation.separated_map(b, ring).collect()
    assert one_cycle([(r["idx"], r["holder"]) for r in rows])
    assert {(r["violations"], r["relaxations"]) for r in rows} == {(0, 0)}
    limit = rows[0]["d_min"]
    assert limit == min(shape) * 8 / 4
    for r in rows:
        dy, dx = (r["idx"] // ncols - r["holder"] // ncols) * 8, (r["idx"] % ncols - r["holder"] % ncols) * 8
        assert dy * dy + dx * dx >= limit * limit


def test_separated_map_relaxes(spark, ring):
    b = make_blocks(spark, 8, 8, lambda ch, i: [0] * 64)
    rows = separation.separated_map(b, ring, F.lit(10000.0)).collect()
    assert rows[0]["relaxations"] > 0 and rows[0]["violations"] == 0 and rows[0]["d_min"] < 10000


def test_every_size_has_one_wide_cycle(spark, ring):
    """All sizes up to 40 blocks in a row: one cycle whose edges span a quarter of it."""
    rows = []
    for k in range(2, 41):
        rows += [(f"o{k}", 0, 8, k * 8, 8, k, k, 0, i, 0, i) for i in range(k)]
    df = spark.createDataFrame(rows, "owner_id string, key_id int, height bigint, width bigint, block int, k bigint, ncols bigint, ch int, idx bigint, r bigint, c bigint")
    pairs = {}
    for r in partner.partner_map(df, ring).collect():
        pairs.setdefault(r["k"], []).append((r["idx"], r["holder"]))
        assert abs(r["idx"] - r["holder"]) * 4 >= r["k"]
    assert all(len(p) == k and one_cycle(p) for k, p in pairs.items()) and len(pairs) == 39


def test_one_block_has_no_partner(spark, ring):
    with pytest.raises(Exception, match="partners stay too close"):
        separation.separated_map(make_blocks(spark, 1, 1, lambda ch, i: [0] * 64), ring).collect()


def test_incomplete_owners_have_no_partners(spark, ring):
    b = make_blocks(spark, 4, 4, lambda ch, i: [i] * 64)
    s = seal.as_received(seal.seal(b, ring, "B")).filter("idx <> 5").withColumn("px", F.when(F.col("idx") == 3, F.array_repeat(F.lit(7), 64)).otherwise(F.col("px")))
    checked = materialize(verify.check_tags(s, ring, "B"))
    state = verify.with_partner_state(checked, verify.localize(checked), ring)
    assert {(r.idx, r.recoverable, r.unrecoverable) for r in state.filter("flagged").collect()} == {(3, False, True)}
    assert seal.seal(b.filter("idx <> 5"), ring, "B").count() == 0


def test_seal_with_separated_map(spark, ring, blocks):
    pairs = materialize(separation.separated_map(blocks, ring))
    s = materialize(seal.seal(blocks, ring, "B", pairs=pairs))
    checked = materialize(verify.check_tags(inject.inject_noise(seal.as_received(s), F.lit("0.25")), ring, "B"))
    mask = verify.localize(checked)
    state = verify.with_partner_state(checked, mask, ring, pairs=pairs)
    wrong = state.join(s.select("owner_id", "ch", "idx", "desc"), ["owner_id", "ch", "idx"]).filter(
        "recoverable AND own_desc <> desc"
    )
    assert state.filter("recoverable").count() > 0 and wrong.count() == 0


def test_bit_order_of_payload(spark):
    df = spark.createDataFrame([(list(range(64)), bytes(range(16)))], "px array<int>, data binary")
    out = df.select(pixels.with_payload(F.col("px"), F.col("data")).alias("px")).first()["px"]
    bits = "".join(f"{b:08b}" for b in range(16))
    assert [v & 3 for v in out] == [int(bits[2 * i:2 * i + 2], 2) for i in range(64)]
    assert [v & 252 for v in out] == [v & 252 for v in range(64)]


def test_backup_ranges(spark):
    """Extremes never clip in variant A; C keeps the better of its two tables."""
    rows = [([v] * 64,) for v in (0, 252, 128)] + [([252 * ((p // 8 + p) % 2) for p in range(64)],)]
    df = spark.createDataFrame(rows, "px array<int>")
    coef = df.withColumn("c", backup.dct("px"))
    steps = F.array(*[F.lit(float(s)) for s in backup.STEPS_A[:12]])
    raw = coef.select(F.explode(F.zip_with(F.slice("c", 1, 12), steps, lambda c, s: backup.half_even(c / s))).alias("q"))
    assert raw.filter("q < -128 OR q > 127").count() == 0
    stored = materialize(backup.encode_c(df, "px", "d"))   # encoding and decoding are separate jobs
    c = stored.withColumn("back", backup.decode_c(F.col("d")))
    err = pixels.squared_error(F.col("back"), F.col("px"))
    assert c.filter(err != F.least("d_err0", "d_err1")).count() == 0
    assert all(sum(w) == 95 for w in backup.WIDTHS_C)
    with pytest.raises(ValueError):
        backup.check_variant("C", 4)


def test_attacks(spark, ring, blocks):
    s = materialize(seal.as_received(seal.seal(blocks, ring, "B")))
    flips = verify.check_tags(inject.inject_bitflip(s), ring, "B")
    assert flips.filter("exists(truth_px, t -> t) <> mismatch").count() == 0
    moved = inject.transplant(s, inject.nearest_block(s))
    assert verify.check_tags(moved, ring, "B").filter("exists(truth_px, t -> t) AND NOT mismatch AND px <> px_before").count() == 0


@pytest.mark.parametrize("cls", ["splice", "blob", "refill", "noise", "scatter"])
def test_damage_stays_inside_its_truth(spark, ring, blocks, cls):
    s = materialize(seal.as_received(seal.seal(blocks, ring, "B")))
    ratio = F.lit("0.25")
    dmg = {
        "splice": lambda: inject.inject_splice(s, inject.splice_sources(s), s, ratio), "blob": lambda: inject.inject_blob(s, ratio),
        "refill": lambda: inject.inject_refill(s, ratio), "noise": lambda: inject.inject_noise(s, ratio),
        "scatter": lambda: inject.inject_scatter(s, ratio),
    }[cls]()
    dmg = materialize(dmg.select("owner_id", "ch", "idx", "px", "px_before", "truth_px"))
    assert dmg.count() == s.count()
    outside = F.exists(F.arrays_zip("px", "px_before", "truth_px"), lambda z: ~z["truth_px"] & (z["px"] != z["px_before"]))
    assert dmg.filter(outside).count() == 0
    assert dmg.filter("px <> px_before").count() > 0
    assert dmg.filter("exists(px, v -> v < 0 OR v > 255)").count() == 0


def test_absent_blocks_are_restored_and_counted(spark, ring, blocks):
    from tesserae.operators import score

    stored = materialize(seal.as_received(seal.seal(blocks, ring, "A")))
    received = stored.filter("idx NOT IN (0, 7)")
    mask = verify.localize(verify.check_tags(received, ring, "A"))
    fixed = repair.restore(received, mask, stored)
    assert fixed.count() == stored.count() and fixed.filter("differs").count() == 0
    assert {r.idx for r in fixed.filter("flagged").select("idx").distinct().collect()} == {0, 7}
    owners = stored.select("owner_id").distinct().count()
    seen = score.truth_compare(stored, received, mask).agg(F.sum("changed_blocks"), F.sum("changed_px"), F.count("*")).first()
    assert tuple(seen) == (2 * owners, 2 * owners * 64, owners)
