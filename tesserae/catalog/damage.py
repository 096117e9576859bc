"""Queries that inject labelled damage and attacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import derive_seed, uniform
from ..functions.pixels import to_bytes
from ..operators import inject, partner, repair, seal, verify
from ..sources import carriers
from ..sources.keyring import keyring
from . import sqlkit as S
from .registry import big, query, r6, sql_r6
from .sqlkit import Sql

KEYS = "owner_id, " + big("ch", "idx")
OUT_SQL = f"{KEYS}, len(list_filter(truth_px, lambda tt: tt))::BIGINT AS hit, hex({S.to_bytes('px')}) AS px_hex"
RATIO = "0.25"


def sealed(spark, d, channels=1):
    ncols = 6 if channels == 1 else 4
    ring = keyring(spark)
    return ring, seal.as_received(seal.seal(carriers.vector_blocks(spark, d, channels, ncols), ring, "B"))


def sealed_sql(channels: int = 1) -> Sql:
    return Sql().keyring().vectors("fa", channels, 6 if channels == 1 else 4).seal("fa", "sealed", "B").received("sealed", "rcv")


def shown(df):
    hit = F.size(F.filter("truth_px", lambda t: t)).cast("bigint")
    return df.select("owner_id", "ch", "idx", hit.alias("hit"), F.hex(to_bytes(F.col("px"))).alias("px_hex"))


REGION = (
    sealed_sql().region("rcv", "g1", "'noise'", "'0.25'").noised("g1", "d1")
    .region("rcv", "g2", "'solid'", "'0.10'").add("d2", "SELECT * REPLACE (list_transform(range(64), lambda i: CASE WHEN truth_px[(i+1)::INT] THEN 0 ELSE px[(i+1)::INT] END) AS px) FROM g2")
    .preset("rcv", "g3", "corner", "0.10").noised("g3", "d3").preset("rcv", "g4", "middle", "0.10").noised("g4", "d4")
)


@query(
    "inject_region",
    REGION.select(" UNION ALL ".join(
        f"SELECT '{n}' AS kind, {OUT_SQL} FROM {t}" for n, t in (("noise", "d1"), ("solid", "d2"), ("corner", "d3"), ("middle", "d4"))
    )),
)
def inject_region(spark, d):
    """Rectangles of noise, of zeros, and the corner and middle presets."""
    _, s = sealed(spark, d)
    parts = {
        "noise": inject.inject_noise(s, F.lit("0.25")), "solid": inject.inject_solid(s, F.lit("0.10")),
        "corner": inject.inject_preset(s, "corner", F.lit("0.10")), "middle": inject.inject_preset(s, "middle", F.lit("0.10")),
    }
    out = None
    for kind, df in parts.items():
        one = shown(df).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("splice_source", Sql().vectors("fa").splice_sources("fa", "src").select("SELECT stem, height::BIGINT AS height, width::BIGINT AS width, owner_id, source_id FROM src"))
def splice_source(spark, d):
    """The next owner of equal shape, wrapping around."""
    return inject.splice_sources(carriers.vector_blocks(spark, d)).select("stem", "height", "width", "owner_id", "source_id")


@query(
    "inject_splice",
    sealed_sql().splice_sources("rcv", "src").spliced("rcv", "sp", "src", "rcv", "'0.25'").add("nosrc", "SELECT * REPLACE (NULL::VARCHAR AS source_id) FROM src")
    .spliced("rcv", "mi", "nosrc", "rcv", "'0.25'").select(f"SELECT 'other' AS source, {OUT_SQL} FROM sp UNION ALL SELECT 'mirror', {OUT_SQL} FROM mi"),
)
def inject_splice(spark, d):
    """A rectangle from another sealed owner, and from the mirrored owner itself."""
    _, s = sealed(spark, d)
    sources = inject.splice_sources(s)
    alone = sources.withColumn("source_id", F.lit(None).cast("string"))
    a = shown(inject.inject_splice(s, sources, s, F.lit(RATIO))).withColumn("source", F.lit("other"))
    b = shown(inject.inject_splice(s, alone, s, F.lit(RATIO))).withColumn("source", F.lit("mirror"))
    return a.unionByName(b)


@query("inject_refill", sealed_sql(3).refilled("rcv", "rf", "'0.25'").select(f"SELECT {OUT_SQL} FROM rf"))
def inject_refill(spark, d):
    """Synthetic filling matched to the mean and spread around it, per channel."""
    return shown(inject.inject_refill(sealed(spark, d, 3)[1], F.lit(RATIO)))


@query("inject_blob", sealed_sql().blobbed("rcv", "bl", "'0.25'").select(f"SELECT {OUT_SQL} FROM bl"))
def inject_blob(spark, d):
    """A union of discs removed and filled from its sides."""
    return shown(inject.inject_blob(sealed(spark, d)[1], F.lit(RATIO)))


def _scatter_sql() -> Sql:
    q = sealed_sql().add("sc_s", f"SELECT *, {S.seed(repr('20260811'), 'stem', repr('scatter'), repr('0.10'))} AS seed FROM rcv")
    at = lambda axis, limit: f"floor({S.fraction(f'sha256(seed::VARCHAR || chr(124) || {axis!r} || chr(124) || i)')} * ({limit} - 7))::BIGINT"
    q.add(
        "sc_p",
        f"SELECT owner_id, {at('py', 'height')} AS py, {at('px', 'width')} AS px0 FROM (SELECT *, unnest(range(1, ceil(0.10::DOUBLE * height * width / 64)::BIGINT + 1)) AS i "
        "FROM sc_s WHERE idx = 0 AND ch = 0)",
    )
    q.add(
        "sc_t",
        "SELECT s.owner_id, s.ch, s.idx, list(DISTINCT struct_pack(py := p.py, px0 := p.px0)) AS ps FROM sc_s s JOIN sc_p p ON s.owner_id = p.owner_id "
        "AND p.py < s.r * 8 + 8 AND p.py + 8 > s.r * 8 AND p.px0 < s.c * 8 + 8 AND p.px0 + 8 > s.c * 8 GROUP BY ALL",
    )
    q.add(
        "sc_g",
        "SELECT s.*, list_transform(range(64), lambda p: len(list_filter(coalesce(ps, []), lambda o: r * 8 + p // 8 >= o.py AND r * 8 + p // 8 < o.py + 8 "
        "AND c * 8 + p % 8 >= o.px0 AND c * 8 + p % 8 < o.px0 + 8)) > 0) AS truth_px FROM sc_s s LEFT JOIN sc_t USING (owner_id, ch, idx)",
    )
    return q.noised("sc_g", "sc")


@query("inject_scatter", _scatter_sql().select(f"SELECT {OUT_SQL} FROM sc"))
def inject_scatter(spark, d):
    """Many small patches of noise."""
    return shown(inject.inject_scatter(sealed(spark, d)[1], F.lit("0.10")))


def _bitflip_sql() -> Sql:
    q = sealed_sql().add("bf_s", f"SELECT *, {S.seed(repr('20260811'), 'stem', repr('bitflip'), repr('0.2'))} AS seed FROM rcv")
    q.add("bf_h", "SELECT *, sha256(seed::VARCHAR || '|' || idx) AS h FROM bf_s")
    q.add(
        "bf_c",
        f"SELECT a.owner_id, a.idx FROM bf_h a JOIN bf_h b ON a.owner_id = b.owner_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 "
        f"GROUP BY a.owner_id, a.idx, a.h HAVING a.h = min(b.h) AND {S.fraction('a.h')} < 0.2",
    )
    return q.add(
        "bf",
        "SELECT s.* REPLACE (list_transform(px, lambda v, i: CASE WHEN hit AND i = 37 THEN xor(v, 4) ELSE v END) AS px), list_transform(range(64), lambda p: hit AND p = 36) AS truth_px "
        "FROM (SELECT a.*, c.idx IS NOT NULL AND a.ch = 0 AS hit FROM bf_s a LEFT JOIN bf_c c USING (owner_id, idx)) s",
    )


@query("inject_bitflip", _bitflip_sql().check("bf", "chk", "B").select(f"SELECT {OUT_SQL}, mismatch FROM chk"))
def inject_bitflip(spark, d):
    """One flipped bit in mutually isolated blocks; each is detected."""
    ring, s = sealed(spark, d)
    checked = verify.check_tags(inject.inject_bitflip(s), ring, "B")
    hit = F.size(F.filter("truth_px", lambda t: t)).cast("bigint")
    return checked.select("owner_id", "ch", "idx", hit.alias("hit"), F.hex(to_bytes(F.col("px"))).alias("px_hex"), "mismatch")


CLASSES = ("splice", "inpaint_removal", "crop_refill", "noise")
RATIOS = ("0.10", "0.25", "0.50")


def _summary_sql() -> str:
    q = sealed_sql(3).splice_sources("rcv", "src")
    rows = []
    for i, ratio in enumerate(RATIOS):
        lit = repr(ratio)
        q.spliced("rcv", f"sp{i}", "src", "rcv", lit).blobbed("rcv", f"bl{i}", lit).refilled("rcv", f"rf{i}", lit)
        q.region("rcv", f"ng{i}", "'noise'", lit).noised(f"ng{i}", f"no{i}")
        for cls, t in zip(CLASSES, (f"sp{i}", f"bl{i}", f"rf{i}", f"no{i}")):
            q.damage_summary(t, f"{t}_z")
            rows.append(
                f"SELECT owner_id, '{cls}' AS tamper_class, '{ratio}' AS nominal, n_px, n_region_px, n_coincidental_px, {sql_r6('n_region_px / n_px', 'achieved_ratio')} FROM {t}_z"
            )
    return q.select(" UNION ALL ".join(rows))


@query("inject_summary", _summary_sql())
def inject_summary(spark, d):
    """Achieved share and coincidentally unchanged pixels for every class and nominal share."""
    _, s = sealed(spark, d, 3)
    sources = inject.splice_sources(s)
    # one plan per class over all nominal shares, instead of one per class and share
    shares = s.withColumn("nominal", F.explode(F.array(*[F.lit(r) for r in RATIOS])))
    keys, ratio = ["nominal", "owner_id"], F.col("nominal")
    parts = {
        "splice": inject.inject_splice(shares, sources, s, ratio, keys), "inpaint_removal": inject.inject_blob(shares, ratio, keys),
        "crop_refill": inject.inject_refill(shares, ratio, keys), "noise": inject.inject_noise(shares, ratio),
    }
    out = None
    for cls, df in parts.items():
        one = inject.damage_summary(df, keys).withColumn("tamper_class", F.lit(cls))
        out = one if out is None else out.unionByName(one)
    return out.select(
        "owner_id", "tamper_class", "nominal", "n_px", "n_region_px", "n_coincidental_px", r6(F.col("achieved_ratio"), "achieved_ratio")
    )


def _nearest_sql(q: Sql) -> Sql:
    dst = "(k // ncols // 2) * ncols + ncols // 2"
    q.add("nb_s", f"SELECT owner_id, idx, {dst} AS dst, list_sum(px) AS total FROM rcv WHERE ch = 0")
    return q.add(
        "nb",
        "SELECT owner_id, dst, src, diff FROM (SELECT a.owner_id, a.dst, a.idx AS src, abs(a.total - b.total) AS diff, row_number() OVER "
        "(PARTITION BY a.owner_id ORDER BY abs(a.total - b.total), a.idx) AS rn FROM nb_s a JOIN nb_s b ON a.owner_id = b.owner_id AND b.idx = b.dst WHERE a.idx <> a.dst) WHERE rn = 1",
    )


@query("nearest_block", _nearest_sql(sealed_sql()).select(f"SELECT owner_id, {big('dst', 'src', 'diff')} FROM nb"))
def nearest_block(spark, d):
    """The block closest in mean to the centre block."""
    return inject.nearest_block(sealed(spark, d)[1])


@query(
    "nearest_blocks",
    sealed_sql().add("tot", "SELECT owner_id, idx, list_sum(px)::BIGINT AS total FROM rcv WHERE ch = 0").select(
        "SELECT owner_id, dst::BIGINT AS dst, b.src::BIGINT AS src, b.diff::BIGINT AS diff FROM (SELECT a.owner_id, a.idx AS dst, min(struct_pack(diff := abs(a.total - o.total), src := o.idx)) AS b "
        "FROM tot a JOIN tot o ON a.owner_id = o.owner_id AND a.idx <> o.idx GROUP BY ALL)"
    ),
)
def nearest_blocks(spark, d):
    """The block closest in mean to each block; the oracle compares all pairs."""
    return inject.nearest_other(sealed(spark, d)[1])


REGIONS = 1000
_unit = lambda name: S.uniform("seed", name)


@query(
    "regions_cover",
    Sql().vectors("fa").add("ow", "SELECT DISTINCT owner_id, height, width FROM fa").add(
        "sd", f"SELECT *, {S.seed('owner_id', 'i::VARCHAR')} AS seed FROM (SELECT *, unnest(range({REGIONS})) AS i FROM ow)",
    ).add(
        "rg",
        f"SELECT owner_id, y0, x0, y0 + 1 + floor({_unit('h')} * {_unit('h')} * height / 4)::BIGINT AS y1, x0 + 1 + floor({_unit('w')} * {_unit('w')} * width / 4)::BIGINT AS x1 FROM "
        f"(SELECT *, floor({_unit('y')} * (height + 8))::BIGINT - 4 AS y0, floor({_unit('x')} * (width + 8))::BIGINT - 4 AS x0 FROM sd)",
    ).add("px", "SELECT owner_id, idx, r * 8 + p // 8 AS y, c * 8 + p % 8 AS x FROM (SELECT *, unnest(range(64)) AS p FROM fa)").select(
        "SELECT owner_id, idx::BIGINT AS idx, n_regions, covered FROM (SELECT f.owner_id, f.idx, count(*)::BIGINT AS n_regions FROM fa f JOIN rg g ON f.owner_id = g.owner_id AND g.y0 < f.r * 8 + 8 AND g.y1 > f.r * 8 "
        "AND g.x0 < f.c * 8 + 8 AND g.x1 > f.c * 8 GROUP BY ALL) JOIN (SELECT owner_id, idx, count(DISTINCT (y, x))::BIGINT AS covered FROM px JOIN rg USING (owner_id) WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL) USING (owner_id, idx)"
    ),
)
def regions_cover(spark, d):
    """A thousand rectangles an owner: how many touch each block, and how many of its pixels lie in any."""
    blocks = carriers.vector_blocks(spark, d)
    owners = blocks.filter("idx = 0 AND ch = 0").select("owner_id", "height", "width", F.explode(F.sequence(F.lit(0), F.lit(REGIONS - 1))).alias("i"))
    seeded = owners.withColumn("seed", derive_seed(F.col("owner_id"), F.col("i")))
    unit = lambda name: uniform(F.col("seed"), name)
    side = lambda name, of: (F.floor(unit(name) * unit(name) * F.col(of) / 4) + 1).cast("bigint")
    at = seeded.withColumn("y0", F.floor(unit("y") * (F.col("height") + 8)) - 4).withColumn("x0", F.floor(unit("x") * (F.col("width") + 8)) - 4)
    regions = at.withColumn("y1", F.col("y0") + side("h", "height")).withColumn("x1", F.col("x0") + side("w", "width"))
    return inject.regions_cover(blocks, regions).select("owner_id", "idx", "n_regions", F.bit_count("mask").cast("bigint").alias("covered"))


@query(
    "attack_transplant",
    _nearest_sql(sealed_sql()).add(
        "tp", "SELECT r.* REPLACE (coalesce(m.px, r.px) AS px) FROM rcv r LEFT JOIN (SELECT n.owner_id, n.dst AS idx, b.ch, b.px FROM nb n JOIN rcv b ON n.owner_id = b.owner_id AND n.src = b.idx) m USING (owner_id, ch, idx)"
    ).check("tp", "chk", "B").localize("chk", "mask").select(
        "SELECT m.owner_id, n.dst::BIGINT AS dst, n.src::BIGINT AS src, bool_or(m.idx = n.dst AND m.raw) AS fired, bool_or(m.idx = n.dst AND m.flagged) AS survives_refinement, "
        "count_if(m.raw)::BIGINT AS raw_flagged FROM mask m JOIN nb n USING (owner_id) GROUP BY ALL"
    ),
)
def attack_transplant(spark, d):
    """A block with a genuine tag copied to another place; the tag binds the place, so it is flagged."""
    ring, s = sealed(spark, d)
    moves = inject.nearest_block(s)
    mask = verify.localize(verify.check_tags(inject.transplant(s, moves), ring, "B"))
    at = F.col("idx") == F.col("dst")
    return mask.join(moves.drop("diff"), "owner_id").groupBy("owner_id", "dst", "src").agg(
        F.bool_or(at & F.col("raw")).alias("fired"), F.bool_or(at & F.col("flagged")).alias("survives_refinement"),
        F.count_if("raw").alias("raw_flagged"),
    )


@query(
    "attack_coincidence",
    sealed_sql().add("tg", "SELECT DISTINCT owner_id, (k // ncols // 2) * ncols + ncols // 2 AS idx FROM rcv").add(
        "tgs", "SELECT owner_id, idx FROM tg UNION ALL SELECT owner_id, holder FROM tg JOIN (SELECT owner_id, idx, holder FROM sealed_map) USING (owner_id, idx)"
    ).add("hit", f"SELECT r.*, {S.seed(repr('20260811'), 'stem', repr('coincidence'), repr('0'))} AS seed, list_transform(range(64), lambda p: t.idx IS NOT NULL) AS truth_px FROM rcv r LEFT JOIN tgs t USING (owner_id, idx)")
    .noised("hit", "dmg").check("dmg", "chk", "B").localize("chk", "mask", refined=False).state("chk", "mask", "sealed_map", "st").repaired("st", "rep", "B").select(
        f"SELECT owner_id, count_if(flagged)::BIGINT AS flagged, count_if(recoverable)::BIGINT AS recovered, count_if(unrecoverable)::BIGINT AS unrecoverable, "
        f"bool_or(unrecoverable AND idx = (k // ncols // 2) * ncols + ncols // 2) AS target_unrecoverable, "
        f"count_if(unrecoverable AND list_sum(px_repaired) = 0)::BIGINT AS marked FROM rep GROUP BY owner_id"
    ),
)
def attack_coincidence(spark, d):
    """A block and its holder destroyed together: reported as unrecoverable and marked, never invented."""
    ring, s = sealed(spark, d)
    pairs = partner.partner_map(s, ring).filter(F.col("idx") == inject.centre_block())
    targets = pairs.select("owner_id", "idx").unionByName(pairs.select("owner_id", F.col("holder").alias("idx")))
    checked = verify.check_tags(inject.destroy_blocks(s, targets), ring, "B")
    state = verify.with_partner_state(checked, verify.localize(checked, refined=False), ring)
    rep = repair.repair(state, "B")
    dark = F.forall("px_repaired", lambda v: v == 0)
    return rep.groupBy("owner_id").agg(
        F.count_if("flagged").alias("flagged"), F.count_if("recoverable").alias("recovered"),
        F.count_if("unrecoverable").alias("unrecoverable"),
        F.bool_or(F.col("unrecoverable") & (F.col("idx") == inject.centre_block())).alias("target_unrecoverable"),
        F.count_if(F.col("unrecoverable") & dark).alias("marked"),
    )
