"""Queries over the evaluation grid: planning, scoring, gate, reports, rate fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inject, partner, ratefit, score, separation, verify
from ..functions.pixels import to_bytes
from ..plans import gate, grid, reports, retain, runlog
from ..session import checkpoint_dir, materialize, scratch
from ..sources import carriers
from ..sources.keyring import keyring
from ..sources.tables import table
from . import sqlkit as S
from .registry import big, query, r6, sql_r6
from .scores import sql_scores
from .sqlkit import Sql

_written: dict[tuple[str, str], str] = {}


def _fingerprint(spark, d) -> str:
    """Names, sizes and times of the embeddings' files: another table has another one, whatever its path."""
    files = table(spark, d, "embeddings").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    listed = files.select(F.sha2(F.concat_ws("|", "file_path", "file_size", "file_modification_time"), 256).alias("h"))
    return listed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]


def run_rows(spark, d):
    """The run table of a folder, computed once for the files it holds and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, _fingerprint(spark, d))
    if key not in _written:
        path = f"{checkpoint_dir(spark).rstrip('/')}/tesserae-runs-{key[0]}-{key[1][:16]}"
        grid.run_table(carriers.vector_blocks(spark, d), keyring(spark)).write.mode("overwrite").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


# -- SQL of the grid ---------------------------------------------------------

def cells_sql(q: Sql) -> Sql:
    q.add("own", "SELECT DISTINCT stem, height, width, CASE WHEN label % 4 = 0 THEN 'subset' ELSE 'rest' END AS dataset FROM fa")
    hit = "(VALUES ('splice'), ('inpaint_removal'), ('crop_refill'), ('noise')) a(tamper_class), (VALUES ('0.10'), ('0.25'), ('0.50')) b(nominal)"
    q.add(
        "cell0",
        f"SELECT own.*, 'tamper' AS condition, tamper_class, nominal, variant, 8 AS block_size, 0 AS run_key FROM own, {hit}, (VALUES ('A'), ('B')) v(variant) "
        f"UNION ALL SELECT own.*, 'null', '', '', variant, 8, run_key FROM own, (VALUES ('A'), ('B')) v(variant), range(5) k(run_key) "
        f"UNION ALL SELECT own.*, 'tamper', tamper_class, nominal, 'A', 4, 0 FROM own, {hit} WHERE dataset = 'subset'",
    )
    return q.add(
        "cells",
        "SELECT *, substr(sha256(stem || '|' || condition || '|' || tamper_class || '|' || nominal || '|' || variant || '|' || block_size || '|' || run_key), 1, 16) AS run_id, "
        "CASE WHEN condition = 'null' THEN 'null' WHEN block_size = 8 THEN 'main' ELSE 'ablation' END AS grp FROM cell0",
    )


def family_sql(q: Sql, src: str, n: str, variant: str, block: int) -> Sql:
    """Steps of one variant and block side; ends in {n}_rep and {n}_wm."""
    keys = "range(5)" if block == 8 else "range(1)"
    q.add(f"{n}_k", f"SELECT * REPLACE (kk AS key_id) FROM {src}, {keys} t(kk)")
    q.add(f"{n}_k2", f"SELECT * EXCLUDE (kk) FROM {n}_k")
    q.seal(f"{n}_k2", f"{n}_s", variant, block, keys="owner_id, key_id").ssim(f"{n}_s", f"{n}_like", "px", "px_sealed", keys="stem, key_id")
    q.add(
        f"{n}_wm",
        f"SELECT stem, key_id, '{variant}' AS variant, {block} AS block_size, {S.psnr('sq', 'np')} AS wm_psnr, ssim AS wm_ssim FROM "
        f"(SELECT stem, key_id, sum({S.sq_err('px', 'px_sealed')}) AS sq, sum(len(px)) AS np FROM {n}_s GROUP BY ALL) JOIN {n}_like USING (stem, key_id)",
    )
    q.received(f"{n}_s", f"{n}_r").splice_sources(src, f"{n}_src")
    q.add(
        f"{n}_c",
        f"SELECT r.* EXCLUDE (variant), c.run_id, c.tamper_class, c.nominal FROM {n}_r r JOIN (SELECT run_id, stem, run_key AS key_id, tamper_class, nominal FROM cells "
        f"WHERE variant = '{variant}' AND block_size = {block}) c USING (stem, key_id)",
    )
    for cls, t in (("splice", "sp"), ("inpaint_removal", "bl"), ("crop_refill", "rf"), ("noise", "no"), ("", "nu")):
        q.add(f"{n}_{t}0", f"SELECT * FROM {n}_c WHERE tamper_class = '{cls}'")
    q.spliced(f"{n}_sp0", f"{n}_sp", f"{n}_src", f"{n}_r", "nominal", keys="run_id, owner_id", same="key_id, ")
    q.blobbed(f"{n}_bl0", f"{n}_bl", "nominal", keys="run_id, owner_id")
    q.refilled(f"{n}_rf0", f"{n}_rf", "nominal", block, keys="run_id, owner_id")
    q.region(f"{n}_no0", f"{n}_nog", "'noise'", "nominal").noised(f"{n}_nog", f"{n}_no", block)
    q.add(f"{n}_nu", f"SELECT *, px AS px_before, list_transform(px, lambda v: FALSE) AS truth_px FROM {n}_nu0")
    cols = "owner_id, key_id, stem, label, page, height, width, block, k, ncols, ch, idx, r, c, px, run_id, truth_px, px_before"
    parts = ["sp", "bl", "rf", "no"] + (["nu"] if block == 8 else [])
    q.add(f"{n}_d", " UNION ALL ".join(f"SELECT {cols} FROM {n}_{t}" for t in parts))
    q.check(f"{n}_d", f"{n}_chk", variant, block).localize(f"{n}_chk", f"{n}_m", extra="run_id, ")
    q.state(f"{n}_chk", f"{n}_m", f"{n}_s_map", f"{n}_st", extra="run_id, ", map_keys="owner_id, key_id")
    return q.repaired(f"{n}_st", f"{n}_rep", variant, block, keys="run_id, ch, idx")


def _plain(value: str, name: str) -> str:
    return f"({value})::DOUBLE AS {name}"


LOC_ALL = lambda: ", ".join(sql_scores(p, lv, _plain) for p, lv in (("raw_block_", "raw"), ("block_", "block"), ("px_", "px")))


def runs_sql() -> Sql:
    q = cells_sql(Sql().keyring().vectors("fa"))
    q.add("fa_sub", "SELECT * FROM fa WHERE label % 4 = 0").split4("fa_sub", "f4")
    for src, n, v, b in (("fa", "a8", "A", 8), ("fa", "b8", "B", 8), ("f4", "a4", "A", 4)):
        family_sql(q, src, n, v, b)
    q.add(
        "rep",
        " UNION ALL ".join(
            f"SELECT run_id, ch, idx, r, c, height, width, block, px, px_before, px_repaired, truth_px, raw, flagged, recoverable, unrecoverable FROM {n}_rep"
            for n in ("a8", "b8", "a4")
        ),
    )
    q.add("wm", "SELECT * FROM a8_wm UNION ALL SELECT * FROM b8_wm UNION ALL SELECT * FROM a4_wm")
    q.confusion("rep", "cf", "run_id").fidelity_sums("rep", "fs", "run_id").damage_summary("rep", "ds", "run_id")
    q.ssim("rep", "ss", "px_before", "px_repaired", keys="run_id", truth="truth_px", keep="NOT unrecoverable")
    q.add(
        "rr",
        "SELECT run_id, CASE WHEN count_if(flagged) = 0 THEN 1.0 ELSE 1.0 - count_if(unrecoverable) / count_if(flagged) END AS recoverability_rate, count_if(flagged)::BIGINT AS n_tampered_blocks, "
        "count_if(unrecoverable)::BIGINT AS n_unrecoverable_blocks FROM rep WHERE ch = 0 GROUP BY run_id",
    )
    q.add(
        "mm",
        "SELECT run_id, count_if(t AND NOT f AND same)::BIGINT AS n_msb FROM (SELECT run_id, idx, bool_or(len(list_filter(truth_px, lambda z: z)) > 0) AS t, bool_or(flagged) AS f, "
        "bool_and(list_transform(px, lambda v: v & 252) = list_transform(px_before, lambda w: w & 252)) AS same FROM rep GROUP BY ALL) GROUP BY run_id",
    )
    achieved = "floor((n_region_px * 2000000 + n_px) / (n_px * 2))::BIGINT"
    return q.add(
        "runs",
        f"""SELECT c.run_id, c.condition, c.dataset, c.stem AS image_name, c.stem || '|' || c.height || 'x' || c.width || '|' || c.block_size AS image_id, c.width::BIGINT AS width, c.height::BIGINT AS height,
            1::BIGINT AS channels, c.tamper_class, c.nominal AS tamper_ratio_nominal,
            CASE WHEN c.condition = 'tamper' THEN ({achieved} // 1000000) || '.' || lpad(({achieved} % 1000000)::VARCHAR, 6, '0') ELSE '' END AS tamper_ratio_achieved,
            c.variant AS recovery_variant, c.block_size::BIGINT AS block_size, c.run_key::BIGINT AS key_id, 20260811::BIGINT AS seed, {_plain('wm_psnr', 'wm_psnr')}, {_plain('wm_ssim', 'wm_ssim')}, {LOC_ALL()},
            {_plain('recoverability_rate', 'recoverability_rate')}, {_plain(S.psnr('sq_opt', 'n_opt'), 'psnr_in_region')}, {_plain('ssim_in_region', 'ssim_in_region')},
            {_plain(S.psnr('sq_pes', 'n_pes'), 'psnr_pessimistic')}, {_plain('ssim_pessimistic', 'ssim_pessimistic')}, {_plain(S.psnr('sq_marked', 'n_all'), 'psnr_whole_marked')},
            {_plain(S.psnr('sq_unmarked', 'n_all'), 'psnr_whole_unmarked')}, {_plain('ssim', 'ssim_whole_marked')}, n_tampered_blocks, n_unrecoverable_blocks, n_tampered_px, n_unrecoverable_px,
            n_coincidental_px AS n_coincidental_unchanged_px, n_msb AS n_msb_preserved_miss_blocks, block_fp AS n_false_positive_blocks, (block_tp + block_fp + block_fn + block_tn)::BIGINT AS n_blocks_total
            FROM cells c JOIN wm ON c.stem = wm.stem AND c.run_key = wm.key_id AND c.variant = wm.variant AND c.block_size = wm.block_size
            JOIN cf USING (run_id) JOIN fs USING (run_id) JOIN ds USING (run_id) JOIN ss USING (run_id) JOIN rr USING (run_id) JOIN mm USING (run_id)""",
    )


RUNS = runs_sql()
CELLS = cells_sql(Sql().vectors("fa"))


TEXT = ("run_id", "condition", "dataset", "image_name", "image_id", "tamper_class", "tamper_ratio_nominal", "tamper_ratio_achieved", "recovery_variant")
WHOLE = ("width", "height", "channels", "block_size", "key_id", "seed")
SHOWN = ", ".join(c if c in TEXT + WHOLE or c.startswith("n_") else sql_r6(c, c) for c in grid.RUN_COLUMNS)


@query("grid_scores", RUNS.select(f"SELECT {SHOWN} FROM runs"))
def grid_scores(spark, d):
    """Every cell sealed once per key, damaged, verified, repaired and scored."""
    rows = run_rows(spark, d)
    return rows.select(*[r6(F.col(c), c) if t == "double" else F.col(c) for c, t in rows.dtypes])


# -- kept frames -------------------------------------------------------------

_hex = lambda px: f"hex({S.to_bytes(px)})"
_WHITE = "list_transform({}, lambda t: CASE WHEN t THEN 255 ELSE 0 END)"
STAGE_SQL = {
    "sealed": "px_before", "received": "px", "repaired": "px_repaired", "truth": _WHITE.format("truth_px"), "mask": _WHITE.format("list_transform(px, lambda v: flagged)"),
}


@query(
    "retained_stages",
    runs_sql().add(
        "kept", "SELECT run_id FROM cells WHERE condition = 'tamper' AND nominal = '0.25' AND variant = 'A' AND block_size = 8 AND stem = (SELECT min(stem) FROM cells)",
    ).select(" UNION ALL ".join(f"SELECT run_id, '{stage}' AS stage, ch::BIGINT AS ch, idx::BIGINT AS idx, {_hex(px)} AS px_hex FROM rep JOIN kept USING (run_id)" for stage, px in STAGE_SQL.items())),
)
def retained_stages(spark, d):
    """Five stages of one picture under every class, a quarter of it damaged; all other frames are dropped."""
    blocks = carriers.vector_blocks(spark, d)
    kept = materialize(retain.chosen_cells(grid.cells(blocks)))
    scored, _ = grid.scored_family(blocks, kept, keyring(spark), ["A"], 8)
    path = scratch(spark)
    retain.keep(scored, kept, path)
    return spark.read.parquet(path).select("run_id", "stage", "ch", "idx", F.hex(to_bytes(F.col("px"))).alias("px_hex"))


# -- planning ----------------------------------------------------------------

def _plan(spark, d):
    return grid.cells(carriers.vector_blocks(spark, d))


@query(
    "grid_plan",
    CELLS.select("SELECT run_id, condition, tamper_class, nominal, variant, block_size::BIGINT AS block_size, run_key::BIGINT AS run_key, dataset, stem FROM cells"),
)
def grid_plan(spark, d):
    """Cells of the main, null and ablation groups."""
    return _plan(spark, d)


@query(
    "grid_resume",
    CELLS.select("SELECT run_id, grp, stem FROM cells WHERE substr(run_id, 1, 1) >= '4'"),
)
def grid_resume(spark, d):
    """Cells still to do when those with a low id are finished, by a log of overlapping and unfinished writers."""
    plan = materialize(_plan(spark, d).withColumn("grp", grid.group_of()))
    first = F.substring("run_id", 1, 1)
    path = scratch(spark)
    runlog.append(plan.filter(first < "2"), path)
    runlog.append(plan.filter(first < "4"), path)     # half of it a second time
    runlog.stage(plan.filter(first < "9"), path)      # never committed
    return runlog.resume(plan, path).select("run_id", "grp", "stem")


def _partial(plan):
    """A run table with gaps and repeats."""
    first = F.substring("run_id", 1, 1)
    return plan.filter(first != "0").unionByName(plan.filter(first == "1"))


def _with_part() -> Sql:
    return cells_sql(Sql().vectors("fa")).add(
        "part", "SELECT * FROM cells WHERE substr(run_id, 1, 1) <> '0' UNION ALL SELECT * FROM cells WHERE substr(run_id, 1, 1) = '1'"
    )


@query(
    "gate_row_counts",
    _with_part().select(
        "SELECT grp, coalesce(found, 0)::BIGINT AS found, coalesce(expected, 0)::BIGINT AS expected, CASE WHEN coalesce(found, 0) = coalesce(expected, 0) THEN 'PASS' ELSE 'FAIL' END AS status "
        "FROM (SELECT grp, count(*) AS expected FROM cells GROUP BY grp) FULL JOIN (SELECT grp, count(*) AS found FROM part GROUP BY grp) USING (grp)"
    ),
)
def gate_row_counts(spark, d):
    """Rows found against rows expected, per group of the grid."""
    plan = _plan(spark, d)
    return gate.row_counts(_partial(plan), plan)


@query(
    "gate_missing_cells",
    _with_part().add(
        "gone", "SELECT grp, stem || '|' || tamper_class || '|' || nominal || '|' || variant || '|' || run_key AS cell FROM cells WHERE run_id NOT IN (SELECT run_id FROM part)"
    ).select(
        "SELECT grp, n_missing, rank, cell FROM (SELECT grp, cell, row_number() OVER (PARTITION BY grp ORDER BY cell) AS rank, count(*) OVER (PARTITION BY grp) AS n_missing FROM gone) WHERE rank <= 3"
    ),
)
def gate_missing_cells(spark, d):
    """Expected cells that are not there, counted, the first three listed."""
    plan = _plan(spark, d)
    return gate.missing_cells(_partial(plan), plan)


@query("gate_duplicates", _with_part().select("SELECT run_id, count(*)::BIGINT AS n FROM part GROUP BY run_id HAVING count(*) > 1"))
def gate_duplicates(spark, d):
    """Run ids that occur more than once."""
    return gate.duplicates(_partial(_plan(spark, d)))


# -- gate --------------------------------------------------------------------

def _duck(expr: str) -> str:
    return expr.replace("double('Infinity')", "'inf'::DOUBLE").replace("1.0D", "1.0").replace("0.0D", "0.0").replace("0.005D", "0.005")


def checks_sql(checks) -> str:
    rows = []
    fn = {"mean": "avg", "min": "min", "max": "max", "sum": "sum"}
    for c in checks:
        v = f"(CASE WHEN {_duck(c.where)} THEN ({_duck(c.metric)})::DOUBLE END)"
        finite = f"({v} IS NOT NULL AND isfinite({v}))"
        bad = "WARN" if c.severity == "soft" else "FAIL"
        cond = " AND ".join(([f"v >= {c.lo}"] if c.lo is not None else []) + ([f"v <= {c.hi}"] if c.hi is not None else []))
        num = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
        rows.append(
            f"SELECT '{c.name}' AS name, '{c.severity}' AS severity, CASE WHEN n = 0 THEN 'SKIP' WHEN {cond} THEN 'PASS' ELSE '{bad}' END AS status, {sql_r6('v', 'value')}, "
            f"{num(c.lo)} AS lo, {num(c.hi)} AS hi, n::BIGINT AS n, skipped::BIGINT AS skipped FROM (SELECT {fn[c.stat]}({v}) FILTER (WHERE {finite}) AS v, count_if({finite}) AS n, "
            f"count_if(({_duck(c.where)}) AND NOT coalesce({finite}, FALSE)) AS skipped FROM runs)"
        )
    return " UNION ALL ".join(rows)


def _shown(df):
    return df.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("gate_bands", RUNS.select(checks_sql(gate.CHECKS)))
def gate_bands(spark, d):
    """All statistic-in-band checks from one aggregate pass."""
    return _shown(gate.evaluate(run_rows(spark, d)))


NULL_FP = [c for c in gate.CHECKS if c.name == "null false positives"]


@query("gate_null_fp", RUNS.select(checks_sql(NULL_FP)))
def gate_null_fp(spark, d):
    """Zero tolerance for false positives on intact input."""
    return _shown(gate.evaluate(run_rows(spark, d), NULL_FP))


MONO_SQL = (
    "SELECT tamper_ratio_nominal, avg(recoverability_rate) AS rho, count(*) AS n, coalesce(avg(recoverability_rate) <= lag(avg(recoverability_rate)) OVER (ORDER BY tamper_ratio_nominal), TRUE) AS ok "
    "FROM runs WHERE condition = 'tamper' GROUP BY tamper_ratio_nominal"
)


@query("gate_monotone", RUNS.select(f"SELECT tamper_ratio_nominal, {sql_r6('rho', 'rho')}, n::BIGINT AS n, ok FROM ({MONO_SQL})"))
def gate_monotone(spark, d):
    """Mean recoverability must not rise with the damaged share."""
    m = gate.monotone_means(run_rows(spark, d))
    return m.select("tamper_ratio_nominal", r6(F.col("rho"), "rho"), "n", "ok")


@query(
    "gate_report",
    RUNS.select(
        checks_sql(gate.CHECKS)
        + " UNION ALL SELECT 'row counts', 'structural', CASE WHEN sum(f) = 0 THEN 'PASS' ELSE 'FAIL' END, sum(found)::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, sum(expected)::BIGINT, 0::BIGINT FROM "
        "(SELECT coalesce(found, 0) AS found, coalesce(expected, 0) AS expected, CASE WHEN coalesce(found, 0) = coalesce(expected, 0) THEN 0 ELSE 1 END AS f FROM "
        "(SELECT grp, count(*) AS expected FROM cells GROUP BY grp) FULL JOIN (SELECT grp, count(*) AS found FROM runs JOIN (SELECT run_id, grp FROM cells) USING (run_id) GROUP BY grp) USING (grp))"
        " UNION ALL SELECT 'duplicate run_id', 'structural', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::BIGINT, 0::BIGINT FROM (SELECT run_id FROM runs GROUP BY run_id HAVING count(*) > 1)"
        " UNION ALL SELECT 'column pairing', 'structural', 'PASS', 1::DOUBLE, 1::DOUBLE, 1::DOUBLE, 1::BIGINT, 0::BIGINT"
        f" UNION ALL SELECT 'rho falls with the damaged share', 'hard', CASE WHEN count(*) <> 3 THEN 'SKIP' WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END, (round(min(rho), 6) + 0.0)::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, "
        f"CASE WHEN count(*) = 3 THEN 3 ELSE 0 END::BIGINT, 0::BIGINT FROM ({MONO_SQL})"
    ),
)
def gate_report(spark, d):
    """The whole gate as rows."""
    return _shown(gate.report(run_rows(spark, d), _plan(spark, d)))


# -- reports -----------------------------------------------------------------

def stats_sql(cols: list[str]) -> str:
    out = []
    for c in cols:
        f = f"({c} IS NOT NULL AND isfinite({c}))"
        whole, n = f"(CASE WHEN {f} THEN round_even({c} * 1000000000, 0) END)::HUGEINT", f"count_if({f})"
        total, squares = f"sum({whole})", f"sum({whole} * {whole})"
        out.append(
            f"{sql_r6(f'coalesce({total}::DOUBLE / greatest({n}, 1)::DOUBLE / 1000000000, ' + repr('nan') + '::DOUBLE)', c + '_mean')}, "
            f"{sql_r6(f'CASE WHEN {n} >= 2 THEN sqrt(({squares}::HUGEINT * {n} - {total}::HUGEINT * {total}::HUGEINT)::DOUBLE) / {n}::DOUBLE / 1000000000 ELSE 0.0 END', c + '_std')}, "
            f"count_if({f})::BIGINT AS {c}_n, count_if(NOT coalesce({f}, FALSE))::BIGINT AS {c}_skipped"
        )
    return ", ".join(out)


def rounded(df):
    return df.select(*[r6(F.col(c), c) if t == "double" else F.col(c) for c, t in df.dtypes])


AGG = ["wm_psnr", "psnr_in_region", "psnr_whole_marked"]


@query("aggregate_by", RUNS.select(f"SELECT condition, recovery_variant, {stats_sql(AGG)} FROM runs GROUP BY condition, recovery_variant"))
def aggregate_by(spark, d):
    """Mean, population deviation, count and skipped count; NaN and infinities are skipped."""
    return rounded(reports.aggregate_by(run_rows(spark, d), ["condition", "recovery_variant"], AGG))


FID = ", ".join(f"avg({m}) FILTER (WHERE recovery_variant = '{v}') AS {v}_{n}" for v in "AB" for m, n in (("wm_psnr", "psnr"), ("wm_ssim", "ssim")))
FID_COLS = ["A_psnr", "A_ssim", "B_psnr", "B_ssim"]


@query(
    "report_fidelity",
    RUNS.add("fid", f"SELECT image_name, {FID} FROM runs WHERE block_size = 8 AND key_id = 0 GROUP BY image_name").select(
        f"SELECT image_name, {', '.join(sql_r6(c, c) for c in FID_COLS)} FROM fid UNION ALL SELECT '(mean)', {', '.join(sql_r6(f'avg({c})', c) for c in FID_COLS)} FROM fid"
    ),
)
def report_fidelity(spark, d):
    """Sealed fidelity per image and variant, with a mean in which each image counts once."""
    return rounded(reports.fidelity(run_rows(spark, d)))


RUNS.steps.pop("fid", None)
LOC_COLS = reports.LOCALIZATION + ["achieved"]


@query(
    "report_localization",
    RUNS.select(
        f"SELECT tamper_class, tamper_ratio_nominal, {stats_sql(LOC_COLS)}, list_position(['splice', 'inpaint_removal', 'crop_refill', 'noise'], tamper_class)::BIGINT AS class_rank "
        "FROM (SELECT *, tamper_ratio_achieved::DOUBLE AS achieved FROM runs WHERE condition = 'tamper' AND recovery_variant = 'A' AND block_size = 8) GROUP BY tamper_class, tamper_ratio_nominal"
    ),
)
def report_localization(spark, d):
    """Localization and repair by class and nominal share."""
    return rounded(reports.localization(run_rows(spark, d)))


def text_sql(c: str, digits: int) -> str:
    n = lambda x: f"floor({x} * {10**digits} + 0.500001)::BIGINT"
    fixed = lambda x: f"({n(x)} // {10**digits})::VARCHAR || '.' || lpad(({n(x)} % {10**digits})::VARCHAR, {digits}, '0')"
    shown = f"{fixed(c + '_mean')} || ' ± ' || {fixed(c + '_std')}"
    return f"CASE WHEN {c}_mean IS NULL OR isnan({c}_mean) THEN '--' ELSE {shown} END"


@query(
    "report_localization_text",
    RUNS.select(
        "SELECT tamper_class, tamper_ratio_nominal, " + ", ".join(f"{text_sql(c, 4)} AS {c}" for c in ("block_precision", "block_recall", "block_f1", "block_iou")) + ", "
        + ", ".join(f"{text_sql(c, 2)} || ' dB at rho ' || {text_sql('recoverability_rate', 3)} AS {c}" for c in ("psnr_in_region", "psnr_whole_unmarked"))
        + f" FROM (SELECT tamper_class, tamper_ratio_nominal, {stats_sql(LOC_COLS)} FROM (SELECT *, tamper_ratio_achieved::DOUBLE AS achieved FROM runs "
        "WHERE condition = 'tamper' AND recovery_variant = 'A' AND block_size = 8) GROUP BY tamper_class, tamper_ratio_nominal)"
    ),
)
def report_localization_text(spark, d):
    """The localization table as text; PSNR never without rho."""
    return reports.localization_text(rounded(reports.localization(run_rows(spark, d))))


@query(
    "report_null",
    RUNS.select(
        f"SELECT count(*)::BIGINT AS n_rows, count(DISTINCT image_name)::BIGINT AS n_images, count(DISTINCT recovery_variant)::BIGINT AS n_variants, count(DISTINCT key_id)::BIGINT AS n_keys, "
        f"sum(n_blocks_total)::BIGINT AS n_block_checks, sum(n_false_positive_blocks)::BIGINT AS n_false_positives, {sql_r6('sum(n_false_positive_blocks) / sum(n_blocks_total)', 'block_fpr')}, "
        f"{sql_r6('avg(px_fpr)', 'px_fpr')}, {sql_r6('3.0 / sum(n_blocks_total)', 'rule_of_three')} FROM runs WHERE condition = 'null'"
    ),
)
def report_null(spark, d):
    """Intact input: false positives and the 95% bound for none seen."""
    return rounded(reports.null_condition(run_rows(spark, d)))


SIZE = ["block_precision", "px_precision", "px_iou", "recoverability_rate", "psnr_in_region"]


@query(
    "report_blocksize",
    RUNS.select(f"SELECT block_size, {stats_sql(SIZE)} FROM runs WHERE condition = 'tamper' AND recovery_variant = 'A' AND dataset = 'subset' GROUP BY block_size"),
)
def report_blocksize(spark, d):
    """Block side 8 against 4 on the subset."""
    return rounded(reports.block_size(run_rows(spark, d)))


def _comparison_sql() -> str:
    main = "recovery_variant = 'A' AND block_size = 8"
    mean = lambda where, c, n: sql_r6(f"avg({c}) FILTER (WHERE {where} AND isfinite({c}))", n)
    half, hit = f"{main} AND condition = 'tamper' AND tamper_ratio_nominal = '0.50'", f"{main} AND condition = 'tamper'"
    cols = ["wm_psnr", "wm_ssim", "recovered_psnr", "marked_psnr", "block_precision", "block_recall", "px_precision"]
    first = ", ".join([
        mean(f"{main} AND key_id = 0", "wm_psnr", "wm_psnr"), mean(f"{main} AND key_id = 0", "wm_ssim", "wm_ssim"),
        mean(half, "psnr_whole_unmarked", "recovered_psnr"), mean(half, "psnr_whole_marked", "marked_psnr"),
        mean(hit, "block_precision", "block_precision"), mean(hit, "block_recall", "block_recall"), mean(hit, "px_precision", "px_precision"),
    ])
    nulls = ", ".join(f"NULL::DOUBLE AS {c}" for c in cols)
    cited = " UNION ALL ".join(
        f"SELECT {m!r}, {nulls}, {a!r}, {b!r}, {c!r}, {n!r}" for m, a, b, c, n in reports.PUBLISHED
    )
    return (
        f"SELECT 'measured, variant A' AS method, {first}, NULL::VARCHAR AS cited_psnr, NULL::VARCHAR AS cited_ssim, NULL::VARCHAR AS cited_recovered, NULL::VARCHAR AS note FROM runs UNION ALL {cited}"
    )


@query("report_comparison", RUNS.select(_comparison_sql()))
def report_comparison(spark, d):
    """Measured figures beside cited ones."""
    return rounded(reports.comparison(run_rows(spark, d)))


SERIES = ["block_recall", "px_precision", "recoverability_rate", "psnr_whole_marked"]


@query(
    "report_series",
    RUNS.select(f"SELECT recovery_variant, block_size, tamper_class, tamper_ratio_nominal, {stats_sql(SERIES)} FROM runs WHERE condition = 'tamper' GROUP BY ALL"),
)
def report_series(spark, d):
    """Series per variant, block side, class and share."""
    return rounded(reports.series(run_rows(spark, d)))


RUN_LINE = (
    "SELECT o_orderkey AS run_no, o_orderpriority AS tamper_class, CASE WHEN o_orderkey % 10 = 0 THEN 'inf' WHEN o_orderkey % 10 = 1 THEN 'nan' WHEN o_orderkey % 10 = 2 THEN '-inf' "
    "ELSE (round_even(o_totalprice * 100, 0)::BIGINT // 100)::VARCHAR END AS psnr_text FROM orders"
)


@query(
    "runs_scan",
    f"SELECT run_no, tamper_class, CASE WHEN isfinite(psnr_text::DOUBLE) THEN psnr_text::DOUBLE END AS psnr_finite, psnr_text AS psnr_clean FROM ({RUN_LINE})",
)
def runs_scan(spark, d):
    """Typed reading of text run rows with inf and nan literals, and their safe text form."""
    o = table(spark, d, "orders")
    last = F.col("o_orderkey") % 10
    text = (
        F.when(last == 0, "inf").when(last == 1, "nan").when(last == 2, "-inf")
        .otherwise(F.floor(carriers.cents(F.col("o_totalprice")) / 100).cast("string"))
    )
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", text)
    options = {"nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf"}
    row = o.select(F.from_csv(line, "run_no bigint, tamper_class string, psnr double", options).alias("r")).select("r.*")
    finite = ~F.isnan("psnr") & (F.abs("psnr") != float("inf"))
    clean = (
        F.when(F.isnan("psnr"), "nan").when(F.col("psnr") == float("inf"), "inf").when(F.col("psnr") == float("-inf"), "-inf")
        .otherwise(F.col("psnr").cast("bigint").cast("string"))
    )
    return row.select("run_no", "tamper_class", F.when(finite, F.col("psnr")).alias("psnr_finite"), clean.alias("psnr_clean"))


# -- map policies ------------------------------------------------------------

def _policy_sql() -> str:
    q = Sql().keyring().vectors("fa", 3, 4).map("fa", "pm", plain=True).add("one", "SELECT fa.*, nominal FROM fa, (VALUES ('0.10'), ('0.25'), ('0.50')) n(nominal)")
    q.region("one", "g", "'noise'", "nominal")
    q.add("hit", "SELECT owner_id, key_id, height, width, block, k, nominal, ch, idx, len(list_filter(truth_px, lambda t: t)) > 0 AS flagged FROM g")
    message = (
        f"{S.be('height', 2)} || {S.be('width', 2)} || {S.be('block', 2)} || {S.be('k', 4)} || {S.prefixed_text('owner_id')} || {S.be('idx', 4)} || {S.be('ch', 1)}"
    )
    q.add("ph", f"SELECT owner_id, nominal, ch, idx, flagged, {S.hmac('map', message)} AS h FROM hit JOIN keyring USING (key_id)")
    w = "PARTITION BY owner_id, nominal, ch ORDER BY h, idx"
    q.add("pc", f"SELECT *, coalesce(lead(flagged) OVER ({w}), first_value(flagged) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hf FROM ph")
    q.add("pcu", "SELECT nominal, owner_id, idx, bool_or(flagged) AS flagged, bool_or(flagged AND hf) AS un FROM pc GROUP BY ALL")
    q.add("sh", "SELECT h.nominal, h.owner_id, h.idx, h.flagged, h.flagged AND o.flagged AS un FROM (SELECT DISTINCT nominal, owner_id, idx, flagged FROM hit) h "
          "JOIN (SELECT owner_id, idx, holder FROM pm) p USING (owner_id, idx) JOIN (SELECT DISTINCT nominal, owner_id, idx AS holder, flagged FROM hit) o USING (nominal, owner_id, holder)")
    pick = "SELECT '{p}' AS policy, nominal, count(*)::BIGINT AS k, count_if(flagged)::BIGINT AS tampered, count_if(un)::BIGINT AS unrecoverable, {r} FROM {t} GROUP BY nominal"
    rho = sql_r6("CASE WHEN count_if(flagged) = 0 THEN 1.0 ELSE 1.0 - count_if(un) / count_if(flagged) END", "rho")
    return q.select(pick.format(p="shared", t="sh", r=rho) + " UNION ALL " + pick.format(p="per_channel", t="pcu", r=rho))


@query("report_map_policy", _policy_sql())
def report_map_policy(spark, d):
    """One map for all channels against one per channel: a block counts as lost if any channel is."""
    from ..functions.hashing import be, hmac_hex, prefixed, utf8
    from ..operators.ordering import cycle_neighbours
    from ..sources.keyring import with_key

    ring = keyring(spark)
    b = carriers.vector_blocks(spark, d, 3, 4).withColumn("nominal", F.explode(F.array(*[F.lit(r) for r in grid.RATIOS])))
    hit = inject.rectangle_truth(inject.with_rectangle(inject.with_seed(b, F.lit("noise"), F.col("nominal")), F.col("nominal")))
    hit = hit.withColumn("flagged", score.count_true("truth_px") > 0).drop("px", "truth_px")
    shared = partner.with_neighbours(hit.filter("ch = 0"), ring, ["flagged"], ["nominal", "owner_id"], plain=True)
    shared = shared.select("nominal", "owner_id", "idx", "flagged", (F.col("flagged") & F.col("next_flagged")).alias("un"))
    message = F.concat(
        be(F.col("height"), 2), be(F.col("width"), 2), be(F.col("block"), 2), be(F.col("k"), 4),
        prefixed(utf8(F.col("owner_id"))), be(F.col("idx"), 4), be(F.col("ch"), 1),
    )
    keyed = with_key(hit, ring).select(
        "nominal", "owner_id", "ch", "idx", "flagged", hmac_hex(F.col("map_in"), F.col("map_out"), message).alias("h")
    )
    own = cycle_neighbours(keyed, ["nominal", "owner_id", "ch"], "h", "idx", ["flagged"]).groupBy("nominal", "owner_id", "idx").agg(
        F.bool_or("flagged").alias("flagged"), F.bool_or(F.col("flagged") & F.col("next_flagged")).alias("un")
    )
    both = shared.withColumn("policy", F.lit("shared")).unionByName(own.withColumn("policy", F.lit("per_channel")))
    out = both.groupBy("policy", "nominal").agg(
        F.count(F.lit(1)).alias("k"), F.count_if("flagged").alias("tampered"), F.count_if("un").alias("unrecoverable")
    )
    rho = F.when(F.col("tampered") == 0, F.lit(1.0)).otherwise(1.0 - F.col("unrecoverable") / F.greatest("tampered", F.lit(1)))
    return out.select("policy", "nominal", "k", "tampered", "unrecoverable", r6(rho, "rho"))


def _separated_sql() -> str:
    q = Sql().keyring().vectors("fa").map("fa", "pm")
    q.add("far", "SELECT *, sqrt(pow((idx // ncols - holder // ncols) * block, 2) + pow((idx % ncols - holder % ncols) * block, 2)) AS sep, least(height, width) * 0.25::DOUBLE AS wanted FROM pm")
    q.add("met", "SELECT *, greatest(0, ceil(log2(wanted / min(sep) OVER (PARTITION BY owner_id))))::BIGINT AS relaxations FROM far")
    q.add("lim", "SELECT *, wanted * pow(0.5, relaxations) AS d_min FROM met")
    return q.select(f"SELECT owner_id, {big('idx', 'holder', 'carries', 'relaxations')}, d_min::DOUBLE AS d_min, (count_if(sep < d_min) OVER (PARTITION BY owner_id))::BIGINT AS violations FROM lim")


@query("partner_map_separated", _separated_sql())
def partner_map_separated(spark, d):
    """The keyed cycle with the distance its partners keep, in every owner."""
    return separation.separated_map(carriers.vector_blocks(spark, d), keyring(spark))


def _separation_sql() -> str:
    q = Sql().keyring().vectors("fa").map("fa", "pp", plain=True).map("fa", "ps")
    q.add("one", "SELECT fa.*, nominal FROM fa, (VALUES ('0.10'), ('0.25'), ('0.50')) n(nominal)").region("one", "g", "'noise'", "nominal")
    q.add("hit", "SELECT nominal, owner_id, idx, len(list_filter(truth_px, lambda t: t)) > 0 AS flagged FROM g WHERE ch = 0")
    lost = "SELECT h.nominal, h.flagged, h.flagged AND o.flagged AS un FROM hit h JOIN (SELECT owner_id, idx, holder FROM {m}) p USING (owner_id, idx) JOIN (SELECT nominal, owner_id, idx AS holder, flagged FROM hit) o USING (nominal, owner_id, holder)"
    rho = sql_r6("CASE WHEN count_if(flagged) = 0 THEN 1.0 ELSE 1.0 - count_if(un) / count_if(flagged) END", "rho")
    pick = "SELECT '{p}' AS policy, nominal, count(*)::BIGINT AS k, count_if(flagged)::BIGINT AS tampered, count_if(flagged AND NOT un)::BIGINT AS recovered, count_if(un)::BIGINT AS unrecoverable, {r} FROM ({t}) GROUP BY nominal"
    return q.select(" UNION ALL ".join(pick.format(p=p, r=rho, t=lost.format(m=m)) for p, m in (("plain", "pp"), ("separated", "ps"))))


@query("report_map_separation", _separation_sql())
def report_map_separation(spark, d):
    """Recoverability per damaged share with plain and with separated partners."""
    ring = keyring(spark)
    b = carriers.vector_blocks(spark, d).withColumn("nominal", F.explode(F.array(*[F.lit(r) for r in grid.RATIOS])))
    hit = inject.rectangle_truth(inject.with_rectangle(inject.with_seed(b, F.lit("noise"), F.col("nominal")), F.col("nominal")))
    mask = hit.withColumn("flagged", score.count_true("truth_px") > 0).drop("px", "truth_px")
    out = reports.map_policy({
        "plain": verify.partner_state_of_mask(mask, ring, ["nominal"], plain=True),
        "separated": verify.partner_state_of_mask(mask, ring, ["nominal"]),
    })
    return out.select("policy", "nominal", "k", "tampered", "recovered", "unrecoverable", r6(F.col("rho"), "rho"))


# -- rate fit ----------------------------------------------------------------

def _fit_sql() -> Sql:
    q = Sql().vectors("fa").coefficients("fa", "co")
    q.add("en", "SELECT owner_id, ch, idx, round(list_sum(list_transform(coef[2:], lambda v: v * v)), 6) AS energy FROM co")
    q.add("md", "SELECT owner_id, ch, idx, energy, CASE WHEN energy <= (SELECT median(energy) FROM en) THEN 0 ELSE 1 END AS mode FROM en")
    q.add("cz", "SELECT mode, z, coef AS v FROM co_z JOIN md USING (owner_id, ch, idx)")
    q.add("st", "SELECT mode, z, count(*) AS n, stddev_pop(v) AS sigma, avg(v * v) AS energy FROM cz GROUP BY mode, z")
    q.add(
        "cand",
        "SELECT mode, z, bits, load, greatest(2 * (1.2 + 4.8 * load / 48) * sigma / pow(2.0, bits), 1e-6)::DOUBLE AS step FROM st, range(1, 9) b(bits), range(49) l(load)",
    )
    q.add(
        "er",
        f"SELECT mode, z, bits, load, step, avg(pow(greatest(-pow(2, bits - 1), least(pow(2, bits - 1) - 1, {S.half_even('v / step')})) * step - v, 2)) AS err FROM cz JOIN cand USING (mode, z) GROUP BY ALL",
    )
    return q.add(
        "cv",
        "SELECT mode, z, bits, err, step FROM (SELECT mode, z, bits, step, round(err, 6) AS err, row_number() OVER (PARTITION BY mode, z, bits ORDER BY round(err, 6), load) AS rn FROM er) WHERE rn = 1",
    )


def _fit(spark, d):
    rows = materialize(ratefit.coefficient_rows(carriers.vector_blocks(spark, d)))   # read once a pass of the median, then twice
    rows = ratefit.with_mode(rows, ratefit.exact_median(rows, "energy"))
    return rows, ratefit.position_stats(rows)


@query("rd_stats", _fit_sql().select(f"SELECT {big('mode', 'z', 'n')}, {sql_r6('sigma', 'sigma')}, {sql_r6('energy', 'energy')} FROM st"))
def rd_stats(spark, d):
    """Spread and energy per position, smooth and detailed blocks apart."""
    _, stats = _fit(spark, d)
    return stats.select("mode", "z", "n", r6(F.col("sigma"), "sigma"), r6(F.col("energy"), "energy"))


@query("rd_curve", _fit_sql().select(f"SELECT {big('mode', 'z', 'bits')}, {sql_r6('err', 'err')}, {sql_r6('step', 'step')} FROM cv"))
def rd_curve(spark, d):
    """Least error and best step of every position and width."""
    rows, stats = _fit(spark, d)
    return ratefit.curves(rows, stats).select("mode", "z", "bits", r6(F.col("err"), "err"), r6(F.col("step"), "step"))


def _allocate_sql() -> str:
    q = _fit_sql().add("pt", "SELECT mode, z, bits, err FROM cv UNION ALL SELECT mode, z, 0, round(energy, 6) FROM st")
    q.add(
        "hu",
        "SELECT p.mode, p.z, p.bits, min(CASE WHEN a.bits = b.bits THEN a.err ELSE a.err + (b.err - a.err) * (p.bits - a.bits) / (b.bits - a.bits) END) AS hull FROM pt p JOIN pt a ON p.mode = a.mode AND p.z = a.z "
        "AND a.bits <= p.bits JOIN pt b ON p.mode = b.mode AND p.z = b.z AND b.bits >= p.bits GROUP BY ALL",
    )
    q.add("ga", "SELECT *, round(lag(hull) OVER (PARTITION BY mode, z ORDER BY bits) - hull, 6) AS gain FROM hu")
    q.add("ra", "SELECT *, row_number() OVER (PARTITION BY mode ORDER BY gain DESC, z, bits) AS rn FROM ga WHERE gain > 0 AND bits > 0 AND NOT (z = 0 AND bits <= 7)")
    q.add("bi", "SELECT mode, z, max(bits) AS bits FROM (SELECT mode, z, bits FROM ra WHERE rn <= 88 UNION ALL SELECT DISTINCT mode, 0, 7 FROM st) GROUP BY mode, z")
    return q.select(f"SELECT {big('mode', 'z', 'bits')}, {sql_r6('step', 'step')}, {sql_r6('err', 'err')} FROM bi JOIN cv USING (mode, z, bits)")


@query("rd_allocate", _allocate_sql())
def rd_allocate(spark, d):
    """Bits per position under the budget."""
    rows, stats = _fit(spark, d)
    out = ratefit.allocate(ratefit.curves(rows, stats), stats)
    return out.select("mode", "z", "bits", r6(F.col("step"), "step"), r6(F.col("err"), "err"))
