import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import make_blocks
from tesserae.operators import library as lib, score, seal
from tesserae.plans import gate, grid, reports, runlog
from tesserae.session import materialize
from tesserae.sources import files


def test_confusion_and_scores(spark):
    """4x4 grid of one-pixel blocks, truth and prediction overlapping in one cell."""
    rows = []
    for r in range(4):
        for c in range(4):
            t, p = r < 2 and c < 2, 1 <= r < 3 and 1 <= c < 3
            rows.append(("o", 0, r * 4 + c, [t], p, p))
    df = spark.createDataFrame(rows, "owner_id string, ch int, idx int, truth_px array<boolean>, raw boolean, flagged boolean")
    c = score.confusion_counts(df, ["owner_id"])
    row = c.first()
    assert (row["block_tp"], row["block_fp"], row["block_fn"], row["block_tn"]) == (1, 3, 3, 9)
    s = score.all_loc_scores(c, ["owner_id"]).first()
    assert s["px_precision"] == 0.25 and s["px_recall"] == 0.25 and abs(s["px_iou"] - 1 / 7) < 1e-12
    empty = spark.createDataFrame([(0, 0, 0, 0)], "tp int, fp int, fn int, tn int").select(*score.loc_scores()).first()
    assert (empty["precision"], empty["recall"], empty["iou"], empty["f1"], empty["fpr"]) == (1.0, 1.0, 1.0, 1.0, 0.0)


def test_ssim_by_hand(spark):
    b = make_blocks(spark, 2, 2, lambda ch, i: [(p * 3 + i * 17) % 256 for p in range(64)])
    same = score.ssim(b.withColumn("q", F.col("px")), ["owner_id"], "px", "q").first()["ssim"]
    assert abs(same - 1) < 1e-12
    other = b.withColumn("q", F.transform("px", lambda v: F.least(F.lit(255), v + 9)))
    got = score.ssim(other, ["owner_id"], "px", "q").first()["ssim"]
    grid_of = lambda col: [[next(r for r in rows if r["idx"] == y // 8 * 2 + x // 8)[col][y % 8 * 8 + x % 8] for x in range(16)] for y in range(16)]
    rows = other.collect()
    a, q, total, n = grid_of("px"), grid_of("q"), 0.0, 0
    for y in range(3, 13):
        for x in range(3, 13):
            u = [a[j][i] for j in range(y - 3, y + 4) for i in range(x - 3, x + 4)]
            v = [q[j][i] for j in range(y - 3, y + 4) for i in range(x - 3, x + 4)]
            mu, mv = sum(u) / 49, sum(v) / 49
            vu, vv = sum((z - mu) ** 2 for z in u) / 48, sum((z - mv) ** 2 for z in v) / 48
            uv = sum((s - mu) * (t - mv) for s, t in zip(u, v)) / 48
            total += (2 * mu * mv + 6.5025) * (2 * uv + 58.5225) / ((mu * mu + mv * mv + 6.5025) * (vu + vv + 58.5225))
            n += 1
    assert abs(got - total / n) < 1e-9


def test_group_statistics(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", float("nan")), ("y", 5.0), ("z", float("inf"))], "g string, v double")
    got = {r["g"]: r for r in reports.aggregate_by(df, ["g"], ["v"]).collect()}
    assert (got["x"]["v_mean"], got["x"]["v_std"], got["x"]["v_n"], got["x"]["v_skipped"]) == (2.0, 1.0, 2, 1)
    assert got["y"]["v_std"] == 0.0 and math.isnan(got["z"]["v_mean"]) and got["z"]["v_n"] == 0


GOOD = dict(
    condition="tamper", block_size=8, recovery_variant="A", tamper_ratio_nominal="0.10", wm_psnr=43.2, wm_ssim=0.98, block_precision=1.0,
    block_recall=1.0, px_precision=0.95, psnr_whole_unmarked=30.0, psnr_whole_marked=25.0, psnr_in_region=28.0, recoverability_rate=0.96,
    n_false_positive_blocks=0, n_coincidental_unchanged_px=0, n_tampered_px=100, n_msb_preserved_miss_blocks=0, run_id="r1",
)


def gate_rows(spark, *changes):
    rows = [{**GOOD, "run_id": f"r{i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in GOOD.items()))


def statuses(df):
    return {r["name"]: r["status"] for r in df.collect()}


def test_gate_semantics(spark):
    clean = gate_rows(spark, {}, {"tamper_ratio_nominal": "0.25", "recoverability_rate": 0.8}, {"tamper_ratio_nominal": "0.50", "recoverability_rate": 0.5})
    s = statuses(gate.evaluate(clean))
    assert "FAIL" not in s.values() and s["wm_psnr mean B"] == "SKIP" and s["null false positives"] == "SKIP"
    assert statuses(gate.check_monotone(clean)) == {"rho falls with the damaged share": "PASS"}
    broken = gate_rows(spark, {"condition": "null", "n_false_positive_blocks": 1}, {"psnr_whole_marked": 40.0}, {"recoverability_rate": float("nan")})
    s = statuses(gate.evaluate(broken))
    assert s["null false positives"] == "FAIL" and s["marked above unmarked rate"] == "WARN" and s["rho not finite"] == "FAIL"
    assert set(statuses(gate.evaluate(clean.filter("FALSE"))).values()) == {"SKIP"}
    up = gate_rows(spark, {}, {"tamper_ratio_nominal": "0.25", "recoverability_rate": 0.99}, {"tamper_ratio_nominal": "0.50"})
    assert set(statuses(gate.check_monotone(up)).values()) == {"FAIL"}
    assert gate.paired_columns(["a"]) and not gate.paired_columns(["psnr_in_region"])
    assert gate.duplicates(clean.unionByName(clean.limit(1))).count() == 1


def test_reports_wait_for_the_gate(spark, tmp_path):
    ok = spark.createDataFrame([("a", "hard", "PASS", 1.0, None, None, 1, 0)], gate.RESULT)
    bad = spark.createDataFrame([("a", "hard", "FAIL", 1.0, None, None, 1, 0)], gate.RESULT)
    assert not gate.write_if_passed(bad, {"t": ok}, str(tmp_path / "x")) and not (tmp_path / "x" / "t").exists()
    assert gate.write_if_passed(ok, {"t": ok}, str(tmp_path / "y")) and (tmp_path / "y" / "t").exists()


def test_resume_appends_only_the_rest(spark, blocks, tmp_path):
    plan = materialize(grid.cells(blocks))
    out = str(tmp_path / "runs")
    first = plan.filter("substr(run_id, 1, 1) < '8'")
    assert grid.append_runs(first, out) == first.count()
    rest = runlog.resume(plan, out)
    assert grid.append_runs(rest, out) == rest.count() > 0 == grid.append_runs(first, out)
    done = runlog.read(spark, out)
    assert done.count() == plan.count() == done.select("run_id").distinct().count()
    assert grid.resume(plan, done).count() == 0


def png(width, height, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_files(spark, tmp_path):
    samples = {
        "a.jpg": (png(4, 3, (10, 20, 30)), "png"), "b.txt": (b"\xff\xd8\xff\xe0x", "jpeg"), "c": (b"BMxx", "bmp"), "d": (b"II*\0", "tiff"),
        "e": (b"MM\0*", "tiff"), "f": (b"RIFF1234WEBP", "webp"), "g": (b"GIF89a", "gif"), "h": (b"%PDF-1", "pdf"), "i": (b"RIFF1234WAVE", "unknown"), "j": (b"\0", "unknown"),
    }
    folder = tmp_path / "files"
    folder.mkdir()
    for name, (data, _) in samples.items():
        (folder / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["fmt"], r["rejected"]) for r in files.with_format(files.binary_files(spark, str(folder))).select("path", "fmt", "rejected").collect()}
    for name, (_, fmt) in samples.items():
        assert got[name] == (fmt, fmt in files.LOSSY), name
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.png").write_bytes(samples["a.jpg"][0])
    rows = files.image_pixels(spark, str(tmp_path / "img")).collect()
    for r in rows:
        assert r["data"][r["sample"]] == (10, 20, 30)[r["ch"]]
    (tmp_path / "img" / "broken.png").write_bytes(b"\x89PNG")
    rejects = {r["origin"].rsplit("/", 1)[1]: r["reason"] for r in files.image_rejects(files.images(spark, str(tmp_path / "img")), 11).collect()}
    assert rejects == {"x.png": "more than 11 pixels", "broken.png": "not decodable"}
    assert files.image_pixels(spark, str(tmp_path / "img"), 11).count() == 0 and files.image_pixels(spark, str(tmp_path / "img")).count() == 3


def test_manifest_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("dataset,filename,relpath,width,height,channels,sha256,source_url,fetched_utc\nx,a.png,x/a.png,8,8,3,aa,u,t\nx,b.png,x/b.png,8,8,3,bb,u,t\n")
    m = files.manifest(spark, str(path))
    there = spark.createDataFrame([("x/a.png", "zz"), ("x/c.png", "cc")], "relpath string, sha256 string")
    got = {r["relpath"]: r["status"] for r in files.verify_manifest(m, there).collect()}
    assert got == {"x/a.png": "HASH MISMATCH", "x/b.png": "MISSING", "x/c.png": "EXTRA"}
    assert dict(m.dtypes)["width"] == "int"
    good = spark.createDataFrame([("x/a.png", "aa"), ("x/b.png", "bb")], "relpath string, sha256 string")
    assert files.check_roster(files.verify_manifest(m, good), {"x": 2}).first()["found"] == 2
    with pytest.raises(ValueError):
        files.check_roster(files.verify_manifest(m, there), {"x": 2})


def test_run_reader_and_block_sink(spark, tmp_path, blocks):
    from tesserae.plans.grid import RUN_COLUMNS
    from tesserae.sources.runs import read_runs

    (tmp_path / "runs.csv").write_text("psnr_in_region,run_id,unknown,n_blocks_total\ninf,r1,z,7\nnan,r2,,\n12.5,r3,q,1\n")
    runs = read_runs(spark, str(tmp_path / "runs.csv"))
    assert runs.columns == list(RUN_COLUMNS)
    got = {r.run_id: (str(r.psnr_in_region), r.n_blocks_total, r.seed) for r in runs.collect()}
    assert got == {"r1": ("inf", 7, None), "r2": ("nan", None, None), "r3": ("12.5", 1, None)}
    files.write_blocks(blocks, str(tmp_path / "blocks"))
    back = spark.read.parquet(str(tmp_path / "blocks")).select(*blocks.columns)
    assert back.count() == blocks.count() and back.exceptAll(blocks).isEmpty()
    with pytest.raises(ValueError):
        files.write_blocks(blocks, str(tmp_path / "lossy"), "jpeg")


def test_library(spark):
    cols = "id bigint, name string, created_at bigint, sha256 string"
    first = spark.createDataFrame([(1, "A", 1, "h1"), (3, "C", 3, "h3")], cols)
    more = spark.createDataFrame([(2, "A again", 2, "h1"), (4, "D", 4, "h4")], cols)
    got = {r["sha256"]: r for r in lib.upsert(first, more).collect()}
    assert got["h1"]["id"] == 1 and got["h1"]["name"] == "A again" and got["h1"]["created_at"] == 2 and len(got) == 3
    left = lib.delete(lib.upsert(first, more), spark.createDataFrame([(3,)], "id bigint"))
    assert [r["id"] for r in lib.listing(left).collect()] == [4, 1]


def test_identify_brute_force(spark, ring, blocks):
    """The tag join against trying every record of the shape."""
    from tesserae.operators import inject, verify

    two = blocks.withColumn("key_id", F.explode(F.array(F.lit(0), F.lit(1))))
    s = materialize(seal.seal(two, ring, "B", extra=["key_id"]).withColumn("record_id", (F.col("label") * 2 + F.col("key_id")).cast("bigint")))
    records = s.filter("idx = 0").select("record_id", "owner_id", "key_id", "height", "width", F.col("k").alias("n_blocks"), F.lit(1).alias("n_channels"))
    recv = inject.inject_noise(seal.as_received(s.filter("key_id = 1")), F.lit("0.25")).withColumn("query_id", F.col("stem"))
    recv = materialize(recv.select("query_id", "height", "width", "block", "k", "ncols", "ch", "idx", "r", "c", "px"))
    got = {r["query_id"]: r for r in lib.identify(recv, s, records, ring, "B").collect()}
    every = recv.join(records.drop("n_blocks", "n_channels"), ["height", "width"])
    counts = verify.check_tags(every, ring, "B").groupBy("query_id", "record_id").agg(F.count_if(~F.col("mismatch")).alias("v"))
    want = {}
    for r in counts.collect():
        want.setdefault(r["query_id"], []).append((r["v"], r["record_id"]))
    for q, tried in want.items():
        tried.sort(reverse=True)
        assert got[q]["verifying"] == tried[0][0] and got[q]["n_candidates"] == len(tried)
        assert got[q]["record_id"] == (tried[0][1] if tried[0][0] >= 8 else None)
        assert got[q]["runner_up"] == tried[1][0]


def test_exact_median(spark):
    from tesserae.operators.ratefit import exact_median

    for n in (1, 2, 7, 100, 101):
        df = spark.range(n).select(((F.col("id") * 7919) % 1000 / 3.0).alias("v"))
        values = sorted((i * 7919) % 1000 / 3.0 for i in range(n))
        want = (values[(n - 1) // 2] + values[n // 2]) / 2
        assert exact_median(df, "v") == pytest.approx(want)


def test_exact_ranks_of_hard_values(spark):
    """Wide ranges, one value many times, neighbours in the last bit; nulls, NaN and infinities take no part."""
    from tesserae.operators.ratefit import exact_median, exact_rank

    nan, inf = float("nan"), float("inf")
    values = [1e-300, 1.0, math.nextafter(1.0, 2.0), 1e300, -1e300, -5.0, 0.0, -0.0, 1e308, -1.5e308, *[2.5] * 40, 7.0, math.nextafter(7.0, 8.0)]
    df = spark.createDataFrame([(v,) for v in [*values, None, nan, inf, -inf]], "v double").repartition(4)
    for rank, want in enumerate(sorted(values)):
        if rank % 9 in (0, 1, 4):
            assert exact_rank(df, "v", rank) == want
    assert exact_median(df, "v") == 2.5 and math.isnan(exact_median(df.limit(0), "v"))
    with pytest.raises(ValueError):
        exact_rank(df, "v", len(values))


def test_nearest_other_and_regions_by_brute_force(spark):
    import random

    from tesserae.operators import inject

    rnd = random.Random(4)
    px = [[rnd.randrange(4)] * 64 for _ in range(99)]
    b = make_blocks(spark, 11, 9, lambda ch, i: px[i], channels=2)
    got = {r.dst: (r.diff, r.src) for r in inject.nearest_other(b).collect()}
    assert got == {i: min((abs(sum(px[i]) - sum(px[j])), j) for j in range(99) if j != i) for i in range(99)}
    assert inject.nearest_other(make_blocks(spark, 1, 1, lambda ch, i: [0] * 64)).count() == 0

    rows = [("img", rnd.randrange(-20, 90), rnd.randrange(-20, 80)) for _ in range(60)]
    regions = [(o, y, x, y + rnd.randrange(0, 40), x + rnd.randrange(0, 40)) for o, y, x in rows] + [("img", 0, 0, 88, 72), ("img", 5, 5, 5, 9), ("other", 0, 0, 9, 9), ("img", -9, -9, 0, 0)]
    for chosen in (regions[:20], regions):
        df = spark.createDataFrame([(r[0] + "|88x72|8", *r[1:]) for r in chosen], "owner_id string, y0 bigint, x0 bigint, y1 bigint, x1 bigint")
        want = {}
        for _, y0, x0, y1, x1 in [r for r in chosen if r[0] == "img"]:
            touched = {}
            for y in range(max(y0, 0), min(y1, 88)):
                for x in range(max(x0, 0), min(x1, 72)):
                    touched.setdefault(y // 8 * 9 + x // 8, set()).add(y % 8 * 8 + x % 8)
            for i, bits in touched.items():
                n, mask = want.get(i, (0, set()))
                want[i] = (n + 1, mask | bits)
        for tile in (1, 3, 8):
            found = {r.idx: (r.n_regions, {p for p in range(64) if r.mask >> p & 1}) for r in inject.regions_cover(b, df, tile).collect()}
            assert found == want


def test_allocation_spends_the_budget(spark, blocks):
    from tesserae.operators import ratefit

    rows = ratefit.coefficient_rows(blocks)
    rows = materialize(ratefit.with_mode(rows, ratefit.exact_median(rows, "energy")))
    stats = ratefit.position_stats(rows)
    curve = materialize(ratefit.curves(rows, stats))
    got = materialize(ratefit.allocate(curve, stats))
    by_mode = {r["mode"]: r["b"] for r in got.groupBy("mode").agg(F.sum("bits").alias("b")).collect()}
    assert by_mode == {0: 95, 1: 95}
    assert got.filter("z = 0 AND bits < 7").count() == 0
    zero = stats.select("mode", "z", "energy")
    chosen = zero.join(got, ["mode", "z"], "left").agg(F.sum(F.coalesce("err", "energy")).alias("e")).first()["e"]
    uniform = curve.filter("bits = 2 AND z < 47").select("mode", "z", F.col("err").alias("u"))
    flat = zero.join(uniform, ["mode", "z"], "left").agg(F.sum(F.coalesce("u", "energy")).alias("e")).first()["e"]
    assert chosen <= flat
