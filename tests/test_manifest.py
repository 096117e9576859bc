"""Every received, deleted and added row gets its own status, and deleted records come back."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA, make_blocks
from tesserae.operators import manifest as man, records as rec, repair, seal, verify
from tesserae.session import materialize
from test_records_and_order import skewed

BANG = b"!"


@pytest.fixture(scope="module")
def sealed(spark, ring):
    s = materialize(rec.seal_records(skewed(spark, 900).drop("n"), ring))
    return s, materialize(man.record_manifest(s, ring))


def statuses(ledger):
    return {(r.owner_id, r.rec_key, r.status): (r.kind, r.n, r.restorable) for r in ledger.collect()}


def counts(ledger, kind="record"):
    return {r.status: r.n for r in ledger.filter(F.col("kind") == kind).groupBy("status").agg(F.sum("n").alias("n")).collect()}


def test_intact_table(spark, ring, sealed):
    s, manifest = sealed
    ledger = man.account_records(s, manifest, ring)
    assert counts(ledger) == {"AUTHENTIC": 900} and counts(ledger, "deleted") == {}
    assert counts(ledger, "manifest") == {"COMPLETE": manifest.count()}
    assert manifest.filter("kind = 'key'").count() == 5


def test_every_kind_of_damage(spark, ring, sealed):
    s, manifest = sealed
    n = F.col("rec_key").cast("int")
    good = s.filter(n % 50 != 0)
    parts = {
        "altered": s.filter(n % 50 == 0).filter(n % 100 == 0).withColumn("content", F.concat("content", F.lit(BANG))),
        "unknown": good.filter(n % 50 == 11).withColumn("key_id", F.lit(99)),
        "nullkey": good.filter(n % 50 == 12).withColumn("key_id", F.lit(None).cast("int")),
        "untagged": good.filter(n % 50 == 13).withColumn("tag", F.lit(None).cast("string")),
        "nullcontent": good.filter(n % 50 == 14).withColumn("content", F.lit(None).cast("binary")),
        "copies": good.filter(n % 50 == 15).unionByName(good.filter(n % 50 == 15)),
        "forged": good.filter(n % 50 == 16).withColumn("rec_key", F.concat("rec_key", F.lit("x"))),
        "rest": good.filter(n % 50 > 14),
        "low": good.filter((n % 50 < 11) & (n % 50 != 7)),                 # 7 is deleted, as is 50 mod 100
        "strangers": good.filter(n % 50 == 17).withColumn("owner_id", F.lit("nobody")),
    }
    received = None
    for part in parts.values():
        received = part if received is None else received.unionByName(part)
    received = materialize(received)
    ledger = materialize(man.account_records(received, manifest, ring))
    rows = received.count()
    assert ledger.filter("kind = 'record'").agg(F.sum("n")).first()[0] == rows
    assert ledger.filter("kind = 'manifest'").count() == manifest.count()
    assert ledger.filter("kind <> 'deleted'").agg(F.sum("n")).first()[0] == rows + manifest.count()
    found = statuses(ledger)
    keys = {r.rec_key: r.owner_id for r in s.collect()}
    of = lambda k: {st for (o, key, st) in found if key == str(k) and o == keys[str(k)]}
    by = {(r.owner_id, r.backup_of): r.rec_key for r in s.collect()}
    gone = lambda k: k % 50 in (0, 7, 11, 12, 13, 14)
    for k in range(900):
        holder = int(by[keys[str(k)], str(k)])
        want = {0: "ALTERED" if k % 100 == 0 else "DELETED", 7: "DELETED", 11: "UNKNOWN_KEY", 12: "UNKNOWN_KEY", 13: "NO_TAG", 14: "ALTERED"}.get(k % 50, "AUTHENTIC")
        got = of(k)
        if want == "DELETED" and not got:      # both partners are gone: nobody names it, the manifest counts it
            assert gone(holder)
            continue
        if want == "ALTERED" and got == {"ADDED"}:
            assert gone(holder)
            continue
        assert got == ({want, "ADDED"} if k % 50 == 15 else {want}), (k, got)
        if want != "AUTHENTIC":
            assert found[keys[str(k)], str(k), want][2] == (not gone(holder))
    assert all(found[keys[str(k)], f"{k}x", "ADDED"][1] == 1 for k in range(16, 900, 50))
    assert all(found["nobody", str(k), "ADDED"][1] == 1 for k in range(17, 900, 50))
    lacking = {o for (o, key, st) in found if key is None and st == "INCOMPLETE"}
    assert "hot" in lacking and not any(st == "FORGED" for _, _, st in found)

    restored = materialize(man.restore_records(received, ledger, ring))
    back = {(r.owner_id, r.rec_key): (r.status, r.content) for r in restored.collect()}
    assert len(back) == restored.count()
    contents = {(r.owner_id, r.rec_key): r.content for r in s.collect()}
    for key, (status, content) in back.items():
        assert content == (contents[key] if status != "UNRECOVERABLE" else None)
        assert (status == "AUTHENTIC") == (not gone(int(key[1])))
        if status == "UNRECOVERABLE":
            assert gone(int(by[key]))


def test_an_older_version_in_place_of_the_sealed_one(spark, ring, sealed):
    """A replayed record verifies, but its partner backs up something else; an added old version does not displace the new one."""
    s, manifest = sealed
    older = skewed(spark, 900).drop("n").withColumn("content", F.concat(F.lit(b"old-"), "content"))
    old = materialize(rec.seal_records(older, ring))
    here = F.col("rec_key") == "6"
    swapped = s.filter(~here).unionByName(old.filter(here))
    found = statuses(man.account_records(swapped, manifest, ring))
    assert found["hot", "6", "ALTERED"] == ("record", 1, True) and ("hot", None, "INCOMPLETE") in found
    both = s.unionByName(old.filter(here))
    found = statuses(man.account_records(both, manifest, ring))
    assert found["hot", "6", "AUTHENTIC"][1] == 1 and found["hot", "6", "ADDED"][1] == 1 and ("hot", None, "COMPLETE") in found
    kept = {(r.rec_key): r.content for r in man.restore_records(both, man.account_records(both, manifest, ring), ring).collect()}
    assert kept["6"] == s.filter(here).first().content and len(kept) == 900
    # a whole older owner verifies row by row; only the digest tells
    replay = s.filter("owner_id <> 'hot'").unionByName(old.filter("owner_id = 'hot'"))
    found = statuses(man.account_records(replay, manifest, ring))
    assert ("hot", None, "MISMATCH") in found and sum(st == "MISMATCH" for _, _, st in found) == 1


def test_tampered_manifest(spark, ring, sealed):
    s, manifest = sealed
    fewer = manifest.withColumn("n", F.when(F.col("owner_id") == "hot", F.col("n") - 1).otherwise(F.col("n")))
    bad = {(r.kind, r.owner_id) for r in man.check_manifest(fewer, ring).filter("NOT valid").collect()}
    key = s.filter("owner_id = 'hot'").first().key_id
    assert bad == {("owner", "hot"), ("key", "")} and man.check_manifest(fewer, ring).filter("NOT valid").count() == 2
    dropped = man.check_manifest(manifest.filter("owner_id <> 'hot'"), ring).filter("NOT valid").collect()
    assert [(r.kind, r.key_id) for r in dropped] == [("key", key)]
    assert man.check_manifest(manifest.withColumn("seal", F.lit(None).cast("string")), ring).filter("valid").count() == 0
    assert man.check_manifest(manifest.withColumn("key_id", F.lit(77)), ring).filter("valid").count() == 0


def test_empty_tables(spark, ring, sealed):
    s, manifest = sealed
    nothing = man.account_records(s.limit(0), manifest, ring)
    assert counts(nothing) == {} and counts(nothing, "manifest") == {"INCOMPLETE": manifest.filter("kind = 'owner'").count(), "COMPLETE": 5}
    unlisted = man.account_records(s, manifest.limit(0), ring)
    assert counts(unlisted) == {"ADDED": 900} and counts(unlisted, "manifest") == {}


def test_checks_lose_no_row(spark, ring, sealed):
    s, _ = sealed
    odd = s.withColumn("key_id", F.when(F.col("rec_key") == "1", 99).otherwise(F.col("key_id"))).withColumn("tag", F.when(F.col("rec_key") != "2", F.col("tag")))
    checked = rec.check_records(odd, ring)
    assert checked.count() == 900 and checked.filter("flagged IS NULL").count() == 0
    assert {(r.rec_key, r.reason) for r in checked.filter("flagged").collect()} == {("1", "unknown key"), ("2", "no tag")}
    assert rec.repair_records(materialize(checked)).count() == 900
    unknown = skewed(spark, 30).drop("n").withColumn("key_id", F.lit(44))
    assert {r.reason for r in rec.validate_records(unknown, ring=ring).collect()} == {"unknown key"}
    with pytest.raises(ValueError):
        rec.seal_records(unknown, ring, strict=True)


def test_absent_blocks_are_rebuilt(spark, ring):
    blocks = make_blocks(spark, 6, 6, lambda ch, i: [(i * 7 + v + ch * 31) % 256 for v in range(64)], channels=3)
    s = materialize(seal.seal(blocks, ring, "B"))
    manifest = man.grid_manifest(s, ring)
    got = seal.as_received(s)
    moved = got.filter("NOT (idx = 9) AND NOT (idx = 20 AND ch = 1)").withColumn("key_id", F.when(F.col("idx") == 3, 99).otherwise(F.col("key_id")))
    moved = moved.unionByName(got.filter("idx = 5")).unionByName(got.filter("idx = 6").withColumn("px", F.transform("px", lambda v: (v + 4) % 256)))
    stray = got.filter("idx = 1").withColumn("idx", F.lit(36).cast("bigint")).unionByName(got.filter("idx = 2").withColumn("owner_id", F.lit("other")))
    moved = moved.unionByName(stray)
    checked = materialize(man.complete_blocks(moved, manifest, ring, "B"))
    assert checked.count() == 108
    assert {(r.ch, r.idx) for r in checked.filter("mismatch").collect()} == {(0, 9), (1, 9), (2, 9), (1, 20)} == {(r.ch, r.idx) for r in checked.filter("copies = 0").collect()}
    assert {r.idx for r in checked.filter("copies = 2").collect()} == {5, 6}
    mask = verify.localize(checked)
    assert {r.idx for r in mask.filter("flagged").collect()} == {9, 20}
    fixed = repair.repair(verify.with_partner_state(checked, mask, ring), "B")
    rows = {(r.ch, r.idx): r for r in fixed.collect()}
    assert len(rows) == 108 and all(len(r.px_repaired) == 64 for r in rows.values())
    assert all(rows[ch, 9].recoverable or rows[ch, 9].unrecoverable for ch in range(3))
    assert man.stray_blocks(moved, manifest).count() == 6
    forged = manifest.withColumn("k", F.lit(12).cast("bigint"))
    assert man.complete_blocks(moved, forged, ring, "B").count() == 0
