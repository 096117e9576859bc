"""What was sealed, so that what is absent or added can be told.

A tag vouches for one row; it says nothing of rows that never arrived.  The manifest does:
one sealed row for each owner with the number of its records and a keyed multiset digest
of them (a sum of keyed hashes, hence the same in any order and combined on the map side,
however large the owner), and one for each key with its owners counted in the same way.

Which records an incomplete owner lacks follows from the links that verified records
carry: each names the record it backs up and the one that backs it up, so a deleted record
is still named, and restored, by its partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hmac_hex, netstrings, utf8
from ..session import broadcast_if_small
from ..sources.keyring import with_key
from .records import check_records
from .verify import check_tags

MARK_ROW, MARK_OWNER, MARK_KEY, MARK_GRID = "TSM1|row", "TSM1|owner", "TSM1|key", "TSM1|grid"
#: Hex digits of each of the two sums that make a digest; a sum of 10^18 of them still fits a decimal.
DIGITS = 15
SEAL_DIGITS = 32


def _mac(*parts: Column) -> Column:
    return hmac_hex(F.col("tag_in"), F.col("tag_out"), utf8(netstrings(*parts)))


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, DIGITS), 16, 10).cast("decimal(38,0)")


def _sums(digest: str) -> list[Column]:
    """Both sums of a column of hashes; a group's digest is the pair."""
    return [F.sum(_number(F.col(digest), start)).alias(name) for name, start in (("digest_a", 1), ("digest_b", DIGITS + 1))]


def _joined() -> Column:
    whole = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)")).cast("string")
    return F.concat_ws("|", whole("digest_a"), whole("digest_b"))


def _row_mac() -> Column:
    return _mac(F.lit(MARK_ROW), F.col("owner_id"), F.col("rec_key"), F.col("tag"))


def _seal(mark: str) -> Column:
    return F.substring(_mac(F.lit(mark), F.col("owner_id"), F.col("key_id"), F.col("n"), F.col("digest")), 1, SEAL_DIGITS)


def record_manifest(sealed: DataFrame, ring: DataFrame) -> DataFrame:
    """Sealed records -> (kind, owner_id, key_id, n, digest, seal): a row for each owner, and one for each key.

    ``n`` and ``digest`` of an owner cover its records, those of a key its owners' seals.
    Records are aggregated where they are read; one row an owner and task is shuffled.
    An owner whose records have several keys has a row for each.
    """
    macs = with_key(sealed, ring, known_only=True).select("owner_id", "key_id", _row_mac().alias("_m"))
    owners = macs.groupBy("owner_id", "key_id").agg(F.count(F.lit(1)).alias("n"), *_sums("_m")).select("owner_id", "key_id", "n", _joined().alias("digest"))
    owners = with_key(owners, ring).select("owner_id", "key_id", "n", "digest", _seal(MARK_OWNER).alias("seal"))
    return owners.select(F.lit("owner").alias("kind"), "*").unionByName(_roots(owners, ring).select(F.lit("key").alias("kind"), "*"))


def _roots(owners: DataFrame, ring: DataFrame) -> DataFrame:
    """(owner_id '', key_id, n, digest, seal) over the seals of each key's owners."""
    keyed = with_key(owners, ring).withColumn("_m", _mac(F.lit(MARK_KEY), F.col("owner_id"), F.col("seal")))
    roots = keyed.groupBy("key_id").agg(F.count(F.lit(1)).alias("n"), *_sums("_m")).select(F.lit("").alias("owner_id"), "key_id", "n", _joined().alias("digest"))
    return with_key(roots, ring).select("owner_id", "key_id", "n", "digest", _seal(MARK_KEY).alias("seal"))


def check_manifest(manifest: DataFrame, ring: DataFrame) -> DataFrame:
    """The manifest with ``valid``: whether each row's seal holds, and for keys also whether all their owners' rows are there."""
    fresh = F.when(F.col("kind") == "key", _seal(MARK_KEY)).otherwise(_seal(MARK_OWNER))
    rows = with_key(manifest, ring).select(*manifest.columns, F.coalesce(F.col("seal") == fresh, F.lit(False)).alias("valid"))
    present = _roots(rows.filter("kind = 'owner' AND valid").select("owner_id", "key_id", "n", "digest", "seal"), ring).select(
        "key_id", F.col("n").alias("_n"), F.col("digest").alias("_digest")
    )
    whole = (F.col("kind") != "key") | F.coalesce((F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), F.lit(False))
    return rows.join(broadcast_if_small(present), "key_id", "left").select(*manifest.columns, (F.col("valid") & whole).alias("valid"))


def _mentions(checked: DataFrame, ring: DataFrame) -> DataFrame:
    """What each received row says: a verified one speaks of itself and its two partners, any other only of itself."""
    keyed = with_key(checked, ring).select("*", F.when(~F.col("flagged"), _row_mac()).alias("_m"))
    none, zero, one = F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    names = ("own", "held", "named", "unknown", "untagged", "altered")

    def says(key: Column, version: Column, what: str | None, mac: Column = none, counts: dict | None = None) -> Column:
        marks = counts or {n: one if n == what else zero for n in names}
        return F.struct(key.alias("rec_key"), version.alias("v"), mac.alias("mac"), *[marks[n].alias(f"n_{n}") for n in names])

    digest = lambda c: F.sha2(F.col(c), 256)
    good = F.array(
        says(F.col("rec_key"), digest("content"), "own", F.col("_m")), says(F.col("backup_of"), digest("backup"), "held"), says(F.col("holder"), none, "named"),
    )
    when = lambda reason: F.when(F.col("reason") == reason, 1).otherwise(0).cast("bigint")
    reasons = {"own": zero, "held": zero, "named": zero, "unknown": when("unknown key"), "untagged": when("no tag"), "altered": when("tag differs")}
    bad = F.array(says(F.col("rec_key"), none, None, none, reasons))
    said = keyed.select("owner_id", F.explode(F.when(F.col("flagged"), bad).otherwise(good)).alias("_s")).select("owner_id", "_s.*")
    return said.groupBy("owner_id", "rec_key", "v").agg(F.min("mac").alias("mac"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n in names])


def account_records(received: DataFrame, manifest: DataFrame, ring: DataFrame) -> DataFrame:
    """(owner_id, rec_key, kind, status, n, restorable): an account of every received row, deleted record and manifest row.

    ``kind`` is ``record`` for received rows, whose ``n`` add up to the rows received;
    ``deleted`` for records that verified partners name but that did not arrive; ``manifest``
    for the manifest's rows, one each.  Status of a record:

    * AUTHENTIC - its tag holds, and no verified partner contradicts it;
    * ALTERED - the tag differs, or an older sealed version stands in its place;
    * UNKNOWN_KEY, NO_TAG - it names a key nobody holds, or carries no tag;
    * ADDED - a further copy, a record of an owner the manifest does not know, or one that neither a partner nor its own tag vouches for;
    * UNCONFIRMED - several versions verify and no partner is left to tell which was sealed.

    A deleted record is DELETED; ``restorable`` says whether a verified partner holds its
    content (the same for damaged ones).  A manifest row is COMPLETE, INCOMPLETE (records are
    missing), MISMATCH (none is missing, but the digest differs) or FORGED (its own seal
    fails, or a key lacks the row of an owner).  Null keys of records are accounted under
    null; an empty table leaves every owner INCOMPLETE.
    """
    said = _mentions(check_records(received, ring), ring)
    rows = check_manifest(manifest, ring)
    owners = rows.filter("kind = 'owner' AND valid").groupBy("owner_id").agg(F.sum("n").alias("_expected"))
    key = Window.partitionBy("owner_id", "rec_key")
    over = lambda c: F.max(c).over(key)
    own, held = F.col("n_own") > 0, F.col("n_held") > 0
    seen = F.col("n_own") + F.col("n_unknown") + F.col("n_untagged") + F.col("n_altered")
    facts = said.select(
        "*", over(held).alias("any_held"), over(own & held).alias("agreed"), F.sum(own.cast("int")).over(key).alias("versions"),
        (over(own | held) | over(F.col("n_named") > 0)).alias("vouched"), F.sum(seen).over(key).alias("arrived"), F.row_number().over(key.orderBy("v")).alias("place"),
    )
    zero = F.lit(0).cast("bigint")
    genuine = F.when(own & held, 1).when(own & ~F.col("any_held") & (F.col("versions") == 1), 1).otherwise(0).cast("bigint")
    stale = F.when(own & ~held & F.col("any_held") & ~F.col("agreed"), F.col("n_own")).otherwise(zero)
    unsure = F.when(own & ~F.col("any_held") & (F.col("versions") > 1), F.col("n_own")).otherwise(zero)
    instead = F.when(F.col("vouched") & (F.col("versions") == 0), F.col("n_altered")).otherwise(zero)
    counts = {
        "AUTHENTIC": genuine, "ALTERED": stale + instead, "UNKNOWN_KEY": F.col("n_unknown"), "NO_TAG": F.col("n_untagged"), "UNCONFIRMED": unsure,
        "ADDED": F.col("n_own") - genuine - stale - unsure + F.col("n_altered") - instead,
        "DELETED": F.when((F.col("arrived") == 0) & (F.col("place") == 1), 1).otherwise(0).cast("bigint"),
    }
    each = facts.select("owner_id", "rec_key", "mac", F.col("any_held").alias("restorable"), F.explode(F.map_from_arrays(
        F.array(*[F.lit(name) for name in counts]), F.array(*counts.values()),
    )).alias("status", "n")).filter("n > 0")
    each = each.join(broadcast_if_small(owners), "owner_id", "left")
    foreign = F.col("_expected").isNull()
    each = each.filter(~(foreign & (F.col("status") == "DELETED"))).withColumn("status", F.when(foreign, "ADDED").otherwise(F.col("status")))
    records = each.groupBy("owner_id", "rec_key", "status").agg(
        F.sum("n").alias("n"), F.max(F.col("restorable") & (F.col("status") != "AUTHENTIC") & (F.col("status") != "ADDED")).alias("restorable"),
        *[F.sum(F.when(F.col("status") == "AUTHENTIC", _number(F.col("mac"), s))).alias(c) for c, s in (("digest_a", 1), ("digest_b", DIGITS + 1))],
    )
    found = records.filter("status = 'AUTHENTIC'").groupBy("owner_id").agg(
        F.sum("n").alias("found"), F.sum("digest_a").alias("digest_a"), F.sum("digest_b").alias("digest_b"),
    ).select("owner_id", "found", _joined().alias("_digest"))
    # an owner with records of several keys has as many rows; they are compared by their count alone
    keys = rows.filter("kind = 'owner'").groupBy("owner_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_total"))
    listed = rows.join(found, "owner_id", "left").join(keys, "owner_id", "left")
    got = F.coalesce("found", zero)
    state = (
        F.when(~F.col("valid"), "FORGED").when(F.col("kind") == "key", "COMPLETE").when(got < F.col("_total"), "INCOMPLETE")
        .when((got > F.col("_total")) | ((F.col("_rows") == 1) & (F.coalesce("_digest", F.lit("0|0")) != F.col("digest"))), "MISMATCH").otherwise("COMPLETE")
    )
    whole = listed.select(
        F.when(F.col("kind") == "key", F.concat(F.lit("key "), F.col("key_id"))).otherwise(F.col("owner_id")).alias("owner_id"), F.lit(None).cast("string").alias("rec_key"),
        F.lit("manifest").alias("kind"), state.alias("status"), F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("restorable"),
    )
    kind = F.when(F.col("status") == "DELETED", "deleted").otherwise("record")
    return records.select("owner_id", "rec_key", kind.alias("kind"), "status", "n", "restorable").unionByName(whole)


def restore_records(received: DataFrame, ledger: DataFrame, ring: DataFrame) -> DataFrame:
    """(owner_id, rec_key, status, content): the sealed table again, as far as it can be had.

    One row for each record that is authentic, deleted or damaged: AUTHENTIC as received,
    RECOVERED from a verified partner, or UNRECOVERABLE with null content.  Added records
    are left out.  Only contents of authentic rows and backups of wanted ones are shuffled.
    """
    good = check_records(received, ring).filter("NOT flagged")
    kept = ledger.filter("status = 'AUTHENTIC'").select("owner_id", "rec_key")
    wanted = ledger.filter("status IN ('DELETED', 'ALTERED', 'UNKNOWN_KEY', 'NO_TAG', 'UNCONFIRMED')").select("owner_id", "rec_key").distinct()
    wanted = wanted.join(kept, ["owner_id", "rec_key"], "left_anti")
    backups = good.select("owner_id", F.col("backup_of").alias("rec_key"), F.col("backup").alias("content"))
    held = backups.join(wanted, ["owner_id", "rec_key"], "left_semi").groupBy("owner_id", "rec_key").agg(F.max("content").alias("content"))
    fixed = wanted.join(held, ["owner_id", "rec_key"], "left").select(
        "owner_id", "rec_key", F.when(F.col("content").isNull(), "UNRECOVERABLE").otherwise("RECOVERED").alias("status"), "content"
    )
    # of several verified versions the one a partner backs up counts
    agreed = backups.withColumnRenamed("content", "_held").groupBy("owner_id", "rec_key").agg(F.max(F.sha2("_held", 256)).alias("_v"))
    own = good.select("owner_id", "rec_key", "content").join(kept, ["owner_id", "rec_key"], "left_semi").join(agreed, ["owner_id", "rec_key"], "left")
    own = own.filter(F.col("_v").isNull() | (F.sha2("content", 256) == F.col("_v"))).groupBy("owner_id", "rec_key").agg(F.max("content").alias("content"))
    return own.select("owner_id", "rec_key", F.lit("AUTHENTIC").alias("status"), "content").unionByName(fixed)


# -- blocks ---------------------------------------------------------------------------------

GEOMETRY = ["owner_id", "key_id", "height", "width", "block", "k", "ncols"]


def _grid_seal() -> Column:
    return F.substring(_mac(F.lit(MARK_GRID), *[F.col(c) for c in GEOMETRY], F.col("channels"), F.col("variant")), 1, SEAL_DIGITS)


def grid_manifest(sealed: DataFrame, ring: DataFrame) -> DataFrame:
    """Sealed blocks -> one sealed row for each owner: its key, geometry, channels and variant."""
    rows = sealed.groupBy(*GEOMETRY, "variant").agg((F.max("ch") + 1).cast("int").alias("channels"))
    return with_key(rows, ring, known_only=True).select(*GEOMETRY, "variant", "channels", _grid_seal().alias("seal"))


def complete_blocks(received: DataFrame, manifest: DataFrame, ring: DataFrame, variant: str, block: int = 8) -> DataFrame:
    """Checked blocks of every cell that was sealed, whatever arrived: GEOMETRY, ch, idx, r, c, px, stored_tag, stored_desc, fresh_tag, mismatch, copies.

    Key and geometry come from the manifest, not from the rows, so that no altered field of
    a row moves it, or the partners of others, elsewhere.  A cell that did not arrive has
    null pixels, ``copies`` 0 and mismatches; of several copies one that verifies is taken.
    The result takes the place of ``check_tags`` in what follows.  Rows that belong to no
    cell are ``stray_blocks``.  Owners whose manifest row does not verify are left out.
    """
    listed = with_key(manifest, ring).filter((F.col("seal") == _grid_seal()) & (F.col("variant") == variant)).select(*GEOMETRY, "channels")
    rows = received.select("owner_id", "ch", "idx", "px").join(broadcast_if_small(listed), "owner_id")
    checked = check_tags(rows, ring, variant, block)
    best = F.max(F.struct((~F.col("mismatch")).alias("_ok"), F.col("px"), F.col("stored_tag"), F.col("stored_desc"), F.col("fresh_tag")))
    arrived = checked.groupBy("owner_id", "ch", "idx").agg(F.count(F.lit(1)).alias("copies"), best.alias("_b"))
    each = listed.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("channels") - 1))).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    cells = each.join(arrived, ["owner_id", "ch", "idx"], "left")
    return cells.select(
        *GEOMETRY, "ch", "idx", F.floor(F.col("idx") / F.col("ncols")).cast("bigint").alias("r"), (F.col("idx") % F.col("ncols")).alias("c"),
        *[F.col(f"_b.{c}").alias(c) for c in ("px", "stored_tag", "stored_desc", "fresh_tag")],
        (~F.coalesce(F.col("_b._ok"), F.lit(False))).alias("mismatch"), F.coalesce("copies", F.lit(0).cast("bigint")).alias("copies"),
    )


def stray_blocks(received: DataFrame, manifest: DataFrame) -> DataFrame:
    """Received rows of no sealed cell: another owner, channel or index than the manifest lists."""
    listed = manifest.select("owner_id", F.col("k").alias("_k"), "channels")
    inside = (F.col("idx") >= 0) & (F.col("idx") < F.col("_k")) & (F.col("ch") >= 0) & (F.col("ch") < F.col("channels"))
    return received.join(broadcast_if_small(listed), "owner_id", "left").filter(~F.coalesce(inside, F.lit(False))).select(*received.columns)
