"""Seal, verify and repair ordinary records; tag and backup travel in columns beside them.

A record's content must not be altered, so the carried backup is the partner's exact
content.  Owners (a month, a user) may be of any size: the cycle of a large one is cut
into hash buckets and repair joins on the record key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hmac_hex, netstrings, utf8
from ..sources.keyring import with_key
from ..session import broadcast_if_small
from .ordering import CYCLE_BUCKET, cycle_neighbours, digest_bucket, hot_groups

MARK = "TSR1"
TAG_DIGITS = 32


def record_tag() -> Column:
    head = F.concat(
        F.lit(MARK), netstrings(F.col("owner_id"), F.col("rec_key"), F.col("holder"), F.col("backup_of")),
        F.octet_length("content").cast("string"), F.lit(":"),
    )
    middle = F.concat(F.octet_length("backup").cast("string"), F.lit(":"))
    message = F.concat(utf8(head), F.col("content"), utf8(middle), F.col("backup"))
    return F.substring(hmac_hex(F.col("tag_in"), F.col("tag_out"), message), 1, TAG_DIGITS)


LEAST_RECORDS = 3


def validate_records(records: DataFrame, strict: bool = False, ring: DataFrame | None = None) -> DataFrame:
    """(owner_id, k, reason) of owners that cannot be sealed: fewer records than a single cycle of distinct partners needs.

    With ``ring`` also owners with records of an unknown key, which count apart from the
    rest.  In strict mode such owners raise an error.
    """
    unknown = F.lit(False) if ring is None else F.col("tag_in").isNull()
    rows = records if ring is None else with_key(records, ring)
    rejects = rows.groupBy("owner_id", unknown.alias("_unknown")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("_unknown") | (F.col("k") < LEAST_RECORDS))
    reason = F.when(F.col("_unknown"), "unknown key").otherwise(f"fewer than {LEAST_RECORDS} records")
    rejects = rejects.select("owner_id", "k", reason.alias("reason"))
    if strict and not rejects.isEmpty():
        raise ValueError(f"owners that cannot be sealed: {[(r.owner_id, r.reason) for r in rejects.limit(5).collect()]}")
    return rejects


def seal_records(records: DataFrame, ring: DataFrame, rows_per_bucket: int = CYCLE_BUCKET, strict: bool = False) -> DataFrame:
    """(owner_id, key_id, rec_key, content) -> the same plus holder, backup, backup_of, tag.

    Owners of more than ``rows_per_bucket`` records have their cycle cut into buckets, each
    owner into as many as its own size asks for; all others are sorted whole.  Owners of
    fewer than three records would be their own or each other's only partner; they, and
    records of a key the ring does not hold, are left out here and listed by
    ``validate_records`` (strict mode raises).
    """
    if strict:
        validate_records(records, strict=True, ring=ring)
    digest = hmac_hex(F.col("map_in"), F.col("map_out"), utf8(netstrings(F.col("owner_id"), F.col("rec_key"))))
    keep = records.columns
    keyed = with_key(records, ring, known_only=True).withColumn("_digest", digest).select(*keep, "_digest")
    hot = hot_groups(records, "owner_id", rows_per_bucket)
    ways = (["owner_id"], "_digest", "rec_key", ["rec_key"])
    back = ["rec_key", "content"]
    if hot.isEmpty():
        placed = cycle_neighbours(keyed, *ways, carry_prev=back)
    else:
        sized = keyed.join(broadcast_if_small(hot), "owner_id", "left")
        columns = [*keep, "_digest", "next_rec_key", "prev_rec_key", "prev_content"]
        cold = cycle_neighbours(sized.filter("buckets IS NULL"), *ways, carry_prev=back).select(*columns)
        large = sized.filter("buckets IS NOT NULL")
        placed = cold.unionByName(cycle_neighbours(large, *ways, digest_bucket("_digest", F.col("buckets")), back).select(*columns))
    # one record is its own partner and two are each other's: the only cycles whose neighbours coincide
    placed = placed.filter(F.col("next_rec_key") != F.col("prev_rec_key")).select(
        *keep, F.col("next_rec_key").alias("holder"),
        F.col("prev_content").alias("backup"), F.col("prev_rec_key").alias("backup_of"),
    )
    return with_key(placed, ring).withColumn("tag", record_tag()).select(*placed.columns, "tag")


def check_records(received: DataFrame, ring: DataFrame) -> DataFrame:
    """Row-local; runs on batch and streaming frames alike.

    Every received row comes back.  ``flagged`` is never null, and ``reason`` says why a row
    is flagged: ``unknown key``, ``no tag`` or ``tag differs``, the last also where a field
    that the tag vouches for is null.
    """
    reason = (
        F.when(F.col("tag_in").isNull(), "unknown key").when(F.col("tag").isNull(), "no tag")
        .when(F.col("fresh_tag").isNull() | (F.col("tag") != F.col("fresh_tag")), "tag differs")
    )
    return (
        with_key(received, ring)
        .withColumn("fresh_tag", record_tag())
        .withColumn("reason", reason)
        .withColumn("flagged", F.col("reason").isNotNull())
        .select(*received.columns, "fresh_tag", "flagged", "reason")
    )


def repair_records(checked: DataFrame) -> DataFrame:
    """Flagged records take their content from the backup an intact partner carries.

    ``backup_of`` is bound by the partner's tag, so an unflagged partner really backs up
    the record it names.  The join key is a record key, unique per owner: no key is hot.
    """
    held = checked.filter(~F.col("flagged")).groupBy("owner_id", F.col("backup_of").alias("rec_key")).agg(
        F.max("backup").alias("_backup")
    )
    fixed = checked.filter("flagged").select("owner_id", "rec_key", "flagged").join(
        held, ["owner_id", "rec_key"], "left"
    )
    fixed = fixed.select(
        "owner_id", "rec_key", "flagged",
        F.when(F.col("_backup").isNotNull(), "RECOVERED").otherwise("UNRECOVERABLE").alias("status"),
        F.col("_backup").alias("content"),
    )
    good = checked.filter(~F.col("flagged")).select(
        "owner_id", "rec_key", "flagged", F.lit("AUTHENTIC").alias("status"), "content"
    )
    return good.unionByName(fixed)


def record_summary(status: DataFrame) -> DataFrame:
    """Per owner: records, flagged, recovered, unrecoverable and rho."""
    return (
        status.groupBy("owner_id")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.count_if("flagged").alias("tampered"),
            F.count_if(F.col("status") == "RECOVERED").alias("recovered"),
            F.count_if(F.col("status") == "UNRECOVERABLE").alias("unrecoverable"),
        )
        .withColumn(
            "rho",
            F.when(F.col("tampered") == 0, F.lit(1.0)).otherwise(
                1.0 - F.col("unrecoverable") / F.greatest(F.col("tampered"), F.lit(1))
            ),
        )
    )
