"""The archive of sealed records: upsert, lookup, identification and checked verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.pixels import to_bytes
from ..sources.keyring import with_key
from . import score, verify
from .index import place
from .seal import tag_hex

MIN_VERIFYING = 8


def upsert(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per content hash: the first id stays, name and time follow the latest arrival.

    Copies of one content may be a large share of all rows; the aggregate combines them
    before the shuffle.
    """
    return (
        library.unionByName(incoming)
        .groupBy("sha256")
        .agg(
            F.min("id").alias("id"), F.max_by("name", F.struct("created_at", "id")).alias("name"),
            F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("arrivals"),
        )
    )


def delete(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids, "id", "left_anti")


def listing(library: DataFrame) -> DataFrame:
    """Newest first, without block content."""
    return library.drop("content").orderBy(F.desc("id"))


def by_hash(received: DataFrame, library: DataFrame) -> DataFrame:
    """Record whose bytes are the same, if any; the library has one row per hash."""
    found = library.select("sha256", F.col("id").alias("record_id"))
    return received.join(found, "sha256", "left").withColumn("byte_identical", F.col("record_id").isNotNull())


def picture_hash(blocks: DataFrame, keys: list[str], px: str = "px") -> DataFrame:
    """Content hash of a page: hash of its blocks' hashes in order.  A page is bounded by the carrier."""
    digest = F.sha2(to_bytes(F.col(px)), 256)
    return blocks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ch", "idx", digest.alias("h")))).alias("_all")
    ).select(*keys, F.sha2(F.array_join(F.transform("_all", lambda s: s["h"]), ""), 256).alias("sha256"))


def identify(received: DataFrame, archive: DataFrame | None, records: DataFrame, ring: DataFrame, variant: str,
             block: int = 8, index: DataFrame | None = None) -> DataFrame:
    """Best and second-best record per received set, with the number of blocks that verify.

    A received block counts for a record when the archive holds the tag it carries at the
    same place and the record's key and identity reproduce that tag.  So candidates come
    from an equi-join on (shape, channel, index, carried tag), whose keys are keyed hashes
    and cannot be hot, and each is confirmed by recomputing the tag.  Testing every record
    of a shape against every block would be a product.  Blocks that a newer version sealed
    under the same identity and key changed are therefore not credited to the older record.
    Every received set is listed, whichever of its blocks are missing.

    ``index`` (``write_index``) stands for the archive where one is stored: its side of the
    join is then neither shuffled nor sorted.

    received: (query_id, height, width, ch, idx, px); archive: (record_id, ch, idx, tag);
    records: (record_id, owner_id, key_id, height, width, n_blocks, n_channels).
    """
    n_tag = len(_tag_bytes(block))
    carried = received.withColumn("_low", _payload(block)).select(
        "query_id", "height", "width", "ch", "idx", "px",
        F.lower(F.hex(F.substring("_low", 1, n_tag))).alias("tag"),
        F.substring("_low", n_tag + 1, 64).alias("stored_desc"),
    )
    if index is not None:
        pairs = carried.withColumn("place", place("height", "width", "ch", "idx", "tag")).join(index, "place")
    else:
        # record fields first, so that the join sees the shape on both sides
        stored = archive.select("record_id", "ch", "idx", "tag").join(
            records.select("record_id", "owner_id", "key_id", "height", "width", "n_blocks", "n_channels"), "record_id"
        )
        pairs = carried.join(stored, ["height", "width", "ch", "idx", "tag"])
    fresh = tag_hex(variant, block, F.col("px"), F.col("stored_desc"))
    sure = with_key(pairs, ring).filter(fresh == F.col("tag"))
    per_block = sure.groupBy("query_id", "record_id", "n_channels", "idx").agg(F.countDistinct("ch").alias("_c"))
    counts = per_block.filter(F.col("_c") == F.col("n_channels")).groupBy("query_id", "record_id").agg(
        F.count(F.lit(1)).alias("verifying")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("verifying"), F.desc("record_id"))
    top = counts.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("record_id"))).alias("best"),
        F.max(F.when(F.col("_rn") == 1, F.col("verifying"))).alias("verifying"),
        F.max(F.when(F.col("_rn") == 2, F.col("verifying"))).alias("runner_up"),
    )
    shapes = records.groupBy("height", "width").agg(F.count(F.lit(1)).alias("n_candidates"))
    asked = received.select("query_id", "height", "width").distinct().join(
        shapes, ["height", "width"], "left"
    )
    found = asked.join(top, "query_id", "left")
    verifying = F.coalesce("verifying", F.lit(0))
    return found.select(
        "query_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), verifying.alias("verifying"),
        F.when(F.col("n_candidates") >= 2, F.coalesce("runner_up", F.lit(0))).alias("runner_up"),
        F.when(verifying >= MIN_VERIFYING, F.col("best")).alias("record_id"),
    )


def _payload(block: int) -> Column:
    from ..functions.pixels import payload

    return payload(F.col("px"), block)


def _tag_bytes(block: int) -> bytes:
    from ..functions.pixels import budget

    return bytes(budget(block)[1] // 8)


def verify_against_library(received: DataFrame, archive: DataFrame, records: DataFrame, matches: DataFrame,
                           ring: DataFrame, variant: str, block: int = 8) -> DataFrame:
    """Verdict, byte identity, localization and agreement with the stored copy, per matched set.

    ``archive`` carries the stored pixels as px_stored next to (record_id, ch, idx).  Stored
    blocks that a received set lacks count as changed and flagged.
    """
    found = matches.filter(F.col("record_id").isNotNull()).select("query_id", "record_id")
    ids = found.join(records.select("record_id", "owner_id", "key_id"), "record_id")
    mine = received.join(ids, "query_id")
    checked = verify.check_tags(mine, ring, variant, block)
    mask = verify.localize(checked, extra=["query_id"])
    stored = found.join(archive.select("record_id", "ch", "idx", "px_stored"), "record_id")
    both = stored.join(checked.select("query_id", "record_id", "ch", "idx", "px"), ["query_id", "record_id", "ch", "idx"], "left")
    diff = F.when(F.col("px").isNull(), F.transform("px_stored", lambda y: F.lit(True))).otherwise(F.zip_with("px", "px_stored", lambda x, y: x != y))
    per_block = both.groupBy("query_id", "record_id", "idx").agg(F.collect_list(diff).alias("_ds")).withColumn(
        "_any",
        F.aggregate(F.slice("_ds", F.lit(2), F.size("_ds")), F.element_at("_ds", 1), lambda acc, s: F.zip_with(acc, s, lambda p, q: p | q)),
    ).withColumn("_changed", score.count_true("_any"))
    joined = per_block.join(mask.select("query_id", "idx", "flagged"), ["query_id", "idx"], "left")
    joined = joined.withColumn("flagged", F.coalesce("flagged", F.lit(True)))
    cells = score.confusion(F.col("flagged"), F.col("_changed") > 0)
    return joined.groupBy("query_id", "record_id").agg(
        F.count(F.lit(1)).alias("total_blocks"), F.count_if("flagged").alias("flagged_blocks"),
        F.sum("_changed").alias("changed_px"), *[c.alias(k) for k, c in cells.items()],
    ).withColumn("byte_identical", F.col("changed_px") == 0).withColumn(
        "verdict", F.when(F.col("flagged_blocks") > 0, "TAMPERED").otherwise("AUTHENTIC")
    )
