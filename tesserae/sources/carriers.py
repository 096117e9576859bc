"""Block tables cut from ordinary data.

Vectors become grey (or three-channel) images of 8x8 blocks with the payload in
their low bits; text chunks and records keep the payload in columns beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import netstrings, utf8
from ..functions.pixels import to_bytes
from ..operators.ordering import dense_index
from .tables import spread, table

GRID_COLUMNS = 6
PAGE_ROWS = 1024
CHUNK = 64


def quantize(vector: Column) -> Column:
    """Floats around zero -> bytes, half-even rounding, clipped to 0..255."""
    return F.transform(
        vector,
        lambda e: F.greatest(
            F.lit(0), F.least(F.lit(255), F.rint((e.cast("double") + 0.5) * 255).cast("int"))
        ).cast("int"),
    )


def _placed(spark: SparkSession, folder: str, channels: int, ncols: int) -> DataFrame:
    """Quantized vectors with their page, its block count k, channel and index in the page."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", quantize(F.col("embedding")).alias("px"))
    placed = dense_index(vectors, "label", "vec_id", out="pos", total="n")
    page_cells = PAGE_ROWS * ncols
    cell = F.floor(F.col("pos") / channels).cast("bigint")
    cells = F.floor(F.col("n") / channels).cast("bigint")
    page = F.floor(cell / page_cells).cast("bigint")
    in_page = F.least(F.lit(page_cells), cells - page * page_cells)
    return (
        placed.withColumn("page", page)
        .withColumn("k", (in_page - in_page % ncols).cast("bigint"))
        .withColumn("ch", (F.col("pos") % channels).cast("int"))
        .withColumn("idx", (cell - page * page_cells).cast("bigint"))
    )


def vector_blocks(spark: SparkSession, folder: str, channels: int = 1, ncols: int = GRID_COLUMNS) -> DataFrame:
    """embeddings -> (owner_id, key_id, stem, height, width, block, k, ncols, ch, idx, r, c, px).

    Consecutive vectors of a label fill pages of a block grid in raster order, three at a
    time for three channels.  A page has at most PAGE_ROWS block rows, so that its height
    fits the 16 bits the tag message gives it; every page is an owner of its own, and no
    owner can grow past that size however many rows its label holds.  Pages are cropped
    to whole rows, never padded; the vectors past the last whole row are
    ``vector_leftovers``, which are sealed as records.
    """
    return (
        _placed(spark, folder, channels, ncols)
        .filter(F.col("idx") < F.col("k"))
        .withColumn("height", F.floor(F.col("k") / ncols * 8).cast("bigint"))
        .withColumn("width", F.lit(ncols * 8).cast("bigint"))
        .withColumn("stem", F.concat(F.lit("vec"), F.col("label"), F.lit("p"), F.col("page")))
        .select(
            owner_id(F.col("stem"), F.col("height"), F.col("width"), F.lit(8)).alias("owner_id"),
            (F.col("label") % 5).cast("int").alias("key_id"),
            "stem", "label", "page", "height", "width",
            F.lit(8).alias("block"),
            "k",
            F.lit(ncols).cast("bigint").alias("ncols"),
            "ch", "idx",
            F.floor(F.col("idx") / ncols).cast("bigint").alias("r"),
            (F.col("idx") % ncols).cast("bigint").alias("c"),
            "px",
        )
    )


def vector_leftovers(spark: SparkSession, folder: str, channels: int = 1, ncols: int = GRID_COLUMNS) -> DataFrame:
    """The vectors that no whole grid row holds, as records (owner_id, key_id, rec_key, content), pooled by key."""
    key = (F.col("label") % 5).cast("int")
    return _placed(spark, folder, channels, ncols).filter(F.col("idx") >= F.col("k")).select(
        F.concat(F.lit("vec|rest|"), key).alias("owner_id"), key.alias("key_id"),
        F.col("vec_id").cast("string").alias("rec_key"), to_bytes(F.col("px")).alias("content"),
    )


def owner_id(stem: Column, height: Column, width: Column, block: Column) -> Column:
    """Identity given from outside, never from content: ``stem|HxW|B``."""
    return F.concat_ws("|", stem, F.concat(height, F.lit("x"), width), block.cast("string"))


def split_blocks(blocks: DataFrame) -> DataFrame:
    """8x8 blocks -> the same picture in 4x4 blocks (four rows per row, no shuffle)."""
    quarter = lambda qy, qx: F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.element_at(
            F.col("px"), ((F.floor(i / 4) + qy * 4) * 8 + i % 4 + qx * 4 + 1).cast("int")
        ),
    )
    parts = F.array(
        *[F.struct(F.lit(qy).alias("qy"), F.lit(qx).alias("qx"), quarter(qy, qx).alias("px"))
          for qy in (0, 1) for qx in (0, 1)]
    )
    ncols = F.col("ncols") * 2
    r, c = F.col("r") * 2 + F.col("q.qy"), F.col("c") * 2 + F.col("q.qx")
    return blocks.withColumn("q", F.explode(parts)).select(
        owner_id(F.col("stem"), F.col("height"), F.col("width"), F.lit(4)).alias("owner_id"),
        "key_id", "stem", "label", "page", "height", "width",
        F.lit(4).alias("block"),
        (F.col("k") * 4).alias("k"),
        ncols.alias("ncols"),
        "ch",
        (r * ncols + c).alias("idx"),
        r.alias("r"), c.alias("c"),
        F.col("q.px").alias("px"),
    )


def _texts(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    data = utf8(F.coalesce(F.col("text"), F.lit("")))
    return spread(table(spark, folder, name).select(key, "text"), key).select(
        F.col(key).alias("doc"), data.alias("data"), F.octet_length(data).cast("bigint").alias("size")
    ).withColumn("k", F.ceil(F.col("size") / CHUNK).cast("bigint"))


def text_chunks(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Whole texts in 64-byte chunks of UTF-8: (owner_id, key_id, k, remainder, idx, content).

    The last chunk holds what is left and may be shorter; nothing is padded or cut off.
    Texts of fewer than three chunks have no single cycle; they are ``short_texts``.
    """
    return (
        _texts(spark, folder, name, key).filter(F.col("k") >= 3)
        .withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
        .select(
            F.concat(F.lit("doc"), F.col("doc")).alias("owner_id"),
            (F.col("doc") % 5).cast("int").alias("key_id"),
            "k",
            (F.col("size") % CHUNK).alias("remainder"),
            "idx",
            F.substr(F.col("data"), (F.col("idx") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("content"),
        )
    )


def short_texts(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Texts too short for chunks of their own, as one record each, pooled by key."""
    return _texts(spark, folder, name, key).filter(F.col("k") < 3).select(
        F.concat(F.lit("doc|short|"), F.col("doc") % 5).alias("owner_id"), (F.col("doc") % 5).cast("int").alias("key_id"),
        F.col("doc").cast("string").alias("rec_key"), F.col("data").alias("content"),
    )


def cents(amount: Column) -> Column:
    return F.rint(amount * 100).cast("bigint")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _canonical(*fields: Column) -> Column:
    """Length-prefixed fields (``length:text``); numbers as decimal text of exact integers."""
    return utf8(netstrings(*fields))


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    """orders -> (owner_id = order month, key_id, rec_key, content)."""
    o = spread(table(spark, folder, "orders"), "o_orderkey")
    month = F.date_format(F.col("o_orderdate"), "yyyy-MM")
    return o.select(
        F.concat(F.lit("orders|"), month).alias("owner_id"),
        (F.month("o_orderdate") % 5).cast("int").alias("key_id"),
        F.col("o_orderkey").cast("string").alias("rec_key"),
        _canonical(
            F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), cents(F.col("o_totalprice")),
            micros(F.col("o_orderdate")), F.col("o_orderpriority"),
        ).alias("content"),
    )


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """events -> records owned by their user."""
    e = spread(table(spark, folder, "events"), "event_id")
    return e.select(
        F.concat(F.lit("user|"), F.col("user_id")).alias("owner_id"),
        (F.col("user_id") % 5).cast("int").alias("key_id"),
        F.col("event_id").cast("string").alias("rec_key"),
        _canonical(
            F.col("event_id"), micros(F.col("ts")), F.col("user_id"), F.col("event_type"),
            cents(F.col("value")), F.col("props"),
        ).alias("content"),
    )


def lineitem_records(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem -> records owned by their ship month; the whole key tuple names a record."""
    li = spread(table(spark, folder, "lineitem"), "l_orderkey")
    month = F.date_format(F.col("l_shipdate"), "yyyy-MM")
    return li.select(
        F.concat(F.lit("lineitem|"), month).alias("owner_id"),
        (F.month("l_shipdate") % 5).cast("int").alias("key_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rec_key"),
        _canonical(
            F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
            cents(F.col("l_quantity")), cents(F.col("l_extendedprice")), cents(F.col("l_discount")),
            cents(F.col("l_tax")), F.col("l_returnflag"), F.col("l_linestatus"), micros(F.col("l_shipdate")),
        ).alias("content"),
    )
