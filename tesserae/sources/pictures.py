"""Pictures as rows of blocks, straight from the bytes of files, and back.

Uncompressed BMP (8-bit grey or 24-bit colour) and binary PGM and PPM are laid out so simply
that their samples are found by position; rows of blocks are cut from a file's bytes by
column expressions.  Anything compressed needs a decoder and is a reject here.  The input is
a table (path, content), as Spark's ``binaryFile`` source reads it from any store; filters
on the path reach that source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pixels import from_bytes, to_bytes
from .carriers import owner_id
from .files import MAX_PIXELS

#: Bytes read of a file for its header.
HEAD = 512


def _little(head: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number at a byte position of a hex text."""
    parts = [F.substring(head, 2 * (at + k) + 1, 2) for k in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def with_layout(files: DataFrame, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Adds fmt, width, height, channels, start, stride, upward, turned and reason (null where the picture can be read).

    ``upward`` files hold their last row first, ``turned`` ones blue before red; ``stride``
    is the length of a row of samples in the file.  The size is checked before any sample is
    read.  Null contents are rejects like any other unknown format.
    """
    head = F.hex(F.substring("content", 1, HEAD))
    text = F.decode(F.substring("content", 1, HEAD), "ISO-8859-1")
    gap = r"(?:\s|#[^\n]*\n)+"
    pnm = rf"^P([56]){gap}([0-9]{{1,9}}){gap}([0-9]{{1,9}}){gap}([0-9]{{1,5}})\s"
    part = lambda k: F.regexp_extract(F.col("_text"), pnm, k)
    rows = files.withColumn("_head", head).withColumn("_text", text).withColumn("_bits", _little(F.col("_head"), 28, 2)).withColumn("_high", _little(F.col("_head"), 22, 4))
    bmp = F.coalesce(F.startswith("_head", F.lit("424D")) & (F.length("_head") >= 2 * 34), F.lit(False))
    rows = rows.withColumn("fmt", F.when(bmp, "bmp").when(part(1) == "5", "pgm").when(part(1) == "6", "ppm"))
    is_bmp = F.col("fmt") == "bmp"
    high = F.when(F.col("_high") >= 1 << 31, F.col("_high") - (1 << 32)).otherwise(F.col("_high"))
    number = lambda k: part(k).try_cast("long")
    rows = rows.withColumns({
        "width": F.when(is_bmp, _little(F.col("_head"), 18, 4)).otherwise(number(2)), "height": F.when(is_bmp, F.abs(high)).otherwise(number(3)),
        "channels": F.when(is_bmp, F.when(F.col("_bits") == 8, 1).otherwise(3)).otherwise(F.when(F.col("fmt") == "pgm", 1).otherwise(3)),
        "start": F.when(is_bmp, _little(F.col("_head"), 10, 4)).otherwise(F.length(F.regexp_extract(F.col("_text"), pnm, 0)).cast("long")),
        "upward": F.coalesce(is_bmp & (high > 0), F.lit(False)), "turned": F.coalesce(is_bmp, F.lit(False)),
    })
    rows = rows.withColumn("stride", F.when(is_bmp, F.floor((F.col("width") * F.col("channels") + 3) / 4) * 4).otherwise(F.col("width") * F.col("channels")).cast("long"))
    depth = F.when(is_bmp, ~F.col("_bits").isin(8, 24) | (_little(F.col("_head"), 30, 4) != 0)).otherwise(number(4) != 255)
    reason = (
        F.when(F.col("fmt").isNull(), "format").when(F.coalesce(depth, F.lit(True)), "depth or compression")
        .when((F.col("width") < 1) | (F.col("height") < 1), "size").when(F.col("width") * F.col("height") > max_pixels, f"more than {max_pixels} pixels")
        .when(F.octet_length("content") < F.col("start") + F.col("stride") * F.col("height"), "cut short")
    )
    return rows.withColumn("reason", reason).drop("_head", "_text", "_bits", "_high")


def picture_rejects(files: DataFrame, block: int = 8, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(path, reason) of every file that gives no blocks."""
    rows = with_layout(files, max_pixels)
    small = (F.col("width") < block) | (F.col("height") < block)
    return rows.select("path", F.when(F.col("reason").isNull() & small, "smaller than a block").otherwise(F.col("reason")).alias("reason")).filter("reason IS NOT NULL")


def picture_blocks(files: DataFrame, stem: Column | None = None, key_id: Column | None = None, block: int = 8, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Blocks of all readable pictures, with the columns of ``vector_blocks``, raster order, cropped at the bottom and right.

    A file becomes stripes of ``block`` pixel rows first, then blocks, so only a stripe is
    held beside the file itself.  Samples come out as red, green, blue or grey.  ``stem``
    names the owner (the path by default); files of one name are one owner, so names must
    differ.  Files that cannot be read are ``picture_rejects``.
    """
    rows = with_layout(files, max_pixels).filter(f"reason IS NULL AND width >= {block} AND height >= {block}")
    rows = rows.withColumns({"_stem": stem if stem is not None else F.col("path"), "_key": (key_id if key_id is not None else F.lit(0)).cast("int")})
    low = F.when(F.col("upward"), F.col("height") - (F.col("_i") + 1) * block).otherwise(F.col("_i") * block)   # first row of a stripe in the file
    nrows, ncols = F.floor(F.col("height") / block).cast("long"), F.floor(F.col("width") / block).cast("long")
    stripes = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), nrows - 1))).select(
        "_stem", "_key", "channels", "upward", "turned", "stride", (nrows * block).alias("height"), (ncols * block).alias("width"), (nrows * ncols).alias("k"), ncols.alias("ncols"),
        F.col("_i").alias("r"), F.substr("content", (F.col("start") + low * F.col("stride") + 1).cast("int"), (F.col("stride") * block).cast("int")).alias("_bytes"),
    )
    cells = stripes.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ncols") - 1)))
    place = lambda y: F.when(F.col("upward"), F.lit(block - 1) - y).otherwise(y)
    row = lambda y: F.substr("_bytes", (place(y) * F.col("stride") + F.col("c") * block * F.col("channels") + 1).cast("int"), (F.col("channels") * block).cast("int"))
    samples = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda y: from_bytes(row(y))))
    planes = cells.withColumn("_s", samples).drop("_bytes").withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    turn = F.when(F.col("turned") & (F.col("channels") == 3), F.lit(2) - F.col("ch")).otherwise(F.col("ch"))
    px = F.transform(F.sequence(F.lit(0), F.lit(block * block - 1)), lambda i: F.element_at("_s", (i * F.col("channels") + turn + 1).cast("int")))
    return planes.select(
        owner_id(F.col("_stem"), F.col("height"), F.col("width"), F.lit(block)).alias("owner_id"), F.col("_key").alias("key_id"), F.col("_stem").alias("stem"),
        F.lit(0).alias("label"), F.lit(0).cast("long").alias("page"), "height", "width", F.lit(block).alias("block"), "k", "ncols", "ch",
        (F.col("r") * F.col("ncols") + F.col("c")).alias("idx"), "r", "c", px.alias("px"),
    )


def to_pictures(blocks: DataFrame, px: str = "px") -> DataFrame:
    """(owner_id, content): each owner's blocks as an uncompressed BMP, which keeps every bit of a sealed picture.

    Rows are written first to last; grey owners (one channel) as equal colours.  A task puts
    together one row of blocks, then one owner's rows, whose size the carrier bounds.
    Owners that lack a block have no picture.
    """
    keys = ["owner_id", "height", "width", "block", "k", "ncols"]
    rows = blocks.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(F.struct("c", "ch", F.col(px).alias("px")))).alias("cells"), F.max("ch").alias("top"))
    rows = rows.filter(F.size("cells") == F.col("ncols") * (F.col("top") + 1))
    block = F.col("block")
    sample = lambda x, y, plane: F.element_at(
        F.element_at("cells", (F.floor(x / block) * (F.col("top") + 1) + F.when(F.col("top") == 0, 0).otherwise(F.lit(2 - plane)) + 1).cast("int"))["px"], (y * block + x % block + 1).cast("int"),
    )
    line = lambda y: F.flatten(F.transform(F.sequence(F.lit(0), (F.col("width") - 1).cast("int")), lambda x: F.array(*[sample(x, y, plane) for plane in range(3)])))
    padding = F.array_repeat(F.lit(0), ((4 - F.col("width") * 3 % 4) % 4).cast("int"))
    stripe = F.flatten(F.transform(F.sequence(F.lit(0), (block - 1).cast("int")), lambda y: F.concat(line(y), padding)))
    hexed = rows.select(*keys, "r", F.hex(to_bytes(stripe)).alias("h"))
    whole = hexed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "h"))).alias("s")).filter(F.size("s") * F.col("ncols") == F.col("k"))
    body = F.array_join(F.transform("s", lambda s: s["h"]), "")
    number = lambda v, size: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])
    wide = lambda v: F.lit(v).cast("long")
    size = (F.floor((F.col("width") * 3 + 3) / 4) * 4 * F.col("height")).cast("long")
    head = F.concat(
        F.lit("424D"), number(size + 54, 4), number(wide(0), 4), number(wide(54), 4), number(wide(40), 4), number(F.col("width").cast("long"), 4),
        number((-F.col("height")).cast("long"), 4), number(wide(1), 2), number(wide(24), 2), number(wide(0), 4), number(size, 4), *[number(wide(v), 4) for v in (2835, 2835, 0, 0)],
    )
    return whole.select("owner_id", F.unhex(F.concat(head, body)).alias("content"))
