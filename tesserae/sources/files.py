"""Binary files and pinned manifests: format census, gates, verification and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_PIXELS = 40_000_000
MAX_PAGES = 20

# Leading bytes of the known formats, as hex (format, offset in bytes, bytes).
MAGIC = (
    ("png", ((0, "89504E470D0A1A0A"),)),
    ("jpeg", ((0, "FFD8FF"),)),
    ("bmp", ((0, "424D"),)),
    ("tiff", ((0, "49492A00"),)),
    ("tiff", ((0, "4D4D002A"),)),
    ("webp", ((0, "52494646"), (8, "57454250"))),
    ("gif", ((0, "474946383761"),)),
    ("gif", ((0, "474946383961"),)),
    ("pdf", ((0, "25504446"),)),
)
LOSSLESS = ("png", "bmp", "tiff")
LOSSY = ("jpeg", "webp", "gif")

MANIFEST = "dataset string, filename string, relpath string, width int, height int, channels int, sha256 string, source_url string, fetched_utc string"


def sniff(content: Column) -> Column:
    """Format from leading bytes, never from a name."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for fmt, marks in MAGIC:
        hit = None
        for at, text in marks:
            one = F.substring(head, 2 * at + 1, len(text)) == text
            hit = one if hit is None else hit & one
        out = F.when(hit, fmt) if out is None else out.when(hit, fmt)
    return out.otherwise("unknown")


def with_format(files: DataFrame) -> DataFrame:
    """Adds fmt and rejected: lossy formats cannot carry a payload and stop before any decoding."""
    fmt = sniff(F.col("content"))
    return files.withColumn("fmt", fmt).withColumn("rejected", F.col("fmt").isin(*LOSSY))


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def page_numbers(pages: Column, limit: int = MAX_PAGES) -> Column:
    """Pages of a file that are read: the first ``limit`` of them."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(pages, F.lit(limit))))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image source; files it cannot decode come as rows of negative size."""
    return spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")


def image_rejects(img: DataFrame, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(origin, reason) of pictures that are not read: undecodable, or of too many pixels."""
    size = F.col("height").cast("bigint") * F.col("width")
    reason = F.when((F.col("height") <= 0) | (F.col("width") <= 0), "not decodable").when(size > max_pixels, f"more than {max_pixels} pixels")
    return img.select("origin", reason.alias("reason")).filter("reason IS NOT NULL")


def image_pixels(spark: SparkSession, folder: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Spark's image source as RGB planes: (origin, height, width, channels, ch, data); the rest are ``image_rejects``.

    The source hands out interleaved samples in blue-green-red order; a fourth channel is
    opacity, which the planes do without.
    """
    size = F.col("height").cast("bigint") * F.col("width")
    img = images(spark, folder).filter((F.col("height") > 0) & (F.col("width") > 0) & (size <= max_pixels))
    return img.select(
        "origin", "height", "width", F.col("nChannels").alias("channels"), "data",
        F.explode(F.sequence(F.lit(0), F.least("nChannels", F.lit(3)) - 1)).alias("ch"),
    ).withColumn("sample", F.when(F.col("channels") >= 3, F.lit(2) - F.col("ch")).otherwise(F.col("ch")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def verify_manifest(pinned: DataFrame, files: DataFrame) -> DataFrame:
    """(relpath, status): OK, MISSING, HASH MISMATCH, or EXTRA for files nobody pinned."""
    actual = files.select("relpath", F.col("sha256").alias("_now"))
    status = (
        F.when(F.col("sha256").isNull(), "EXTRA").when(F.col("_now").isNull(), "MISSING")
        .when(F.col("_now") != F.col("sha256"), "HASH MISMATCH").otherwise("OK")
    )
    return pinned.select("relpath", "dataset", "sha256").join(actual, "relpath", "full").withColumn("status", status)


def check_roster(statuses: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(dataset, expected, found) of a verified manifest; raises where a dataset has fewer good files than expected."""
    found = {r["dataset"]: r["n"] for r in statuses.filter("status = 'OK'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("dataset").isin(*expected)).collect()}
    short = {k: f"{found.get(k, 0)} of {n}" for k, n in expected.items() if found.get(k, 0) < n}
    if short:
        raise ValueError(f"incomplete datasets: {short}")
    return statuses.sparkSession.createDataFrame([(k, n, found.get(k, 0)) for k, n in expected.items()], "dataset string, expected bigint, found bigint")


def write_blocks(blocks: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write sealed blocks, by owner, to a format that keeps every bit; lossy targets are refused.

    The payload lives in the lowest bits: one changed sample is a broken seal.
    """
    if fmt.lower() in LOSSY:
        raise ValueError(f"{fmt} does not keep every bit; sealed blocks cannot be written to it")
    blocks.write.format(fmt).partitionBy("label").save(path)


def merge_manifest(existing: DataFrame, processed: DataFrame, order: list[str]) -> DataFrame:
    """Processed rows replace rows of the same path; the rest is kept; known datasets come first."""
    kept = existing.join(processed.select("relpath"), "relpath", "left_anti")
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("dataset"))
    rank = F.when(rank == 0, F.lit(99)).otherwise(rank - 1)
    return kept.unionByName(processed).withColumn("dataset_rank", rank)
