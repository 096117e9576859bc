"""An index of the archive by the tags its blocks carry, so that looking records up never moves the archive.

The archive is written once, bucketed and sorted by place: shape, channel, index and tag in
one key.  A lookup sends the received blocks, which are few, to the buckets; the archive
is neither shuffled nor sorted.  The files are an ordinary Spark table at a path of the
caller's; another session opens them by the same call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 32
COLUMNS = "place string, record_id bigint, owner_id string, key_id int, n_channels int"


def place(height: str, width: str, ch: str, idx: str, tag: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in (height, width, ch, idx, tag)])


def _name(path: str) -> str:
    return f"archive_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def write_index(archive: DataFrame, records: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write the index of ``archive(record_id, ch, idx, tag)`` and ``records`` to a new ``path`` and open it.

    Every task writes to each bucket, so rows are first dealt to their buckets: one file a
    bucket.  A bucket's size falls with their number; tags are keyed hashes, so none is hot.
    """
    rows = archive.select("record_id", "ch", "idx", "tag").join(records.select("record_id", "owner_id", "key_id", "height", "width", "n_channels"), "record_id")
    rows = rows.select(place("height", "width", "ch", "idx", "tag").alias("place"), "record_id", "owner_id", F.col("key_id").cast("int").alias("key_id"), F.col("n_channels").cast("int").alias("n_channels"))
    spark = archive.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")   # an external table: its files stay
    rows.repartition(buckets, "place").write.format("parquet").option("path", path).bucketBy(buckets, "place").sortBy("place").saveAsTable(_name(path))
    return spark.table(_name(path))


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The index another session wrote to ``path`` with the same number of buckets."""
    if not spark.catalog.tableExists(_name(path)):
        spark.sql(f"CREATE TABLE {_name(path)} ({COLUMNS}) USING parquet CLUSTERED BY (place) SORTED BY (place) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))
