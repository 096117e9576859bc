"""Unbounded groups: bucketed ranks and cycles must equal the plain ones, and repair must be exact."""

import pytest
from pyspark.sql import Window, functions as F

from tesserae.functions.hashing import utf8
from tesserae.operators import records as rec
from tesserae.operators.ordering import cycle_neighbours, dense_index, dense_index_by_range, digest_bucket, hot_groups
from tesserae.session import materialize


def skewed(spark, n=3000):
    """A third of all rows belong to one owner."""
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), (F.col("id") % 97).cast("string"))).alias("owner_id"),
        (F.col("id") % 5).cast("int").alias("key_id"), F.col("id").cast("string").alias("rec_key"),
        utf8(F.concat(F.lit("content-"), F.col("id"))).alias("content"), F.col("id").alias("n"),
    )
    return df.withColumn("key_id", (F.crc32("owner_id") % 5).cast("int"))


def test_dense_index_equals_row_number(spark):
    df = skewed(spark)
    got = dense_index(df, "owner_id", "n", "pos", "total", width=64)
    w = Window.partitionBy("owner_id")
    want = df.withColumn("p", F.row_number().over(w.orderBy("n")) - 1).withColumn("t", F.count(F.lit(1)).over(w))
    both = got.select("n", "pos", "total").join(want.select("n", "p", "t"), "n")
    assert both.count() == df.count() and both.filter("pos <> p OR total <> t").count() == 0


def test_sparse_keys_spread_over_ranges(spark):
    """64-bit hashes as keys, a third of them in one group, and a group without a name."""
    df = skewed(spark).withColumn("n", F.xxhash64("rec_key")).withColumn("owner_id", F.when(F.col("owner_id") != "o5", F.col("owner_id")))
    w = Window.partitionBy("owner_id")
    want = df.withColumn("p", F.row_number().over(w.orderBy("n")) - 1).withColumn("t", F.count(F.lit(1)).over(w))
    for ranges in (1, 16):
        got = dense_index_by_range(df, "owner_id", "n", "pos", "total", ranges)
        both = got.select("n", "pos", "total").join(want.select("n", "p", "t"), "n")
        assert both.count() == df.count() and both.filter("pos <> p OR total <> t").count() == 0
    assert materialize(df.repartitionByRange(16, "owner_id", "n").withColumn("b", F.spark_partition_id())).filter("owner_id = 'hot'").select("b").distinct().count() > 3


def test_bucketed_cycle_equals_plain(spark):
    df = materialize(skewed(spark).withColumn("d", F.sha2(F.col("rec_key"), 256)))
    plain = cycle_neighbours(df, ["owner_id"], "d", "rec_key", ["rec_key"])
    for buckets in (1, 7, 500):
        cut = cycle_neighbours(df, ["owner_id"], "d", "rec_key", ["rec_key"], digest_bucket("d", buckets))
        both = plain.select("rec_key", "next_rec_key", "prev_rec_key").join(
            cut.select("rec_key", F.col("next_rec_key").alias("a"), F.col("prev_rec_key").alias("b")), "rec_key"
        )
        assert both.count() == df.count()
        assert both.filter("next_rec_key <> a OR prev_rec_key <> b").count() == 0


def test_only_hot_owners_are_cut(spark, ring):
    df = skewed(spark)
    assert {(r.owner_id, r.buckets) for r in hot_groups(df, "owner_id", 100).collect()} == {("hot", 10)}
    plain = materialize(rec.seal_records(df.drop("n"), ring))
    for rows in (100, 7):
        cut = rec.seal_records(df.drop("n"), ring, rows_per_bucket=rows)
        assert cut.exceptAll(plain).isEmpty() and cut.count() == plain.count() == df.count()


def test_small_owners_are_rejected(spark, ring):
    rows = [("one", "a"), ("two", "a"), ("two", "b"), ("three", "a"), ("three", "b"), ("three", "c")]
    df = spark.createDataFrame(rows, "owner_id string, rec_key string").select("owner_id", F.lit(0).alias("key_id"), "rec_key", utf8(F.col("rec_key")).alias("content"))
    assert {r.owner_id for r in rec.seal_records(df, ring).collect()} == {"three"}
    assert {(r.owner_id, r.k) for r in rec.validate_records(df).collect()} == {("one", 1), ("two", 2)}
    with pytest.raises(ValueError):
        rec.seal_records(df, ring, strict=True)


def test_records_repair_is_exact(spark, ring):
    df = skewed(spark)
    s = materialize(rec.seal_records(df.drop("n"), ring, rows_per_bucket=60))
    assert rec.check_records(s, ring).filter("flagged").count() == 0
    hit = F.crc32("rec_key") % 10 == 0
    damaged = s.withColumn("content", F.when(hit, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    fixed = materialize(rec.repair_records(rec.check_records(damaged, ring)))
    assert fixed.count() == df.count()
    assert fixed.filter("flagged").count() == df.filter(F.crc32("rec_key") % 10 == 0).count()
    joined = fixed.join(df.select("rec_key", F.col("content").alias("was")), "rec_key")
    assert joined.filter("status = 'RECOVERED' AND content <> was").count() == 0
    lost = joined.filter("status = 'UNRECOVERABLE'")
    holders = s.select("owner_id", F.col("backup_of").alias("rec_key"), F.col("rec_key").alias("by"))
    assert lost.join(holders, ["owner_id", "rec_key"]).filter(F.crc32("by") % 10 != 0).count() == 0


def test_sidecar_fields_are_bound(spark, ring):
    s = materialize(rec.seal_records(skewed(spark, 1500).drop("n"), ring))
    x = F.lit("x")
    for name, value in {
        "holder": F.concat("holder", x), "backup_of": F.concat("backup_of", x), "rec_key": F.concat("rec_key", x),
        "owner_id": F.concat("owner_id", x), "backup": F.concat("backup", F.lit(b"x")), "content": F.concat("content", F.lit(b"x")),
    }.items():
        assert rec.check_records(s.withColumn(name, value), ring).filter("NOT flagged").count() == 0, name


def test_streaming_check(spark, ring, tmp_path):
    from tesserae.streaming.tag_check import SEALED, flag_rates, read_sealed

    s = rec.seal_records(skewed(spark, 1500).drop("n"), ring)
    hit = F.crc32("rec_key") % 4 == 0
    s = s.withColumn("content", F.when(hit, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    s = s.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("rec_key").cast("bigint") * 60))
    cols = [c.split()[0] for c in SEALED.split(", ")]
    s.select(*cols).write.parquet(str(tmp_path / "in"))
    q = flag_rates(read_sealed(spark, str(tmp_path / "in")), ring).writeStream.format("memory").queryName("rates").outputMode(
        "complete"
    ).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) AS n, sum(flagged) AS f FROM rates").first()
    assert got["n"] == 1500 and got["f"] == s.filter(F.crc32("rec_key") % 4 == 0).count()
