"""The library as a stored table: versions, of which each rewrites only the partitions it touches.

Records fall into a fixed number of partitions by their content hash.  A change reads and
writes the partitions of the records it brings, under a new version; a pointer table of one
row a partition then says which version holds each.  A version exists once its pointer is
whole, so readers see the state before or after a change, older versions stay readable, and
a change that dies half-way leaves nothing but files nobody points to.  Of two writers of
the same version the second fails; so does one behind a torn pointer, until ``discard``.

    data/v=<version>/p=<partition>/...    records
    pointer/v=<version>/...               (p, v): where each partition is, written last
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORD = "sha256 string, id bigint, name string, created_at bigint, arrivals bigint"
PARTITIONS = 64


def partition_of(partitions: int) -> Column:
    return F.pmod(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("bigint"), F.lit(partitions)).cast("int")


class Library:
    """A library under ``path``; ``partitions`` is fixed when the first version is written."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = PARTITIONS):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions

    def versions(self) -> list[int]:
        """Versions whose pointer is whole."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer/v=*/_SUCCESS")
        found = done.getFileSystem(conf).globStatus(done) or []
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)

    def pointer(self, version: int | None = None) -> dict[int, int]:
        """Version that holds each partition; at most one entry a partition."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"version {version} does not exist")
        if not known:
            return {}
        return {r.p: r.held for r in self.spark.read.parquet(f"{self.path}/pointer/v={known[-1] if version is None else version}").collect()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Records of a version (the newest by default), of some partitions or all; other partitions are not opened."""
        held = self.pointer(version)
        paths = [f"{self.path}/data/v={v}/p={p}" for p, v in sorted(held.items()) if only is None or p in only]
        schema = self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(schema.schema).parquet(*paths) if paths else schema

    def discard(self) -> list[int]:
        """Remove pointers that never got whole; for when their writers are known to be dead, as the next change waits for it."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        every = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer/v=*")
        fs, known = every.getFileSystem(conf), self.versions()
        torn = [f.getPath() for f in fs.globStatus(every) or [] if int(f.getPath().getName()[2:]) not in known]
        for folder in torn:
            fs.delete(folder, True)
        return sorted(int(folder.getName()[2:]) for folder in torn)

    def _write(self, rows: DataFrame, touched: set[int]) -> int:
        held, known = self.pointer(), self.versions()
        version = (known[-1] if known else 0) + 1
        kept = rows.withColumn("p", partition_of(self.partitions))
        kept.repartition("p").sortWithinPartitions("p", "sha256").write.mode("overwrite").partitionBy("p").parquet(f"{self.path}/data/v={version}")
        filled = {r.p for r in self.spark.read.parquet(f"{self.path}/data/v={version}").select("p").distinct().collect()} if touched and not kept.isEmpty() else set()
        held = {p: v for p, v in held.items() if p not in touched} | {p: version for p in filled}
        pointer = self.spark.createDataFrame(sorted(held.items()), "p int, held int").coalesce(1)
        pointer.write.parquet(f"{self.path}/pointer/v={version}")   # fails if another writer was first
        return version

    def upsert(self, incoming: DataFrame) -> int:
        """One row per content hash: the first id stays, name and time follow the latest arrival; returns the new version.

        ``incoming`` has sha256, id, name and created_at.  Copies of one content are combined
        before the shuffle.  Rows without a hash are an error of the caller and raise one.
        """
        hashed = F.when(F.col("sha256").isNull(), F.raise_error(F.lit("a record without a content hash")).cast("string")).otherwise(F.col("sha256"))
        new = incoming.select(hashed.alias("sha256"), "id", "name", "created_at", F.lit(1).cast("bigint").alias("arrivals"))
        touched = {r.p for r in new.select(partition_of(self.partitions).alias("p")).distinct().collect()}
        if not touched:
            return (self.versions() or [0])[-1]
        both = self.read(only=touched).unionByName(new)
        merged = both.groupBy("sha256").agg(
            F.min("id").alias("id"), F.max_by("name", F.struct("created_at", "id")).alias("name"), F.max("created_at").alias("created_at"), F.sum("arrivals").alias("arrivals"),
        )
        return self._write(merged, touched)

    def delete(self, ids: DataFrame) -> int:
        """Remove records by id; returns the new version, or the present one where none of the ids is known."""
        gone = ids.select("id").distinct()
        touched = {r.p for r in self.read().join(gone, "id", "left_semi").select(partition_of(self.partitions).alias("p")).distinct().collect()}
        if not touched:
            return (self.versions() or [0])[-1]
        return self._write(self.read(only=touched).join(gone, "id", "left_anti"), touched)
