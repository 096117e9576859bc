"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are centred on the mean of a sample, scaled to length one, padded to ``bits``
dimensions and rotated at random; a code keeps the signs.  The code's direction and a
vector's differ by a known factor, stored beside it, which makes the inner product of code
and query an unbiased estimate of the vector's own, with an error bound that falls with the
number of bits.  In each block of codes, a query keeps the vectors whose upper bound
reaches the k-th largest lower bound and the k-th score it has, and scores those alone on
the original vectors.

Queries meet all vectors in blocks of fixed size.  Equal vectors take part once, with their
smallest identifiers, so that copies never meet as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.llm.frames import cut

BITS, SEED = 256, 20
#: Width of the error bound, in standard deviations of the estimate.
WIDTH = 3.5
#: Rows of a block of codes, and of a block of queries.
CODES_BLOCK, QUERY_BLOCK = 8192, 512
#: Tasks that share the blocks of codes a query block meets; each hands on one merged row a query and place.
WAYS = 2
#: Rows of the sample whose mean centres the codes; any centre gives right results, a good one gives tight bounds.
SAMPLE = 4096
BLOCK = "block long, ids binary, vectors binary, codes binary, factors binary"


@cache
def rotation(dimension: int, bits: int) -> np.ndarray:
    """(dimension, bits) part of a random rotation of ``bits`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimension].astype(np.float32)


def encode(vectors: np.ndarray, centre: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, and for each vector its distance from the centre, the factor code · direction, and the bound's scale."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(length > 0, length, 1)[:, None]
    turned = unit.astype(np.float32) @ rotation(vectors.shape[1], bits)
    signs = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(bits)
    factor = np.where(length > 0, np.maximum(factor, 1e-6), 1.0)
    error = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(bits - 1)
    return np.packbits(signs, axis=1), np.stack([length, factor, error], axis=1).astype(np.float32)


def bounds(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray, centre: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products (queries, vectors) and the half widths of their bounds."""
    turned = queries.astype(np.float32) @ rotation(queries.shape[1], bits)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    size = np.linalg.norm(queries, axis=1).astype(np.float32)
    raw = (turned @ (2 * signs - 1).T) / np.float32(math.sqrt(bits))
    estimate = (queries @ centre).astype(np.float32)[:, None] + raw * (factors[:, 0] / factors[:, 1])[None, :]
    half = WIDTH * size[:, None] * (factors[:, 0] * factors[:, 2])[None, :] + 1e-5 * size[:, None]
    return estimate, half


class _Best:
    """The nearest vectors met so far by each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, keep: int):
        self.ids, self.queries, self.keep = ids, queries, keep
        self.scores = np.full((len(ids), keep), -np.inf)
        self.found = np.full((len(ids), keep), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, factors: np.ndarray, centre: np.ndarray, bits: int) -> None:
        """Score exactly what may still be among the nearest: whose upper bound reaches the least kept, here or before."""
        count = min(self.keep, len(ids))
        for start in range(0, len(self.ids), 64):
            part = slice(start, start + 64)
            estimate, half = bounds(self.queries[part], codes, factors, centre, bits)
            least = np.partition(estimate - half, len(ids) - count, axis=1)[:, len(ids) - count] if count == self.keep else np.full(len(estimate), -np.inf)
            chosen = estimate + half >= np.maximum(least, self.scores[part, -1])[:, None]
            for q in np.flatnonzero(chosen.any(axis=1)):
                near = np.flatnonzero(chosen[q])
                score = np.concatenate([self.scores[start + q], vectors[near] @ self.queries[start + q]])
                known = np.concatenate([self.found[start + q], ids[near]])
                order = np.lexsort((known, -score))[:self.keep]
                self.scores[start + q], self.found[start + q] = score[order], known[order]

    def rows(self) -> pa.RecordBatch:
        held = self.found != np.iinfo(np.int64).max
        query = np.repeat(self.ids, held.sum(axis=1))
        return pa.record_batch([pa.array(query), pa.array(self.found[held]), pa.array(self.scores[held])], names=["q_rep", "rep", "score"])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite numbers, not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _least_ids(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows of the ``count`` smallest identifiers of each key, in two steps so that a hot key is never gathered whole."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy(*keys, "salt").orderBy("id")
    last = Window.partitionBy(*keys).orderBy("id")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= count)
    return rows.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= count).drop("n", "salt")


def search(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, bits: int = BITS,
) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` nearest other rows of each row for which ``is_query`` holds.

    Nearness is the inner product in double precision, largest first, ties to the smaller
    identifier; rows of the query's own identifier are no candidates.  Fewer candidates give
    all of them.  Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an identifier or of another dimension than most (of equally
    many, the larger).  Repeated rows count once; other columns are ignored; an empty table
    gives an empty result.
    """
    exact = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"   # what the vectors are stored as loses nothing
    kind = "query_id long, rank int, vec_id long, score double".replace("vec_id", id_col)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], kind)
    dimension, total = sizes["size"], sizes["count"]
    bits = max(bits, 8 * math.ceil(dimension / 8))
    rows = rows.filter(F.size("vector") == dimension).withColumn("key", F.xxhash64("vector"))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, (1 << 20) * SAMPLE // total)).limit(2 * SAMPLE).select("vector").collect()
    centre = np.mean([r.vector for r in sample], axis=0) if sample else np.zeros(dimension)

    # equal vectors: one representative, the smallest identifiers of candidates, every asking row
    named = cut(rows.groupBy("id", "key", "vector").agg(F.max("asks").alias("asks")))
    copies = cut(_least_ids(named.select("id", "key", "vector"), ["key", "vector"], k + 1))
    first = Window.partitionBy("key", "vector").orderBy("id")
    copies = copies.withColumn("rep", F.first("id").over(first)).withColumn("place", F.row_number().over(first))   # at most k + 1 rows a group
    distinct = cut(copies.filter("place = 1").select("rep", "vector", "key"))
    held = cut(copies.select("rep", "id"))
    asking = cut(named.filter("asks").select("id", "key", "vector").join(distinct, ["key", "vector"]).select(F.col("id").alias("query_id"), "rep"))
    queries = asking.select("rep").distinct().join(distinct.select("rep", "vector"), "rep")
    count = queries.count()
    if not count:
        return spark.createDataFrame([], kind)

    def block_of(size: int, prefix: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                vectors = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype="<f8").reshape(len(ids), dimension)
                for start in range(0, len(ids), size):
                    part = slice(start, start + size)
                    codes, factors = encode(vectors[part], centre, bits) if prefix else (np.zeros(0, np.uint8), np.zeros(0, np.float32))
                    values = [int(ids[start])], *[[x.tobytes()] for x in (ids[part], vectors[part].astype(exact), codes, factors)]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 4))], names=[c.split()[0] for c in BLOCK.split(", ")])

        return run

    # blocks of a fixed size, however many partitions there are
    codes = cut(distinct.select("rep", "vector").repartition(math.ceil(total / CODES_BLOCK)).mapInArrow(block_of(CODES_BLOCK, 1), BLOCK))
    asks = cut(queries.select("rep", "vector").repartition(math.ceil(count / QUERY_BLOCK)).mapInArrow(block_of(QUERY_BLOCK, 0), BLOCK))
    # a query block is followed by half of the blocks of codes in one task, by the rest in another; both merge as they go
    numbered = asks.join(asks.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("q_block")), "block")   # one small row a block is numbered
    ways = numbered.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)))).withColumn("kind", F.lit(0))
    meets = codes.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(asks.count() - 1)))).withColumn("way", F.pmod(F.xxhash64("block"), F.lit(WAYS)).cast("int")).withColumn("kind", F.lit(1))
    fields = ["q_block", "way", "kind", "ids", "vectors", "codes", "factors"]
    stream = ways.select(*fields).unionByName(meets.select(*fields)).repartition("q_block", "way").sortWithinPartitions("q_block", "way", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(n)[row].as_py() for n, name in enumerate(batch.schema.names)}
                ids, vectors = np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["vectors"], exact).reshape(-1, dimension).astype(np.float64)
                if cell["kind"] == 0:
                    if best is not None:
                        yield best.rows()
                    best = _Best(ids, vectors, k + 1)
                else:
                    best.meet(ids, vectors, np.frombuffer(cell["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(cell["factors"], np.float32).reshape(-1, 3), centre, bits)
        if best is not None:
            yield best.rows()

    found = stream.select("kind", "ids", "vectors", "codes", "factors").mapInArrow(scan, "q_rep long, rep long, score double")
    # each query's nearest k + 1 distinct vectors hold its nearest k rows besides itself
    nearest = Window.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    best = cut(found.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).drop("n"))
    rows = best.join(held, "rep").select("q_rep", "id", "score")
    order = Window.partitionBy("q_rep").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    each = rows.join(asking.withColumnRenamed("rep", "q_rep"), "q_rep").filter("id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
    )
