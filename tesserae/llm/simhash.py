"""Near duplicates by SimHash: pigeonhole blocks find close fingerprints, Hamming distance confirms them.

A fingerprint bit is 1 where over half of the text's feature hashes have it.  Two 64-bit
fingerprints that differ in at most d bits agree on at least s of b blocks whenever
b - s >= d.  So every choice of s blocks is a join key, pairs that share a key are
candidates, and only those within d bits are links.  Everything works on distinct
fingerprints; copies of a text never meet as pairs.

Buckets of few fingerprints are joined with themselves.  Larger ones are dealt out in
cells of bounded size, each compares all its pairs with numpy and returns one link for
each member of a connected group, so output stays linear while no link is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from xxhash import xxh64_intdigest

from tesserae.llm.components import components
from tesserae.llm.frames import broadcast_if_small, claim, cut, drop, free_name, release, tidy

SEED = 42
#: Buckets up to this size are joined in the JVM; larger ones go to cells of about CELL fingerprints.
SMALL_BUCKET, CELL = 32, 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = np.arange(8) * 256


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of 64-bit hashes; none: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):   # any length in bounded memory
        part = hashes[start:start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        seen = np.bincount((part + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ _BITS).ravel()
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; fewer words: of the whole sequence."""
    words = (text or "").encode("utf-8").lower().split()   # of bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    count = max(1, len(words) - width + 1)
    grams = [b" ".join(words)] if count == 1 else map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=count)


def weighted_words(text: str | None) -> int:
    """Fingerprint over distinct words, each with the square root of its count as weight.

    An edited word moves far fewer bits of it than of a fingerprint over shingles.
    """
    counts = Counter((text or "").encode("utf-8").lower().split())
    hashes = np.fromiter(map(xxh64_intdigest, counts, repeat(SEED)), dtype=np.uint64, count=len(counts))
    weights = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    votes = np.zeros(64)
    for start in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[start:start + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += weights[start:start + (1 << 14)] @ bits
    return int.from_bytes(np.packbits(votes * 2 > weights.sum()).tobytes(), "big")


def fingerprint(text: str | None, width: int | None) -> int:
    """Fingerprint of one text, as a signed 64-bit number; ``width`` None: of its weighted words."""
    value = weighted_words(text) if width is None else majority(shingle_hashes(text, width))
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(df: DataFrame, text_col: str, name: str, width: int | None = 3) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as a long column ``name`` (replacing one of that name)."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("simhash")
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")
        release()

    return df.withColumn(name, of(F.col(text_col)))


def block_masks(blocks: int, shared: int) -> list[int]:
    """Signed masks of every choice of ``shared`` of ``blocks`` nearly equal bit ranges of 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = (sum(ranges[k] for k in chosen) for chosen in combinations(range(blocks), shared))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _cell_links(group: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links within one cell: each member to an earlier member of its connected group (a spanning forest)."""
    fps = np.unique(group["fp"].to_numpy()).view(np.uint64)
    waiting = np.ones(len(fps), dtype=bool)
    left, right = [], []
    for root in range(len(fps)):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:                                    # breadth first: every fingerprint is compared once
            at = front.pop()
            near = np.flatnonzero(waiting & (np.bitwise_count(fps ^ fps[at]) <= distance))
            waiting[near] = False
            left.extend([at] * len(near))
            right.extend(near.tolist())
            front.extend(near.tolist())
    signed = fps.view(np.int64)
    return pd.DataFrame({"u": signed[left].astype("int64"), "v": signed[right].astype("int64")})


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, shared: int = 2) -> DataFrame:
    """Edges (u, v) between distinct values of ``fps(fp)`` that differ in at most ``distance`` bits.

    The edges hold every close pair up to connection: a pair that is left out is linked
    through others, each within ``distance`` bits.  ``blocks - shared`` must be ``distance`` at least.
    """
    if blocks - shared < distance:
        raise ValueError("blocks - shared must be at least the distance")
    masks = block_masks(blocks, shared)
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("b"),
    ).select("fp", "b.way", "b.key")
    sizes = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(keyed.join(sizes, ["way", "key"]))
    small = members.filter(F.col("n") <= SMALL_BUCKET).select("way", "key", "fp")
    near = small.alias("a").join(
        small.alias("b"),
        (F.col("a.way") == F.col("b.way")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    # chunk pairs (i, j) of a large bucket are its cells; a chunk is part of one cell with each other chunk
    chunks = F.ceil(F.col("n") / (CELL // 2)).cast("int")
    large = (
        members.filter(F.col("n") > SMALL_BUCKET)
        .withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .filter((F.col("own") != F.col("other")) | (F.col("chunks") == 1))
        .select("way", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dense = large.groupBy("way", "key", "i", "j").applyInPandas(lambda g: _cell_links(g, distance), "u long, v long")
    return near.unionByName(dense).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int | None = 3, distance: int = 2, blocks: int = 4, shared: int = 2,
) -> DataFrame:
    """One row per row of ``df``: its identifier, ``fingerprint`` (signed long) and ``component_id``.

    ``component_id`` is the smallest identifier reachable over links of at most ``distance``
    differing bits, the row's own included.  Null and empty texts have fingerprint zero and
    are linked like any other; a null identifier keeps its row and names no component unless
    all identifiers of the component are null.  Repeated rows stay repeated, an empty table
    gives an empty result, other columns are ignored.
    """
    rows = cut(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", width).select("id", "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(fps.select("fp"), distance, blocks, shared))
    labelled = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


#: Deduplication: words of a shingle, and least Jaccard similarity in fifths.
SHINGLE, FIFTHS = 5, 4
SIMILARITY = FIFTHS / 5
#: After the first round, up to this many texts under one key compare all pairs.
SMALL_COMPONENT = 64
#: Fewest bits of a sketch.
SKETCH_BITS = 128
#: Up to so many texts to compare are told to every executor; more are shuffled.
BROADCAST_TEXTS = 500_000
#: Shingles are ordered by how often they stand in about COUNTED texts, in COUNTERS counters.  Any order gives the same result.
COUNTED, COUNTERS = 20_000, 1 << 18


def _shingle_sets(df: DataFrame) -> DataFrame:
    """(tid, words): hashes of the distinct shingles of each text of ``df(tid, text)``."""

    @pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("simhash")
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in texts])
        release()

    return df.select("tid", of("text").alias("words"))


def _counter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n): how many distinct shingles of each text fall on each counter, over the texts of a batch."""
    claim("simhash")
    for batch in batches:
        sets = [np.unique(shingle_hashes(t, SHINGLE)) & np.uint64(COUNTERS - 1) for t in batch.column(0).to_pylist()]
        k, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], names=["k", "n"])
    release()


def _counted(df: DataFrame) -> DataFrame:
    """(k, n): how often shingles of each counter stand in ``df(text)``.

    Counted in one pass: of exploded shingles Spark asks first whether there are any, in a second Python function of the same task.
    """
    return df.select("text").mapInArrow(_counter_batches, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _counts(df: DataFrame) -> np.ndarray:
    """How often shingles of each counter stand in a bounded part of ``df(tid, text)``; it orders them and leaves none out."""
    every = max(1, df.count() // COUNTED)
    seen = _counted(df.filter(F.pmod(F.xxhash64("tid"), F.lit(every)) == 0)).toPandas()
    counts = np.zeros(COUNTERS, dtype=np.int32)
    counts[seen["k"].to_numpy(dtype=np.int64)] = np.minimum(seen["n"].to_numpy(dtype=np.int64), 2**31 - 1)
    return counts


def rare_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of distinct shingles, so many that any set of similarity SIMILARITY shares one of its own rarest with them.

    Similar sets share at least four fifths of the shingles of either.  In an order that all
    texts follow, the first that both have is then among the first fifth, and one more, of each.
    """
    n = len(shingles)
    if not n:
        return np.zeros(1, dtype=np.int64)   # texts without a word share a key
    order = np.lexsort((shingles, counts[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    return shingles[order[:n + (-FIFTHS * n // 5) + 1]].view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many of distinct shingles fall on each of so many bits, two at least for each shingle, as longs.

    The sketches of two sets differ in no more bits than the sets in members.
    """
    bits = max(SKETCH_BITS, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else SKETCH_BITS
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _with_keys(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """``df(tid, id, text)`` as (tid, id, fp, size, keys, sketch): fingerprint, number of distinct shingles, the rarest of them, and a sketch of all."""

    @pandas_udf("struct<fp:long,size:int,keys:array<long>,sketch:array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("simhash")
        for texts in batches:
            sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts]
            yield pd.DataFrame({
                "fp": np.array([fingerprint(t, 3) for t in texts], dtype=np.int64), "size": np.array([len(s) for s in sets], dtype=np.int32),
                "keys": [rare_first(s, counts) for s in sets], "sketch": [sketch(s) for s in sets],
            })
        release()

    return df.select("tid", "id", of("text").alias("of")).select("tid", "id", "of.*")


def _apart(a: str, b: str):
    """Bits in which two sketches differ; the longer one is folded, half upon half, to the length of the shorter."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    short = lambda x, y: F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))
    return F.aggregate(F.zip_with(short(a, b), short(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)


def _compared(pairs: DataFrame, sets: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """(u, v, d, similar): pairs of texts of fitting sizes, the Jaccard distance of their shingles, and whether it is small enough.

    With ``sketches(tid, id, size, sketch)``, ``sets`` are the rows (tid, id, text): shingles are
    made for texts that may be similar by their sketches only.  The distance of other pairs is at
    least the one returned.
    """
    found = None
    if sketches is not None:
        own = sketches.select("tid", "size", "sketch")
        both = pairs.join(own.withColumnsRenamed({"tid": "u", "size": "u_size", "sketch": "u_sketch"}), "u").join(own.withColumnsRenamed({"tid": "v", "size": "v_size", "sketch": "v_sketch"}), "v")
        bounded = cut(both.select("u", "v", (F.col("u_size") + F.col("v_size")).alias("sum"), _apart("u_sketch", "v_sketch").alias("apart")))
        far = F.col("apart") * (5 + FIFTHS) > F.col("sum") * (5 - FIFTHS)
        found = bounded.filter(far).select("u", "v", (F.col("apart") * 2 / (F.col("sum") + F.col("apart"))).alias("d"), F.lit(False).alias("similar"))
        pairs = bounded.filter(~far).select("u", "v")
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("tid")).distinct().join(sketches.select("tid", F.col("id").alias("own")), "tid")
        held = sets.join(broadcast_if_small(wanted, BROADCAST_TEXTS), "tid").filter(F.col("id").eqNullSafe(F.col("own")))
        sets = cut(_shingle_sets(held.select("tid", "text").dropDuplicates(["tid"])))
    own = sets.select("tid", "words")
    both = pairs.join(own.withColumnsRenamed({"tid": "u", "words": "u_set"}), "u").join(own.withColumnsRenamed({"tid": "v", "words": "v_set"}), "v")
    counted = both.select("u", "v", F.size(F.array_intersect("u_set", "v_set")).alias("common"), (F.size("u_set") + F.size("v_set")).alias("sum"))
    union = F.col("sum") - F.col("common")
    similar = F.col("common") * 5 >= FIFTHS * union
    exact = counted.select("u", "v", F.when(F.col("sum") == 0, 0.0).otherwise(1 - F.col("common") / union).alias("d"), similar.alias("similar"))
    if found is None:
        return exact
    exact = cut(exact)
    drop(sets)
    return exact.unionByName(found)


def _sizes_fit(a: str, b: str):
    """Whether texts of so many shingles can be similar."""
    return F.least(a, b) * 5 >= FIFTHS * F.greatest(a, b)


def _similar_texts(rest: DataFrame, sets: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that connect all similar texts sharing a key of ``rest(token, tid, id, size)``.

    Each round compares everyone under a key with a few heads.  Heads have then met all and
    leave.  Jaccard distance obeys the triangle inequality, so a text at distance d from a
    head is similar to none that are farther than d + 0.2 from it; who is similar to a head and
    farther than that from all whom this head does not link leaves too.  The others go on.
    """
    edges, heads, turn = [], 1, 0
    given = rest
    reach = 1 - SIMILARITY + 1e-9
    while True:
        groups = rest.groupBy("token").agg(F.min(F.struct("id", "tid")).getField("tid").alias("first"), F.count("*").alias("n")).filter("n > 1")
        group = cut(rest.join(groups, "token"))
        if rest is not given:   # tables of a round go as soon as the next is written
            drop(rest)
        tidy(group.sparkSession)
        if group.isEmpty():
            break
        whole = F.col("n") <= (SMALL_COMPONENT if turn else 1)
        picked = F.pmod(F.xxhash64("tid", F.lit(turn)), F.col("n")) < heads - 1
        large = group.filter(~whole).withColumn("heads", picked | (F.col("tid") == F.col("first")))
        chosen = large.filter("heads").select("token", F.col("tid").alias("head"), F.col("size").alias("head_size"))
        follow = cut(large.join(chosen, "token").filter("tid <> head").select("token", "tid", "id", "size", "heads", "head", "head_size"))
        small = group.filter(whole).select("token", "tid", "size")
        a, b = (small.select("token", F.col("tid").alias(k), F.col("size").alias(f"{k}_size")) for k in "uv")
        pairs = a.join(b, "token").filter("u < v").filter(_sizes_fit("u_size", "v_size")).select("u", "v")
        met = follow.filter(_sizes_fit("size", "head_size")).select(F.least("tid", "head").alias("u"), F.greatest("tid", "head").alias("v"))
        found = cut(_compared(met.unionByName(pairs).distinct(), sets, sketches))
        drop(group)
        edges.append(found.filter("similar").select("u", "v"))
        both = found.select(F.col("u").alias("tid"), F.col("v").alias("head"), "d").unionByName(found.select(F.col("v").alias("tid"), F.col("u").alias("head"), "d"))
        least = F.when(F.greatest("size", "head_size") == 0, 0.0).otherwise(1 - F.least("size", "head_size") / F.greatest("size", "head_size"))
        at = follow.filter("NOT heads").join(both, ["tid", "head"], "left").withColumn("d", F.coalesce("d", least))   # not compared: at least so far
        best = cut(at.groupBy("token", "tid").agg(F.min(F.struct("d", "head")).alias("best"), F.first("id").alias("id"), F.first("size").alias("size"), F.collect_set(F.struct("head", "d")).alias("all")))
        drop(follow)
        apart = best.filter(F.col("best.d") > reach)
        # the nearest text that a head does not link, whether another head does or none
        floors = best.select("token", F.explode("all").alias("of")).filter(F.col("of.d") > reach).groupBy("token", F.col("of.head").alias("head")).agg(F.min("of.d").alias("floor"))
        near = best.filter(F.col("best.d") <= reach).withColumn("head", F.col("best.head")).join(floors, ["token", "head"]).filter(F.col("best.d") + reach >= F.col("floor"))
        rest = cut(apart.select("token", "tid", "id", "size").unionByName(near.select("token", "tid", "id", "size")))
        drop(best)
        heads, turn = heads * 4, turn + 1
    every = rest.sparkSession.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))   # rows of Python would keep workers of their own alive
    for more in edges:
        every = every.unionByName(more)
    return every.distinct()


def _close_texts(texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``texts(tid, fp, size)`` to compare, u below v: each with one of its fingerprint, and such ones of linked fingerprints."""
    named = cut(texts.groupBy("fp").agg(F.min(F.struct("tid", "size")).alias("of")).select("fp", "of.tid", "of.size"))
    same = texts.join(named.select("fp", F.col("tid").alias("other"), F.col("size").alias("other_size")), "fp")
    u, v = (named.select(F.col("fp").alias(k), F.col("tid").alias(f"{k}_tid"), F.col("size").alias(f"{k}_size")) for k in "uv")
    linked = links(named.select("fp")).join(u, "u").join(v, "v").select(F.col("u_tid").alias("tid"), F.col("u_size").alias("size"), F.col("v_tid").alias("other"), F.col("v_size").alias("other_size"))
    both = same.select("tid", "size", "other", "other_size").unionByName(linked).filter("tid <> other").filter(_sizes_fit("size", "other_size"))
    return cut(both.select(F.least("tid", "other").alias("u"), F.greatest("tid", "other").alias("v")).distinct())


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group of near copies, the one of smallest identifier.

    Equal texts are one group (null and empty ones are equal).  Different texts whose 5-word
    shingles have similarity 0.8 or more are of one group, over any number of steps.  Texts
    whose fingerprints are equal or close are compared first; fingerprints miss some similar
    texts, and those are found under the rarest of their shingles, so that none are left.
    Null identifiers come last, of repeated rows one stays.  Rows that stay are unchanged,
    with all their columns; an empty table stays empty.
    """
    tid, first = free_name(df, "tid"), free_name(df, "first")
    plain = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn(tid, F.xxhash64(plain, F.length(plain)))
    named = keyed.select(F.col(tid).alias("tid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    one = _with_keys(named, _counts(named)).groupBy("tid").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "size", "keys", "sketch")])
    whole = cut(one)
    keys = whole.select("tid", F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "size", F.explode("keys").alias("token"))
    rest = cut(keys.join(keys.groupBy("token").count().filter("count > 1").select("token"), "token"))
    texts = cut(whole.drop("keys"))
    drop(whole)
    tidy(df.sparkSession)
    close = _close_texts(texts)
    by_fingerprint = cut(_compared(close, named, texts).filter("similar").select("u", "v"))
    every = by_fingerprint.unionByName(_similar_texts(rest, named, texts))
    groups = components(every)
    ranked = texts.join(groups.withColumnRenamed("node", "tid"), "tid").select("root", "tid", F.coalesce("id", F.lit(2**63 - 1)).alias("id"))
    stay = ranked.groupBy("root").agg(F.min(F.struct("id", "tid")).getField("tid").alias("stays"))
    gone = ranked.join(stay, "root").filter("tid <> stays").select("tid")
    stays = cut(texts.join(gone, "tid", "left_anti").select("tid", "id"))
    tidy(df.sparkSession)
    kept = keyed.join(stays.select(F.col("tid").alias(tid), F.col("id").alias(first)), tid).filter(F.col(id_col).cast("long").eqNullSafe(F.col(first)))
    again = keyed.groupBy(tid, F.col(id_col).cast("long").alias(first)).count().filter("count > 1").select(tid).distinct()   # repeated rows only
    repeated = kept.join(again, tid, "left_semi").dropDuplicates([tid])
    return kept.join(again, tid, "left_anti").unionByName(repeated).select(*df.columns)
