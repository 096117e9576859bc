"""How far the sources of a language differ in their terms.

Terms are kept that stand in many documents of their language.  They are found by iceberg
prefix refinement: prefixes of a few bytes are counted first, by distinct documents;
those below the threshold are dropped with all their extensions, the rest is extended,
level by level, until every prefix left is a complete term.  A Bloom filter of a fixed
size carries the surviving prefixes to the next pass; what it lets through by mistake is
counted exactly and dropped then, so results are exact whatever the number of prefixes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.llm.codes import mix, prefix_sums, span_hash
from tesserae.llm.frames import cut, pieces
from tesserae.llm.tokens import layout, split, terms
from tesserae.session import broadcast_if_small

MIN_DOCS, TOP_TERMS = 30, 50
#: Bytes of the first prefixes; every level doubles them.
FIRST_LEVEL = 6
#: Bits of the filter (64 to a row of its table) and bits set for each prefix.
FILTER_BITS, PROBES = 1 << 24, 4
#: Prefixes a task gathers before it hands them on, and cells (sources x terms) of one block of the comparison.
GATHERED, CELLS = 400_000, 1 << 15
BATCH_CHARS = 2_000_000
#: Shares are counted in billionths; PRIOR is added to every count.
SHARE, PRIOR = 1_000_000_000, 5
END = b"\0"

#: Bytes of terms: Latin letters, and everything outside ASCII.
INSIDE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def document_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a batch with END behind each; and (document, term, occurrences) of every pair that occurs."""
    data, base = layout(texts)
    inside = INSIDE[data]
    starts, ends, first = split(data, base, inside)
    coded = terms(LOWER[data], inside, starts, ends).dictionary_encode()
    size = max(1, len(coded.dictionary))
    owner = np.repeat(np.arange(len(base) - 1), np.diff(first))
    pairs, found = np.unique(owner * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return pc.binary_join_element_wise(coded.dictionary, pa.scalar(END, pa.large_binary()), pa.scalar(b"", pa.large_binary())), pairs // size, pairs % size, found


def _hashes(values: pa.Array, length: int | None, lang: str) -> np.ndarray:
    """Hash of the first ``length`` bytes of each value under a language."""
    data, base = layout(values)
    ends = base[1:] if length is None else np.minimum(base[1:], base[:-1] + length)
    seed = np.uint64(zlib.crc32(lang.encode("utf-8")) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(span_hash(prefix_sums(data), base[:-1], ends) ^ seed)


def _probes(hashes: np.ndarray) -> np.ndarray:
    """Bits of each hash, shape (PROBES, hashes)."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * high[None, :]) % np.uint64(FILTER_BITS)


def prefix_filter(found: DataFrame) -> np.ndarray:
    """Bloom filter of (lang, prefix) rows as bytes; FILTER_BITS bits whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                bits[_probes(_hashes(batch.column(1).filter(pc.equal(langs.indices, k)), None, lang)).astype(np.int64).ravel()] = True
        words = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        for k in range(0, len(at), 100_000):
            yield pa.record_batch([pa.array(at[k:k + 100_000]), pa.array(words[at[k:k + 100_000]])], names=["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, dtype="<i8")
    rows = found.select("lang", "prefix").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _passes(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _probes(hashes).astype(np.int64)
    return ((filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


class _Gathered:
    """Partial counts of a task, merged whenever they grow beyond a bound."""

    def __init__(self, keys: list[str], sizes: list[str]):
        self.keys, self.sizes, self.tables, self.rows = keys, sizes, [], 0

    def merge(self) -> None:
        if len(self.tables) > 1:
            whole = pa.concat_tables(self.tables).group_by(self.keys).aggregate([(c, "sum") for c in self.sizes])
            self.tables = [whole.select([*self.keys, *[f"{c}_sum" for c in self.sizes]]).rename_columns([*self.keys, *self.sizes])]
            self.rows = self.tables[0].num_rows

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.tables.append(table)
        self.rows += table.num_rows
        if self.rows > GATHERED:
            self.merge()
            if self.rows > GATHERED // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for t in self.tables:
            yield from t.to_batches(max_chunksize=20_000)
        self.tables, self.rows = [], 0


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of each language, cut to bounded texts."""
    langs = batch.column(0).dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = batch.filter(pc.equal(langs.indices, k)) if len(langs.dictionary) > 1 else batch
        for part in pieces(pc.binary_length(own.column(own.num_columns - 1)).to_pylist(), BATCH_CHARS):
            yield lang, own[part]


def prefix_counts(texts: DataFrame, length: int, parents: np.ndarray | None) -> DataFrame:
    """(lang, prefix, source, docs, n): distinct documents and occurrences of each prefix of ``length`` bytes.

    Where given, only extensions of ``parents`` are counted.  Complete terms carry END, so a
    term and a longer one that begins with it stay apart, and are counted by source; for
    open prefixes source is null.
    """
    shared = texts.sparkSession.sparkContext.broadcast(parents)   # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(["lang", "prefix", "source"], ["docs", "n"])
        for batch in batches:
            for lang, own in _by_lang(batch):
                words, docs, ids, found = document_terms(own.column(2))
                if not len(words):
                    continue
                size = pc.binary_length(words).to_numpy(zero_copy_only=False)
                wanted = np.ones(len(words), dtype=bool)
                if shared.value is not None:   # terms shorter than a parent were complete before
                    wanted = (size > length // 2) & _passes(shared.value, _hashes(words, length // 2, lang))
                keep = wanted[ids]
                docs, ids, found = docs[keep], ids[keep], found[keep]
                if not len(ids):
                    continue
                coded = pc.binary_slice(words.cast(pa.binary()), 0, length).dictionary_encode()
                kinds, kind = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)[ids]
                sources = own.column(1).dictionary_encode()
                source = np.where((size <= length)[ids], sources.indices.to_numpy()[docs] + 1, 0).astype(np.int64)
                # one entry for each document and prefix: several terms of a document may share an open prefix
                each = np.unique(docs * kinds + kind, return_index=True)[1] if (source == 0).any() else np.arange(len(ids))
                key, place = np.unique(source * kinds + kind, return_inverse=True)
                langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(key), np.int32)), pa.array([lang])).cast(pa.string())
                named = pa.concat_arrays([pa.array([None], pa.string()), sources.dictionary.cast(pa.string())])
                yield from gathered.add(pa.table({
                    "lang": langs, "prefix": coded.dictionary.take(pa.array(key % kinds)), "source": named.take(pa.array(key // kinds)),
                    "docs": pa.array(np.bincount(place[each], minlength=len(key)).astype(np.int64)), "n": pa.array(np.bincount(place, weights=found).astype(np.int64)),
                }))
        yield from gathered.flush()

    counted = texts.select("lang", "source", "text").mapInArrow(run, "lang string, prefix binary, source string, docs long, n long")
    # tasks hand on merged counts; one shuffle serves the sums and the threshold
    return counted.repartition("lang", "prefix").groupBy("lang", "prefix", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def kept_terms(texts: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n): occurrences of each kept term in each group that holds it.

    Kept are terms that stand in at least ``least`` documents of their language.  ``texts``
    has lang, source and text, none null; every row is a document.
    """
    length, parents, complete = FIRST_LEVEL, None, []
    whole = Window.partitionBy("lang", "prefix")
    while True:
        found = prefix_counts(texts, length, parents).withColumn("all_docs", F.sum("docs").over(whole))
        found = cut(found.filter(F.col("all_docs") >= least).drop("docs", "all_docs"))
        complete.append(found.filter("source IS NOT NULL"))
        rest = found.filter("source IS NULL")
        if rest.isEmpty():
            break
        parents, length = prefix_filter(rest), length * 2
    term = F.decode(F.substring(F.col("prefix"), F.lit(1), (F.octet_length("prefix") - 1).cast("int")), "UTF-8")
    return reduce(DataFrame.unionByName, complete).select("lang", "source", term.alias("term"), "n")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SHARE * (count + PRIOR) / (total + PRIOR * kinds)), exact; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = (wide(count) + PRIOR) * F.lit(SHARE).cast("decimal(11,0)"), wide(total) + wide(kinds) * PRIOR
    return F.when(kinds > 0, F.call_function("div", top, F.greatest(bottom, F.lit(1).cast("decimal(20,0)"))) + 1).cast("long")


def compare(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: each other source of the language and the sum, over its kept terms, of
    the differences between both sources' shares.  Part ``term``: kept terms of the source
    whose share exceeds the language's, by that excess, the ``top`` largest.  Ties go to the
    smaller item in UTF-8 order.  Null text, lang and source are read as empty texts; groups
    without terms take part, languages without kept terms have pairs of value 0; repeated
    rows are documents of their own, other columns are ignored, an empty table gives no rows.
    """
    read = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    texts = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "text"))
    found = cut(kept_terms(texts, least))
    kinds = found.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    groups = texts.groupBy("lang", "source").agg(F.count("*").alias("docs")).join(kinds, "lang", "left")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = cut(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("kinds", zero).alias("kinds"), F.coalesce("total", zero).alias("total")))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    usual = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(broadcast_if_small(whole), "lang")
    shares = found.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
    excess = shares.join(usual, ["lang", "term"]).withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = excess.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    listed = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # terms fall into blocks whose cells (sources x terms) are bounded; every block meets all sources of its language
    size = groups.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("kinds") * F.count("*").over(Window.partitionBy("lang")) / CELLS)))
    every = size.select("lang", "source", share(zero, F.col("total"), F.col("kinds")).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    each = size.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    cells = shares.join(broadcast_if_small(each), "lang").select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    # kept terms that no group of the block lacks or holds differ nowhere else: absent cells have the share of no occurrence
    sums = every.groupBy("lang", "block").cogroup(cells.groupBy("lang", "block")).applyInPandas(_differences, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked.unionByName(listed).withColumn("rank", F.col("rank").cast("int"))


def _differences(sources: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences of the sources' shares over one block's terms, for every two sources."""
    names = np.sort(sources["source"].to_numpy())
    least = sources.set_index("source")["p"].reindex(names).fillna(0).to_numpy().astype(np.int64)
    kinds, term = np.unique(cells["term"].to_numpy(), return_inverse=True)
    shares = np.repeat(least[:, None], len(kinds), axis=1)
    shares[np.searchsorted(names, cells["source"].to_numpy()), term] = cells["p"].to_numpy()
    lang, out = sources["lang"].iloc[0], []
    for k, name in enumerate(names):
        value = np.abs(shares - shares[k]).sum(axis=1)
        others = np.arange(len(names)) != k
        out.append(pd.DataFrame({"lang": lang, "source": name, "item": names[others], "value": value[others]}))
    return pd.concat(out, ignore_index=True)
