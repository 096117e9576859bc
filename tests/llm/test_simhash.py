import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.components import components


def plain_fingerprint(text, width=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    grams = [" ".join(words[k:k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = plain_classes(pairs, fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("small, cell", [(32, 2048), (2, 8)])
def test_links_keep_every_connection(spark, monkeypatch, small, cell):
    """Dense clusters, chains and hot blocks give the components of all close pairs, in small and in cut-up buckets."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "CELL", cell)
    rnd = random.Random(5)
    values = {0, 3, 7, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        base = rnd.getrandbits(64)
        for _ in range(40):
            base ^= 1 << rnd.randrange(64)
            values.add(base)
    hot = rnd.getrandbits(32) << 32
    values |= {hot | rnd.getrandbits(12) for _ in range(60)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = simhash.links(fps)
    assert edges.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 2).isEmpty()
    got = {r.node: r.root for r in components(edges).collect()}
    ordered = sorted(map(signed, values))
    pairs = [(a, b) for a in ordered for b in ordered if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    want = {n: r for n, r in plain_classes(pairs, ordered).items()}
    assert {n: got.get(n, n) for n in ordered} == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (None, "a b c d", 2), (9, "A B\tC  d", 2), (9, "A B\tC  d", 2), (4, "Ä b c d", 3), (7, "word " * 300_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumn("id", F.lit("x")).withColumn("component_id", F.lit(0))
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect()))
    assert got == [(-1, 9), (3, 3), (4, 4), (5, 3), (7, 7), (9, 9), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_counters_take_one_python_pass(spark):
    """Sums of texts' distinct shingles by counter equal a count by hand, and the plan hands the texts to Python once."""
    texts = ["a b c d e f g", "a b c d e a b c d e", "", None]
    counted = simhash._counted(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "tid long, text string"))
    want = Counter(int(w) & (simhash.COUNTERS - 1) for t in texts for w in set(simhash.shingle_hashes(t, simhash.SHINGLE).tolist()))
    assert {r.k: r.n for r in counted.collect()} == dict(want)
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1


def test_similar_sets_share_a_rarest_shingle():
    """Sets of every size at the least similarity, whatever the order of rarity."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 200, 1000]:
        for _ in range(20):
            counts = rng.integers(0, 4, simhash.COUNTERS).astype(np.int32)
            own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = rng.integers(0, n // 5 + 1)                       # members that only the first set holds
            new = max(0, (5 * (n - gone)) // 4 - n)                  # as many as the other may add: 5 * common >= 4 * union
            a, b = np.unique(own), np.unique(np.concatenate([own[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert 5 * both >= 4 * (len(a) + len(b) - both)
            assert set(simhash.rare_first(a, counts)) & set(simhash.rare_first(b, counts))
