import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import nearest


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            usable.setdefault((i, tuple(v)), np.array(v, dtype=float))
    out = {}
    for (q, _), v in usable.items():
        if q % 20 == 0:
            scored = sorted((-float(v @ w), i) for (i, _), w in usable.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for own in out.values():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
    return {q: [(i, s) for _, i, s in own] for q, own in out.items()}


def test_recall_over_a_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = collect(nearest.search(df, F.col("vec_id") % 20 == 0))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in got:
        assert np.allclose([s for _, s in got[q]], sorted((s for _, s in got[q]), reverse=True))


@pytest.mark.parametrize("codes, queries", [(8192, 512), (7, 3)])
def test_ties_copies_and_odd_vectors(spark, monkeypatch, codes, queries):
    monkeypatch.setattr(nearest, "CODES_BLOCK", codes)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", queries)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 2)]) for i in range(150)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200, 260)]   # more copies than are asked for
    rows += [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] + [1.0] * 5), (380, [float("inf")] * 6), (None, [1.0] * 6), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).withColumn("score", F.lit(1)).withColumn("key", F.lit(0))
    want = brute(rows, 20)
    got = collect(nearest.search(df, F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in want.items()}
    short = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert collect(nearest.search(short, F.col("vec_id") % 20 == 0)) == {0: [(1, 5.0)]}
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    vectors, queries = rng.normal(size=(2000, 64)), rng.normal(size=(30, 64))
    centre = vectors[:100].mean(0)
    codes, factors = nearest.encode(vectors, centre, 256)
    estimate, half = nearest.bounds(queries, codes, factors, centre, 256)
    inside = np.abs(queries @ vectors.T - estimate) <= half
    assert inside.mean() > 0.999
