import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import whitening
from tesserae.sources.tables import table


def brute(vectors):
    """(n, sums, covariance, eigenvalues, eigenvectors) of the distinct whole vectors, by numpy."""
    x = np.unique(np.floor(np.array(vectors, dtype=np.float64) * 256).astype(np.int64), axis=0)
    y = x - x.mean(0)
    values, turned = np.linalg.eigh(y.T @ y / len(x))
    return len(x), x.sum(0), y.T @ y / len(x), values[::-1], turned[:, ::-1]


def compare(df, vectors, ids):
    n, sums, covariance, values, turned = brute(vectors)
    rows = df.collect()
    found = {(r.vec_id, r.component): r for r in rows}
    k = max((r.component for r in rows), default=0)
    assert len(rows) == k * len(ids)
    x = np.floor(np.array(vectors, dtype=np.float64) * 256).astype(np.int64)
    for c in range(k):
        own = [found[i, c + 1] for i in ids]
        want = (x - sums / n) @ turned[:, c] / np.sqrt(values[c])
        got = np.array([r.whitened for r in own])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8 * max(1, np.abs(want).max())
        assert all(abs(r.explained - values[c] / np.trace(covariance)) < 1e-10 for r in own)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]
    assert [found[i, 1].deviation for i in ids] == exact if k else True
    assert {r.n for r in rows} <= {n} and all(r.identity_error < 1e-9 for r in rows)
    return k


def test_whole_table(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    assert compare(whitening.whiten(df), [r.embedding for r in rows], [r.vec_id for r in rows]) == 4


def test_inertia_and_contour():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 30):
        a = rng.normal(size=(d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1, 0.0):
            assert whitening.above(a, shift) == (values > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1], [5, 5, 5, 5, 5, 5, 5, 5], [9, 9, 9, 1, 1, 1, 1], [1e9, 5, 4, 3, 2], [3, 2], [7, 0, 0, 0, 0], [1e-9, 5e-10, 1e-10, 1e-11, 0], [1e30, 1e29, 3e28, 1e28, 1],
    [4 + k * 1e-7 for k in range(12)], list(np.linspace(1, 2, 64)),
])
def test_components_of_known_spectra(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = (q * np.array(values, dtype=float)) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a, 4)
    want = [v for v in sorted(values, reverse=True) if v > 1e-13 * max(values)][:4]
    assert np.allclose(found, want, rtol=1e-9, atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-9)
    assert np.linalg.norm(a @ vectors - vectors * found) < 1e-9 * max(values)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [[float(v) for v in rng.normal(size=5) * [5, 4, 3, 2, 1]] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(good)] + [(50, None), (51, [nan] * 5), (52, [1.0, inf, 0.0, 0.0, 0.0]), (53, [1.0, None, 0.0, 0.0, 0.0]), (54, [1.0]), (55, [])]
    copies = [(60 + k, good[0]) for k in range(200)] + [(7, good[7])]
    df = spark.createDataFrame(rows + copies, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("component", F.lit("c")).repartition(6)
    got = whitening.whiten(df)
    assert compare(got.dropDuplicates(["vec_id", "component"]), good + [good[0]] * 200, [*range(40), *range(60, 260)]) == 4
    assert got.filter("vec_id = 7").count() == 8
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id >= 60")).count() == 0          # one distinct vector
    assert whitening.whiten(df.filter("vec_id in (54, 55)")).count() == 0
    two = whitening.whiten(df.filter("vec_id < 2"))
    assert {r.component for r in two.collect()} == {1}                        # a line has one component
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, -4.0]), (1, [3.0, -4.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(nulls).count() == 3


def test_large_entries(spark):
    """Deviations beyond 63 bits are null, the rest stays finite."""
    rows = [(0, [1e15, 0.0]), (1, [0.0, 1.0]), (2, [1e300, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(np.isfinite(r.whitened) for r in got) and {r.deviation for r in got if r.vec_id == 2} == {None}
