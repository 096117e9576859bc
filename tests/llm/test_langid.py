import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import langid
from tesserae.llm.chains import marginals, viterbi
from tesserae.llm.codes import words


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 9, 10])
    emit = rng.normal(size=(10, 3))
    got = viterbi(emit, first, 0.7)
    for a, b in zip(first, first[1:]):
        def value(path):
            return sum(emit[a + k, p] for k, p in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))
        if b > a:
            assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=value)


def test_marginals_against_every_labelling():
    rng = np.random.default_rng(2)
    first = np.array([0, 5, 5, 8, 9])
    lift, trans, start = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    prob, pairs, log = marginals(lift, first, trans, start)
    want, want_pairs, want_log = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.exp([start[p[0]] + sum(lift[a + k] * y for k, y in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:])) for p in paths])
        want_log += np.log(weight.sum())
        for p, v in zip(paths, weight / weight.sum()):
            want[a:b] += v * np.array(p)
            for x, y in zip(p, p[1:]):
                want_pairs[x, y] += v
    assert np.allclose(prob, want) and np.allclose(pairs, want_pairs) and np.isclose(log, want_log)


def test_words_have_the_offsets_of_their_text():
    texts = ["Ab, Çd!", "", "  x1y ", "\n"]
    w = words(texts)
    found = [[texts[k][w.starts[i] - w.base[k]:w.ends[i] - w.base[k]] for i in range(w.first[k], w.first[k + 1])] for k in range(4)]
    assert found == [["Ab", "Çd"], [], ["x", "y"], []]
    assert list(w.lettered) == [True, False, True, False]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, model).select("doc_id", "lang", "lang_pred").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_mixed_text_falls_into_spans(model):
    docs = {"en": "the of and that thing with from", "de": "der die und nicht schaft einheit"}
    text = (docs["en"] + " ") * 4 + (docs["de"] + " ") * 4
    ((lang, score, spans),) = langid.label([text], model)
    assert [s["lang"] for s in spans] == ["en", "de"] and 0 < score < 1
    assert text[spans[1]["start"]:].startswith("der")


def test_odd_rows(spark, model):
    rows = [(1, None, "en"), (None, "", None), (2, "123 .!", "x"), (3, "the", "en"), (3, "the", "en"), (4, "the of and " * 300_000, "en"), (5, "эта и", "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").withColumn("v", F.lit(1)).withColumn("found", F.lit(2))
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "v", "found", "lang_score", "lang_spans"]
    assert sorted(r.lang_pred for r in got.collect() if r.text in (None, "", "123 .!")) == ["und"] * 3
    assert [r.lang_pred for r in got.collect() if (r.text or "").startswith("the")] == ["en"] * 3
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
