import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import quality
from tesserae.llm.frames import fold_of
from tesserae.sources.tables import table

TEXTS = ["", None, " \n\t ", "a", "a b", "a b c a b c", "x y z\nx y z\n x y z\n\nx y z", "  lead\x0btail\x1c \x85 ñandú 漢字\U0001F600 ", "a\0b \0 a\0b \0 a\0b \0",
         "no no no no no", "#* $%& |<> ##", "end\n", "\n\n", "a　b a　b"]


def plain(text):
    """Word by word, window by window."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + s for i, w in enumerate(windows) if w in often for s in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    flat = " ".join(words)
    buckets = [(ord(a) * quality.FIRST + ord(b) * quality.SECOND + ord(c)) % quality.BUCKETS for a, b, c in zip(flat, flat[1:], flat[2:])]
    return [len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)], buckets


def test_measures_against_a_plain_reading():
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("ab \n\t#ñ"), size=rng.integers(0, 60))) for _ in range(300)]
    texts = TEXTS + made + ["w%d " % (k % 7) * 3 for k in range(20)]
    weights = np.append(rng.integers(-10 ** 6, 10 ** 6, quality.BUCKETS), 0)
    got = quality.measure(pa.array(texts, pa.string()), weights).to_pylist()
    for text, row in zip(texts, got):
        base, buckets = plain(text)
        assert list(row.values()) == [*base, int(weights[buckets].sum()) if buckets else 0, len(buckets)], repr(text)


def test_wide_vocabularies_are_numbered():
    batch = quality.Texts(pa.array([" ".join(f"w{k * k % 40}" for k in range(200)), "a b c a b c", "a b"]))
    assert batch.repeats(room=13).tolist() == batch.repeats().tolist() == [plain(" ".join(f"w{k * k % 40}" for k in range(200)))[0][4], 6, 0]


def test_pick():
    assert quality.pick({}) == -(1 << 62)
    assert quality.pick({-5: (0, 3)}) == -(1 << 62)
    assert quality.pick({-5: (2, 0), 3: (1, 0)}) == -5
    assert quality.pick({-10: (0, 4), 0: (5, 0)}) == -5
    assert quality.pick({-10: (0, 4), -9: (1, 0), 5: (9, 0)}) == -9
    assert -3 < quality.pick({-10: (0, 4), -3: (1, 6), 5: (90, 0)}) <= 5


def test_counts_against_a_plain_reading(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    want = Counter(b for t in TEXTS for b in plain(t)[1])
    got = quality.counts(df)
    assert {b: int(got[b]) for b in np.flatnonzero(got)} == dict(want)


def test_odd_rows(spark, monkeypatch):
    good = "plain words of a quiet page that say this and that " * 12
    rows = [(k, t) for k, t in enumerate([*TEXTS, good + "end", "w " * 200_000])] + [(None, "x"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("quality_sum", F.lit(1)).withColumn("id", F.lit(2))
    labels = spark.createDataFrame([(14, 1, "x"), (14, 1, "y"), (3, 0, "z"), (99, 1, "z"), (None, 1, "z"), (5, None, "z")], "doc_id long, quality int, text string")
    model = quality.fit(df, labels)
    got = quality.judge(df, model)
    assert set(got.columns) == {"doc_id", "text", "id", "kept", "base_failed", "quality_score", *[c.split()[0] for c in quality.FOUND.split(", ")]} - {"quality_sum", "quality_grams"}
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and model.trusted == 1 and model.rejected == 3
    assert found[15].n_words == 200_000 and found[15].base_failed and not found[15].kept
    assert found[0].n_words == 0 and found[0].base_failed and found[0].quality_score == 0
    monkeypatch.setattr(quality, "LABELS_SENT", 1)   # the join by identifier gives the same model
    joined = quality.fit(df, labels)
    assert (joined.weights == model.weights).all() and (joined.threshold, joined.trusted, joined.rejected) == (model.threshold, 1, 3)
    nothing = df.limit(0)
    assert quality.judge(nothing, quality.fit(nothing, labels)).count() == 0
    blank = quality.fit(df, labels.limit(0))
    assert {r.kept == (not r.base_failed) for r in quality.judge(df, blank).collect()} == {True}


def test_held_out_documents(spark):
    """Learned outside fold 0, the verdict tells junk from clean documents of fold 0."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.01", "labels")
    learned = fold_of(F.col("doc_id")) != 0
    model = quality.fit(docs.filter(learned), labels)
    judged = quality.judge(docs.filter(~learned), model).join(labels, "doc_id").filter("NOT base_failed")
    rows = [(r.quality, r.kept) for r in judged.select("quality", "kept").collect()]
    clean, junk = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert len(clean) > 40 and len(junk) > 2
    assert sum(clean) == len(clean) and not any(junk)
