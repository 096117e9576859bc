import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm import toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def test_held_out_documents(spark, model):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.detect(docs, model).join(labels, "doc_id").select("doc_id", "toxic", "toxic_score").collect()
    held = [(r.toxic, r.toxic_score) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    clean, bad = [s for y, s in held if y == 0], [s for y, s in held if y == 1]
    assert sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)
    assert sum(s >= 0.5 for s in bad) >= 0.6 * len(bad)   # some labels of the small table mark documents without a toxic word
    assert sum(a > b for a in bad for b in clean) > 0.8 * len(bad) * len(clean)


def test_spans_point_at_the_words(model):
    text = "The thing and of idiot that, with The MORON is."
    ((score, spans),) = toxicity.score([text], model)
    assert score >= 0.5
    assert [text[s["start"]:s["end"]] for s in spans] == ["idiot", "MORON"]


def test_odd_rows(spark, model):
    rows = [(1, None), (None, ""), (2, "12 .."), (3, "you idiot"), (3, "you idiot"), (4, "the of and " * 200_000 + "loser idiot moron")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic_score", F.lit("x")).withColumn("found", F.lit(1))
    got = toxicity.detect(df, model)
    assert got.columns == ["doc_id", "text", "toxic_score", "found", "toxic_spans"]
    found = {(r.doc_id, r.text and r.text[:3]): (r.toxic_score, len(r.toxic_spans)) for r in got.collect()}
    assert len({v for k, v in found.items() if k[1] in (None, "", "12 ")}) == 1
    assert found[3, "you"][0] >= 0.5 and found[4, "the"][1] == 3
    assert toxicity.detect(df.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (9, None)], "doc_id long, toxic int")
    assert {r.toxic_score for r in toxicity.detect(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    assert {r.toxic_score for r in toxicity.detect(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
