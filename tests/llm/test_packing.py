import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def cost(at, price, bounds, length):
    total = 0.0
    for i, j in zip(bounds, bounds[1:]):
        n = at[j] - at[i]
        assert 0 < n <= length
        total += (0 if n & (n - 1) == 0 else length - n) + price[j] + packing.SEQUENCE
    return total


@pytest.mark.parametrize("seed", range(6))
def test_choice_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 24))])
    price = np.concatenate([[0.0], rng.choice([0.0, 6.0, 40.0], 24)])
    best = [0.0] + [np.inf] * 24
    for j in range(1, 25):
        for i in range(j):
            n = at[j] - at[i]
            if n <= 16:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else 16 - n) + price[j] + packing.SEQUENCE)
    got = packing.choose(at, price, 16)
    assert got[0] == 0 and got[-1] == 24
    assert np.isclose(cost(at, price, got, 16), best[-1])


def check(rows, texts, limit):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for doc, own in docs.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert padding <= limit * sum(r.length for r in rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(docs, VOCABULARY).collect(), {r.doc_id: r.text for r in docs.collect()}, 0.02)


def test_odd_rows(spark):
    rnd = random.Random(1)
    texts = {
        1: None, 2: "", 3: "a", 4: "word " * 30_000, 5: "x" * 5000, 6: "Ünï  Σας ́ <|endoftext|> don't I'LL\t1234\x1c\x85ﬁ", 7: "\n\n", None: "no identifier.",
        8: ". ".join("".join(rnd.choice("abcdé ") for _ in range(40)) for _ in range(900)),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("start", F.lit("x")).coalesce(1)
    check(packing.pack(df, VOCABULARY).collect(), texts, 0.05)
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0
    twice = packing.pack(df.filter("doc_id = 3").unionByName(df.filter("doc_id = 3")), VOCABULARY)
    assert twice.count() == 2


def test_ids_equal_the_tokenizers():
    """Random texts of letters, marks, digits, odd white space, combining marks and special tokens, twice: learned and remembered."""
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    letters = "abZÉßıİſK'sdtx 012\n\t .,!?…。“”—\u0301\u0308漢字\u00a0\u3000\U0001F600\0\x7f#*$&_-ñüÅﬁ"
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30))) for _ in range(3000)]
    texts += ["they're it's don't I'M WE'LL 'S", "é" * 500, "x<|endoftext|>y", "<|endoftext|>", "<|", "\0abc abc \0abc", "", "\n\n", " . "]
    for _ in range(2):
        for k in range(0, len(texts), 500):
            ids, sizes, stops = encoder.encode(texts[k:k + 500])
            at, ends = 0, set()
            for text, n in zip(texts[k:k + 500], sizes.tolist()):
                assert ids[at:at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
                seen = 0
                for word in text.replace("\n", " \n ").split(" "):
                    seen += len(tokenizer.encode(word, add_special_tokens=False).ids)
                    if word == "\n" or word.endswith(packing.STOPS):
                        ends.add(at + seen)
                at += n
            assert set(stops.tolist()) == ends
    encoder.rows = packing.REMEMBERED + 1
    assert encoder.encode(["all forgotten."])[0].tolist() == tokenizer.encode("all forgotten.", add_special_tokens=False).ids
