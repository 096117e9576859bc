import random

from pyspark.sql import functions as F

from tesserae.llm import simhash, substrings


def prose(rnd, n):
    return [f"w{rnd.randrange(10_000)}" for _ in range(n)]


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_one_document_of_each_group_stays(spark, monkeypatch):
    rnd = random.Random(8)
    texts, group = {}, {}
    for g in range(30):
        base = prose(rnd, 300)
        for k in range(rnd.randrange(1, 6)):
            words = list(base)
            for _ in range(rnd.randrange(3) if k else 0):
                words[rnd.randrange(300)] = "edit"
            texts[len(texts)] = " ".join(words)
            group[len(group)] = g
    base = prose(rnd, 300)
    for k in range(90):   # a large group
        words = list(base)
        words[k * 3] = f"e{k}"
        texts[len(texts)] = " ".join(words)
        group[len(group)] = 99
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, tid string")
    for small in (64, 8):
        monkeypatch.setattr(simhash, "SMALL_COMPONENT", small)
        kept = {r.doc_id for r in simhash.deduplicate(df).collect()}
        firsts = {min(i for i in group if group[i] == g) for g in set(group.values())}
        assert firsts <= kept
        for i in texts:
            if i not in kept:
                assert any(k < i and jaccard(texts[i], texts[k]) >= 0.8 for k in kept)
        assert len(kept - firsts) <= 2   # fingerprints of near copies may lie too far apart


def test_chains_between_heads_stay_whole(spark, monkeypatch):
    """Texts of one template in chains of small edits, and far relatives: components equal those of all pairs, with few texts compared at once."""
    monkeypatch.setattr(simhash, "SMALL_COMPONENT", 2)
    rnd = random.Random(31)
    base = prose(rnd, 120)
    texts = []
    for _ in range(14):                          # chains whose ends are no near copies, all sharing rare shingles of the template
        words = list(base)
        for at in rnd.sample(range(120), rnd.randrange(1, 6)):
            words[at] = f"v{rnd.randrange(10 ** 6)}"
        for _ in range(rnd.randrange(1, 5)):
            texts.append(" ".join(words))
            for at in rnd.sample(range(120), rnd.randrange(1, 4)):
                words[at] = f"v{rnd.randrange(10 ** 6)}"
    texts += [" ".join(prose(rnd, 60)) for _ in range(5)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    links = 0
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert links > 15 and len({find(i) for i in range(len(texts))}) > 8
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == sorted({find(i) for i in range(len(texts))})


def test_texts_near_to_different_heads_are_compared(spark, monkeypatch):
    """A chain h1 - x - y - h2 whose ends are both heads of one round: the middle link is found."""
    monkeypatch.setattr(simhash, "SMALL_COMPONENT", 2)
    drawn = spark.range(1, 400).select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(11)).alias("draw")).collect()   # 11 texts are left for the second round
    heads, others = [r.id for r in drawn if r.draw < 3], [r.id for r in drawn if r.draw >= 3]
    (h1, h2), (x, y, *rest) = heads[:2], others[:10]
    words = {h1: range(0, 100), x: range(10, 110), y: range(20, 120), h2: range(30, 130)}
    words |= {t: range(1000 * k, 1000 * k + 100) for k, t in enumerate(rest[:8], 1)}
    order = [rest[0], rest[1], x, y, h1, h2, *rest[2:8]]     # the first two lead the first and the second round
    rows = spark.createDataFrame([("k", t, order.index(t), 100) for t in order], "token string, tid long, id long, size int")
    sets = spark.createDataFrame([(t, [int(w) for w in own]) for t, own in words.items()], "tid long, words array<long>")
    links = {(r.u, r.v) for r in simhash._similar_texts(rows, sets).collect()}
    assert {tuple(sorted(p)) for p in links} == {tuple(sorted(p)) for p in ((h1, x), (x, y), (y, h2))}


def test_nothing_near_is_dropped_for_less(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert all(any(k in kept and jaccard(texts[i], texts[k]) >= 0.8 for k in kept) for i in texts if i not in kept)
    left = sorted(kept)
    near = sum(jaccard(texts[a], texts[b]) >= 0.8 for n, a in enumerate(left) for b in left[n + 1:])
    assert near <= 1


def test_odd_rows(spark):
    body = " ".join(prose(random.Random(9), 100))
    rows = [(4, None), (3, ""), (None, body), (7, body), (7, body), (5, body), (8, "a"), (9, "b"), (1, "same " * 40_000), (2, "same " * 40_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("root", F.lit("r"))
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 8, 9]
    assert simhash.deduplicate(df.limit(0)).count() == 0
    alone = df.filter("doc_id IS NULL")
    assert simhash.deduplicate(alone.unionByName(alone)).count() == 1


def test_passages_are_cut_out_once(spark):
    rnd = random.Random(10)
    passage = prose(rnd, 70)
    texts = {k: " ".join(prose(rnd, 60) + passage + prose(rnd, 60)) for k in range(5)} | {9: " ".join(prose(rnd, 200)), 10: None, 11: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    run = " ".join(passage[5:-5])
    assert [k for k in got if got[k] and run in got[k]] == [0]
    assert {k: got[k] for k in (0, 9, 10, 11)} == {k: texts[k] for k in (0, 9, 10, 11)}
    for k in range(1, 5):
        words = texts[k].split()
        assert got[k].split()[:55] == words[:55] and got[k].split()[-55:] == words[-55:]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_text_without_spans():
    assert substrings.without_spans(" a b\n c d ", [(1, 3)]) == " a d "
    assert substrings.without_spans("a b", [(0, 2)]) == ""
    assert substrings.without_spans("a b c", [(0, 2), (1, 3)]) == ""


def test_late_pairs_of_a_templated_source(spark):
    """Near copies whose common shingles also stand in earlier pages, similar to neither, are found."""
    rnd = random.Random(21)
    template, own = prose(rnd, 250), prose(rnd, 50)
    texts = {}
    for k in range(80):   # the same words, so that word fingerprints agree
        rnd.shuffle(own)
        texts[k] = " ".join(template[:125] + own + template[125:])
    for k in range(80, 120):
        words = texts[k - 40].split()
        words[20] = "edit"
        texts[k] = " ".join(words)
    assert jaccard(texts[0], texts[1]) < 0.8 <= jaccard(texts[40], texts[80])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == set(range(80))


def test_a_chain_is_one_group(spark, monkeypatch):
    """A text that is similar to a follower but not to the first text of the key is of the group too."""
    monkeypatch.setattr(simhash, "SMALL_COMPONENT", 2)
    rnd = random.Random(22)
    words, texts = prose(rnd, 300), {}
    for k in range(12):
        texts[k] = " ".join(words)
        words = list(words)
        for j in range(5):
            words[(k * 5 + j) * 5 % 300] = f"e{k}x{j}"
    assert jaccard(texts[0], texts[2]) < 0.8 <= jaccard(texts[0], texts[1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicate(df).collect()] == [0]


def test_no_near_copy_is_missed_at_any_length(spark):
    """Planted pairs by text length and number of edits: every pair of similarity 0.8 or more is one group."""
    rnd = random.Random(41)
    texts, cells = {}, {}
    for length, edits in ((30, 1), (60, 1), (120, 2), (400, 4), (400, 8)):
        for _ in range(60):
            a = prose(rnd, length)
            b = list(a)
            while b == a or jaccard(" ".join(a), " ".join(b)) < 0.8:
                b = list(a)
                for k in rnd.sample(range(length), edits):
                    b[k] = f"new{rnd.randrange(10_000)}"
            k = len(texts)
            texts |= {k: " ".join(a), k + 1: " ".join(b)}
            cells[k + 1] = (length, edits)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(df).collect()}
    lost = [cells[k] for k in kept if k in cells]
    assert {c: lost.count(c) for c in set(lost)} == {} and len(kept) == len(cells)


def test_sketches_never_part_similar_sets():
    """Sketches differ in no more bits than the sets in members, folded or not, and in about as many where sets are close."""
    import numpy as np

    rng = np.random.default_rng(7)
    for n, changed in ((0, 0), (1, 1), (40, 5), (64, 6), (65, 6), (300, 30), (5000, 500)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**64, max(0, changed - 2), dtype=np.uint64)]))
        x, y = sorted((simhash.sketch(a), simhash.sketch(b)), key=len)
        assert len(y) in (len(x), 2 * len(x)) and len(x) * 64 >= 2 * min(len(a), len(b))
        folded = y if len(x) == len(y) else y[:len(x)] ^ y[len(x):]
        bits = int(np.bitwise_count((x ^ folded).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) <= 2 * bits + 2


def test_texts_of_close_fingerprints_are_compared_first(spark, monkeypatch):
    """Groups come from fingerprints where these are close, also without any round over rare shingles; sketches keep unlike texts of one fingerprint apart."""
    monkeypatch.setattr(simhash, "_similar_texts", lambda rest, sets, sketches: rest.sparkSession.createDataFrame([], "u long, v long"))
    rnd = random.Random(51)
    base, line = prose(rnd, 400), prose(rnd, 9)   # of an odd number of shingles, so that no bit is near a tie
    texts = {0: " ".join(base), 1: " ".join(base).upper(), 2: "  ".join([*base, base[-1]]), 3: " ".join(prose(rnd, 100))}
    texts |= {4: " ".join(line * 200 + prose(rnd, 60)), 5: " ".join(line * 200 + prose(rnd, 60))}    # one fingerprint, few shingles in common
    assert simhash.fingerprint(texts[4], 3) == simhash.fingerprint(texts[5], 3) and jaccard(texts[4], texts[5]) < 0.8
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == [0, 3, 4, 5]


def test_empty_links_need_no_python_rows(spark):
    """A table made of Python rows keeps a daemon and workers beside those of the functions."""
    rest = spark.createDataFrame([], "token long, tid long, id long, size int")
    for links in (simhash._similar_texts(rest, rest), substrings.spark_empty(rest)):
        assert links.count() == 0 and "ExistingRDD" not in links._jdf.queryExecution().toString()
    assert substrings.spark_empty(rest).dtypes == [tuple(f.split()) for f in substrings.LINKS.replace("long", "bigint").split(", ")]
