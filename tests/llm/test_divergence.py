import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        groups[lang, source].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    kept = {lang: kept.get(lang, set()) for lang, _ in groups}
    shares, totals = {}, Counter()
    for (lang, source), c in groups.items():
        n, v = sum(x for t, x in c.items() if t in kept[lang]), len(kept[lang])
        totals[lang] += n
        shares[lang, source] = {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * v) for t in kept[lang]}
    usual = {}
    for lang in kept:
        whole = sum((c for (own, _), c in groups.items() if own == lang), Counter())
        usual[lang] = {t: 1 + 10 ** 9 * (whole[t] + 5) // (totals[lang] + 5 * len(kept[lang])) for t in kept[lang]}
    out = set()
    for (lang, source), p in shares.items():
        pairs = [(sum(abs(p[t] - q[t]) for t in p), other) for (own, other), q in shares.items() if own == lang and other != source]
        more = [(p[t] - usual[lang][t], t) for t in p if groups[lang, source][t] and p[t] > usual[lang][t]]
        for part, found, limit in (("pair", pairs, None), ("term", more, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out |= {(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def made(seed, size):
    rng = np.random.default_rng(seed)
    words = ["a", "an", "and", "ando", "andorra", "andorran", "andorranisch", "x" * 33, "x" * 32, "x" * 64, "ñ", "ñandú", "漢字漢字", "Straße", "ÀB", "don't", "B2b", "\U0001F600"]
    rows = []
    for _ in range(size):
        text = rng.choice([" ", ", ", "7", "\0"]).join(rng.choice(words, size=rng.integers(0, 14)))
        rows.append((text, rng.choice(["en", "de", "en "]), f"s{rng.integers(0, 5)}"))
    return rows + [(None, "en", "s0"), ("and", None, "s1"), ("and", None, None), ("and an", "", "s1"), ("12 .", "xx", "lone"), ("an", "en", None)] + rows[:3]


@pytest.mark.parametrize("least", [1, 5, 30, 1000])
def test_against_brute_force(spark, least):
    rows = made(least, 220)
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string").repartition(5)
    got = [tuple(r) for r in divergence.compare(df, least=least).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def test_many_blocks_and_small_buffers(spark, monkeypatch):
    """Comparison over many blocks; tasks that hand on their counts early; a filter that lets nearly everything through."""
    rows = made(9, 150)
    monkeypatch.setattr(divergence, "CELLS", 4)
    monkeypatch.setattr(divergence, "GATHERED", 10)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = {tuple(r) for r in divergence.compare(df, least=4).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute(rows, 4)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.compare(df).count() == 0


def test_filter_holds_every_prefix(spark):
    values = [("en", b"abc\0"), ("de", b"abc\0"), ("", b"\xc3\xb1"), *[("en", b"w%d" % k) for k in range(3000)]]
    found = divergence.prefix_filter(spark.createDataFrame(values, "lang string, prefix binary"))
    import pyarrow as pa
    for lang in ("en", "de", ""):
        own = [v for k, v in values if k == lang]
        assert divergence._passes(found, divergence._hashes(pa.array(own, pa.binary()), None, lang)).all()
    others = pa.array([b"v%d" % k for k in range(3000)], pa.binary())
    assert divergence._passes(found, divergence._hashes(others, None, "en")).mean() < 0.01
