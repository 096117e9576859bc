import itertools
import math
import random

from pyspark.sql import functions as F

from tesserae.llm import urls
from tesserae.llm.queries import URL_RULES


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def listed(host, path):
    fits = [(len(r), r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://a.example.net/en/x?q=://b", "http://example.net/en/", "http://net/", "http://xnet/", "ftp://ÄÖ.org/fr/a\nb#c",
       "http://example.com/de/1", "http://www.example.com/de", "http://org?x=/fr/", "http://a.b.org/fr/#", "x://y://z/", "://h/p", "http://u@h:80/p//q"]


def test_hosts_paths_and_list(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(ODD)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("token", F.lit("t")).withColumn("key", F.lit(0))
    none = urls.mine(spark.createDataFrame([], "url string, blocked boolean"))
    got = {r.page_id: r for r in urls.judge(df, URL_RULES, none).collect()}
    assert len(got) == len(ODD)
    for k, url in enumerate(ODD):
        host, path = plain(url)
        rule, verdict = listed(host, path)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict or "allow"), url
    assert urls.judge(df.limit(0), URL_RULES, none).count() == 0
    twice = df.filter("page_id = 8").unionByName(df.filter("page_id = 8"))
    assert urls.judge(twice, URL_RULES, none).count() == 2


def test_mined_rules_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for _ in range(600):
        host = rnd.choice(["casino-win", "news", "shop"]) + rnd.choice([".example.com", ".example.org"])
        path = rnd.choice(["/bonus/", "/en/", "/de/bonus/"])
        bad = ("casino" in host and "bonus" in path) or rnd.random() < 0.05
        rows.append((f"http://{host}{path}{rnd.randrange(9)}", bad))
    rows += [(None, True), ("http://x", None)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    tokens = [(frozenset(r.t), r.blocked) for r in df.select(urls.tokens(F.col("url")).alias("t"), "blocked").collect() if r.t and r.blocked is not None]
    rate = sum(b for _, b in tokens) / len(tokens)
    names = sorted(set().union(*(t for t, _ in tokens)))
    least = max(2, 0.05 * len(tokens))
    level, tried = [((), list(range(len(tokens))))], 0
    while level:   # every set that stands in enough blocked URLs
        grown = []
        for pick, where in level:
            for name in names[names.index(pick[-1]) + 1 if pick else 0:]:
                own = [k for k in where if name in tokens[k][0]]
                if sum(tokens[k][1] for k in own) >= least:
                    grown.append(((*pick, name), own))
        tried, level = tried + len(grown), grown

    def clear(bad, n):
        c = bad / n
        return c > rate and n * (c * math.log(c / rate) + ((1 - c) * math.log((1 - c) / (1 - rate)) if c < 1 else 0)) >= math.log(tried / 0.05)

    good = {}
    for size in (1, 2, 3):
        for pick in itertools.combinations(names, size):
            held = [b for t, b in tokens if t.issuperset(pick)]
            if sum(held) >= least and clear(sum(held), len(held)) and sum(held) / len(held) >= max(0.7, 1.5 * rate) and not any(set(g) < set(pick) for g in good):
                good[pick] = (sum(held), sum(held) / len(held))
    mined = urls.mine(df, support=0.05)
    got = {tuple(sorted(r.tokens)): (r["rows"], r.confidence) for r in mined.collect()}
    assert {k: v for k, v in got.items() if len(k) <= 3} == good and good
    for limit in (10_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
        found = urls.judge(df, [], mined).collect()
        for r in found:
            own = next((t for t, _ in [(frozenset(x), 0) for x in [r.url and spark_tokens(r.url, tokens, rows)] if x]), frozenset())
            assert r.verdict == ("block" if any(own.issuperset(g) for g in got) else "allow")


def spark_tokens(url, tokens, rows):
    known = {u: t for (u, b), t in zip([x for x in rows if x[0] and x[1] is not None], [t for t, _ in tokens])}
    return known.get(url)


def test_labels_of_no_meaning_give_no_rules(spark):
    """A quarter of the URLs blocked at random: whatever looks clear among many sets is an accident."""
    rnd = random.Random(11)
    words = [f"word{chr(97 + k)}" for k in range(26)]
    rows = [(f"http://{rnd.choice(words)}.example.{rnd.choice(['org', 'net'])}/{rnd.choice(words)}/{rnd.choice(words)}/{k}", rnd.random() < 0.25) for k in range(900)]
    assert urls.mine(spark.createDataFrame(rows, "url string, blocked boolean")).count() == 0
    assert urls.mine(spark.createDataFrame(rows, "url string, blocked boolean"), chance=1e9).count() > 5
