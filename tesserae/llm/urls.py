"""URL filters from lists of rules and from associations mined out of labels.

A URL becomes a set of tokens: its host's labels and suffixes, path words, query names and
the like.  FP-growth over labelled URLs finds token combinations that stand with blocked
pages; those of enough support, confidence and lift are the mined rules, less each that
holds a smaller rule.  An inverted index from each rule's rarest token brings rules and
URLs together; a URL that holds all tokens of a rule is blocked.  A list of host and path
rules, of which the longest fit wins, goes before the mined ones.

Everything runs on DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tesserae.llm.frames import cut, free_name

BLOCKED = "=blocked"
#: Broadcast the mined rules only up to this many; beyond it they are joined by shuffling, with the tokens salted.
BROADCAST_RULES, SALTS = 10_000, 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), lower).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and suffixes, path words without digits, file ending, query names."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda n: F.concat(F.lit("host:"), F.concat_ws(".", F.slice(labels, n, F.size(labels)))))
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != "")
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), F.lower(x)))
    every = F.concat(
        F.transform(parts, lambda x: F.concat(F.lit("label:"), x)), suffixes, F.transform(words, lambda x: F.concat(F.lit("path:"), x)), names,
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.7, lift: float = 1.5, partitions: int = 16, chance: float = 0.05) -> DataFrame:
    """Rules (rule, tokens, rows, confidence) from ``labelled(url, blocked)``.

    A rule is a set of tokens which at least ``support`` of all labelled URLs hold together
    with the label, of which at least ``confidence`` are blocked, at ``lift`` times the
    overall rate or more, and which no accident explains: were URLs blocked at the overall
    rate whatever their tokens, at most ``chance`` rules would be expected to be as clear
    (Chernoff's bound, over all sets that are tried).  No rule holds a smaller one.  Equal URLs count each time they are
    labelled; null URLs and labels are left out.  Without labels, or with labels of one
    class, there are no rules.
    """
    spark = labelled.sparkSession
    kind = "rule string, tokens array<string>, rows long, confidence double"
    rows = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(tokens(F.col("url")).alias("tokens"), "blocked").filter(F.size("tokens") > 0)
    rows = cut(rows)
    total, bad = rows.agg(F.count("*"), F.sum(F.col("blocked").cast("long"))).first()
    if not total or not bad or bad == total:
        return spark.createDataFrame([], kind)
    # only tokens that are frequent among blocked URLs can be in a rule: baskets shrink to them before they are mined
    least = max(2.0, support * total)
    frequent = rows.filter("blocked").select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= least)
    held = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "blocked", F.explode("tokens").alias("token"))
    names = [r.token for r in frequent.select("token").collect()]   # at most tokens per URL / support of them
    if not names:
        return spark.createDataFrame([], kind)
    wanted = F.array(*[F.lit(n) for n in sorted(names)])
    baskets = rows.select(F.array_intersect("tokens", wanted).alias("tokens"), "blocked").filter(F.size("tokens") > 0)
    items = cut(baskets.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / total), minConfidence=confidence, numPartitions=partitions).fit(items)
    sets = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq")))
    with_label = sets.filter(F.array_contains("items", BLOCKED)).select(F.array_remove("items", BLOCKED).alias("tokens"), F.col("freq").alias("rows")).filter(F.size("tokens") > 0)
    plain = sets.filter(~F.array_contains("items", BLOCKED)).select(F.col("items").alias("tokens"), F.col("freq").alias("all_rows"))
    scored = with_label.join(plain, "tokens").withColumn("confidence", F.col("rows") / F.col("all_rows"))
    rate, c = bad / total, F.col("confidence")
    clear = c * F.log(c / rate) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - rate))).otherwise(0.0)   # nats a row
    tried = max(1, with_label.count())
    scored = scored.filter((c > rate) & (F.col("all_rows") * clear >= math.log(tried / chance)))
    good = cut(scored.filter((c >= confidence) & (c >= lift * rate)).select(F.concat_ws(" ", "tokens").alias("rule"), "tokens", F.col("rows").cast("long"), "confidence"))
    part = F.explode("tokens")
    smaller = good.select(F.col("rule").alias("small"), F.col("tokens").alias("small_tokens"), F.element_at("tokens", 1).alias("token"))
    covered = good.select("rule", "tokens", part.alias("token")).join(smaller, "token").filter(
        (F.size("small_tokens") < F.size("tokens")) & (F.size(F.array_except("small_tokens", "tokens")) == 0)).select("rule").distinct()
    return good.join(covered, "rule", "left_anti")


def matches(df: DataFrame, rules: DataFrame, key: str, url_col: str) -> DataFrame:
    """(key, mined_rule) for the rows of ``df`` that hold all tokens of a rule: the most confident, then the smallest by name."""
    rules = cut(rules)
    count = rules.count()
    # the index lists each rule under its rarest token, so that common tokens bring no candidates
    spread = rules.select("rule", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    anchors = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token")).join(spread, "token").groupBy("rule").agg(
        F.min(F.struct("n", "token")).alias("least"), F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"))
    index = anchors.select("rule", F.col("tokens").alias("rule_tokens"), "confidence", F.col("least.token").alias("token"))
    seen = df.select(F.col(key).alias("key"), tokens(F.col(url_col)).alias("tokens"))
    seen = seen.select("key", "tokens", F.explode("tokens").alias("token"))
    if count <= BROADCAST_RULES:
        found = seen.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = seen.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    held = found.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return held.groupBy("key").agg(F.min(F.struct((-F.col("confidence")).alias("order"), "rule")).getField("rule").alias("mined_rule")).withColumnRenamed("key", key)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of a list of (``host/path``, ``allow`` or ``block``); else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's.  Of rules
    of equal length the one by name first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):   # later ones win
        own, _, tail = name.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(df: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``mined_rule`` and ``verdict``, replacing columns of those names.

    The verdict is the list's where one of its rules fits, else ``block`` for URLs that hold
    a mined rule and ``allow`` for all others, null and malformed ones among them.  Rows,
    repeated ones included, and other columns stay; an empty table stays empty.
    """
    key = free_name(df, "row")
    rows = df.withColumn(key, F.monotonically_increasing_id())
    found = matches(rows, mined, key, url_col)
    kept = rows.drop("mined_rule").join(found, key, "left")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    kept = kept.withColumns({"host": host, "path": path}) if url_col not in ("host", "path") else kept
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    return kept.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))}).drop(key)
