"""Toxic spans by a linear-chain conditional random field over words.

Each word has hashed features (itself, its prefixes, its neighbours); a two-label chain
with learned transitions is scored by forward-backward, and the marginals give spans of
offending words and, through a fitted logistic curve, the document's score.

Labels are given by document, so the labelled tokens the chain learns from are derived
first: in toxic documents, words that hold a feature which stands in toxic documents far
more often than chance allows (a likelihood ratio test over the sampled documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tesserae.llm.chains import marginals
from tesserae.llm.codes import BATCH_CHARS, Words, prefix_sums, span_hash, words
from tesserae.llm.frames import claim, fold_of, free_name, pieces, release

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
#: Features of the word itself (whole, then prefixes); its neighbours follow, then the bias.
OWN = 1 + len(PREFIXES)
#: A feature marks words if its likelihood ratio statistic is this far above what the best of as many chance features reaches
#: (twice the log of their number), and if this share of its documents is toxic.
MARGIN, LEAST_SHARE = 14.0, 0.9
SPANS = "array<struct<start:int,end:int,prob:double>>"


@dataclass
class Model:
    weights: np.ndarray   # by feature bucket
    trans: np.ndarray     # (2, 2)
    start: np.ndarray     # (2,)
    curve: np.ndarray     # of the document score: constant, largest marginal, log of their sum
    base: float           # score where nothing was learned
    trained: bool


def features(w: Words) -> np.ndarray:
    """Feature buckets of each word: (words, OWN + 3)."""
    sums = prefix_sums(w.codes)
    size = w.ends - w.starts
    own = [span_hash(sums, w.starts, w.ends)]
    for k, n in enumerate(PREFIXES):
        own.append(span_hash(sums, w.starts, w.starts + np.minimum(size, n)) + np.uint64(0x51ED270B7A3 * (k + 1)))
    whole = own[0]
    edge = np.zeros(len(whole), dtype=bool)
    edge[w.first[:-1][np.diff(w.first) > 0]] = True
    before = np.where(edge, np.uint64(7), np.roll(whole, 1)) * np.uint64(0x9E3779B97F4A7C15)
    after = np.where(np.roll(edge, -1), np.uint64(9), np.roll(whole, -1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    table = np.stack([*own, before, after, np.full(len(whole), 1 << 50, dtype=np.uint64)], axis=1)
    return (table >> np.uint64(46)).astype(np.int32)


def _all_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words of many texts, batch by batch, and each text's first word; one more at the end."""
    feats, counts = [np.zeros((0, OWN + 3), dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for part in pieces([len(t) for t in texts], BATCH_CHARS // 2):
        w = words(texts[part])
        feats.append(features(w))
        counts.append(np.diff(w.first))
    return np.concatenate(feats), np.cumsum(np.concatenate(counts))


def _seeds(feats: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of toxic documents count as toxic."""
    own = feats[:, :OWN]
    bad, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    edges = np.searchsorted(doc, np.arange(len(toxic) + 1))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):   # each document counts once for a feature
        (bad if toxic[k] else good)[np.unique(own[a:b])] += 1
    rate = toxic.mean()
    n = bad + good
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(bad > 0, bad * np.log(bad / (n * rate)), 0) + np.where(good > 0, good * np.log(good / (n * (1 - rate))), 0))
    marks = (bad >= 3) & (ratio >= 2 * np.log(np.count_nonzero(n) + 1) + MARGIN) & (bad / np.maximum(n, 1) >= LEAST_SHARE)
    return marks[own].any(1) & toxic[doc]


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * beta), -2, 2)
    return beta


def _evidence(prob: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest marginal and log of the sum of marginals of each chain."""
    out = np.zeros((len(first) - 1, 2))
    full = np.diff(first) > 0
    if full.any():
        at = first[:-1][full]
        out[full, 0] = np.maximum.reduceat(prob, at)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(prob > 0.05, prob, 0.0), at))
    return out


def train(rows: list[tuple[str, bool]], epochs: int = 12, rate: float = 0.25) -> Model:
    """Fit the chain by AdaGrad on the conditional likelihood of derived token labels, then the document curve."""
    rows = list(dict.fromkeys(rows))   # copies of a text say nothing more about its words
    toxic = np.array([bool(y) for _, y in rows])
    base = float(toxic.mean()) if len(rows) else 0.0
    model = Model(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, 0.0]), base, bool(0 < base < 1))
    if not model.trained:
        return model
    feats, first_of = _all_features([t for t, _ in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(first_of))
    gold = _seeds(feats, doc, toxic)
    chunks = [slice(k, min(k + 256, len(rows))) for k in range(0, len(rows), 256)]
    model.weights[feats[0, -1] if len(feats) else 0] = -3.0   # bias: most words are clean
    seen, seen_trans, seen_start = np.full(BUCKETS, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    for _ in range(epochs):
        for part in chunks:
            a, b = first_of[part.start], first_of[part.stop]
            if a == b:
                continue
            own, first = feats[a:b], first_of[part.start:part.stop + 1] - a
            y = gold[a:b].astype(int)
            prob, pairs, _ = marginals(model.weights[own].sum(1), first, model.trans, model.start)
            step = np.bincount(own.ravel(), weights=np.repeat(y - prob, own.shape[1]), minlength=BUCKETS) / len(y) ** 0.5
            inside = np.ones(b - a, dtype=bool)
            heads = first[:-1][np.diff(first) > 0]
            inside[heads] = False
            at = np.flatnonzero(inside)
            want = np.zeros((2, 2))
            np.add.at(want, (y[at - 1], y[at]), 1)
            step_trans = (want - pairs) / len(y) ** 0.5
            step_start = np.array([(1 - y[heads]).sum() - (1 - prob[heads]).sum(), y[heads].sum() - prob[heads].sum()]) / len(y) ** 0.5
            seen += step ** 2
            seen_trans += step_trans ** 2
            seen_start += step_start ** 2
            model.weights += rate * step / np.sqrt(seen)
            model.trans += rate * step_trans / np.sqrt(seen_trans)
            model.start += rate * step_start / np.sqrt(seen_start)
    lift = np.concatenate([model.weights[feats[k:k + 50_000]].sum(1) for k in range(0, max(1, len(feats)), 50_000)])
    prob, _, _ = marginals(lift, first_of, model.trans, model.start)
    model.curve = _curve(_evidence(prob, first_of), toxic.astype(float))
    model.weights = model.weights.astype(np.float32)
    return model


def score(texts: list[str | None], model: Model) -> list[tuple[float, list[dict]]]:
    """(document score, spans of offending words) of each text."""
    texts = [t or "" for t in texts]
    out: list[tuple[float, list[dict]]] = []
    if not model.trained:
        return [(model.base, [])] * len(texts)
    for part in pieces([len(t) for t in texts], BATCH_CHARS):
        w = words(texts[part])
        if len(w.starts):
            prob, _, _ = marginals(model.weights[features(w)].sum(1).astype(float), w.first, model.trans, model.start)
        else:
            prob = np.zeros(0)
        x = _evidence(prob, w.first)
        scores = 1 / (1 + np.exp(-np.clip(model.curve[0] + x @ model.curve[1:], -30, 30)))
        hits = np.flatnonzero(prob >= 0.5)
        cuts = np.searchsorted(hits, w.first)
        for k, value in enumerate(scores):
            found = hits[cuts[k]:cuts[k + 1]]
            out.append((float(value), [{"start": int(w.starts[i] - w.base[k]), "end": int(w.ends[i] - w.base[k]), "prob": float(prob[i])} for i in found]))
    return out


def fit(
    df: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_class: int = 2500, max_chars: int = 8000, folds: int = 5,
) -> Model:
    """Train on a bounded sample: about ``per_class`` labelled texts of each class, of at most ``max_chars`` characters.

    Rows of fold 0 are left out.  A document labelled twice counts as toxic if either label
    says so; null labels and texts are left out.  Without rows of both classes the model
    scores every text with the share of toxic rows.
    """
    key = F.col(id_col).cast("string")
    known = (
        labels.select(key.alias("id"), F.col(label_col).alias("y")).filter((F.coalesce(fold_of(F.col("id"), folds), F.lit(0)) != 0) & F.col("y").isNotNull())
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    counts = {int(r["y"]): r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    part = F.when(F.col("y") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    chosen = known.filter(draw < part).orderBy(draw, "id").limit(4 * per_class)
    rows = (
        df.select(key.alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= max_chars)
        .join(F.broadcast(chosen), "id").select("id", "text", "y").orderBy("id", "text").limit(8 * per_class).collect()   # at most 4 * per_class identifiers
    )
    return train([(r.text, r.y == 1) for r in rows])   # in the order of their identifiers: the same model whatever the partitions


def detect(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``toxic_score`` (0 to 1) and ``toxic_spans`` (character offsets of offending words), replacing columns of those names.

    Every text is read whole.  Null and empty texts get the score of a text without words
    and no spans.  Rows, repeated ones included, and other columns stay as they are; an
    empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)   # BUCKETS weights: bounded

    @pandas_udf(f"score double, spans {SPANS}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        for texts in batches:
            yield pd.DataFrame(score(list(texts), shared.value), columns=["score", "spans"])
        release()

    found = free_name(df, "found")
    named = {"toxic_score": F.col(f"{found}.score"), "toxic_spans": F.col(f"{found}.spans")}
    return df.withColumn(found, of(F.col(text_col))).withColumns(named).drop(found)
