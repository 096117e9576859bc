"""Language of whole texts and of their spans.

Letters' script ranges leave each word its candidate languages, hashed character n-grams
score the word under each of them, and Viterbi with a switching penalty labels the words,
so that texts of mixed languages fall into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tesserae.llm.chains import viterbi
from tesserae.llm.codes import BATCH_CHARS, mix, tables, words
from tesserae.llm.frames import claim, fold_of, free_name, pieces, release

#: First code points of script ranges and the script each begins; the script of a word is that of its first letter.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x31A0, "kana"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_EDGES = np.array([s[0] for s in SCRIPTS], dtype=np.uint32)
_NAMES = sorted({s[1] for s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s[1]) for s in SCRIPTS])

BUCKETS = 1 << 17
#: Cost of changing the language between two words, in nats.
PENALTY = 6.0
UNKNOWN = "und"
SPANS = "array<struct<start:int,end:int,lang:string>>"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray   # (n-gram bucket, language): log probabilities, less their mean over languages
    allowed: np.ndarray   # (script, language)


def _gram_buckets(w) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that end at each letter, edges of words included; shape (letters, 3)."""
    kind, _ = tables()
    codes = np.where(kind[w.codes] > 0, w.codes, 0).astype(np.uint64)
    before, after = np.roll(codes, 1), np.roll(codes, -1)
    inner = np.flatnonzero(codes)
    here, before, after = codes[inner], before[inner], after[inner]
    shift = np.uint64(21)
    grams = np.stack([here, here | (before + np.uint64(1)) << shift, here | (before + np.uint64(1)) << shift | (after + np.uint64(1)) << np.uint64(42)], axis=1)
    return (mix(grams) >> np.uint64(47)).astype(np.int64)


def word_scripts(w) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_EDGES, w.codes[w.starts], side="right") - 1]


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on (text, language) pairs: n-gram counts with additive smoothing, and the languages seen in each script."""
    langs = sorted({lang for _, lang in rows})
    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    scripts = np.zeros((len(_NAMES), max(1, len(langs))))
    for k, lang in enumerate(langs):
        texts = [t for t, own in rows if own == lang]
        for part in pieces([len(t) for t in texts], BATCH_CHARS):
            w = words(texts[part])
            counts[:, k] += np.bincount(_gram_buckets(w).ravel(), minlength=BUCKETS)
            scripts[:, k] += np.bincount(word_scripts(w), minlength=len(_NAMES))
    logs = np.log(counts / counts.sum(0))
    share = scripts / np.maximum(scripts.sum(0), 1)
    return Model(langs, (logs - logs.mean(1, keepdims=True)).astype(np.float32), share >= 0.01)


def label(texts: list[str | None], model: Model) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; the score is the share of letters in spans of that language."""
    texts = [t or "" for t in texts]
    if not model.langs:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    out = []
    for part in pieces([len(t) for t in texts], BATCH_CHARS):
        w = words(texts[part])
        size = w.ends - w.starts
        lines = np.concatenate([[0], np.cumsum(size)])[:-1]
        if len(size):
            emit = np.add.reduceat(model.weights[_gram_buckets(w)].sum(1), lines, axis=0).astype(np.float64)
            open_to = model.allowed[word_scripts(w)]
            emit[~open_to & open_to.any(1)[:, None]] -= 1e4
        else:
            emit = np.zeros((0, len(model.langs)))
        labels = viterbi(emit, w.first, PENALTY)
        for k in range(len(w.base) - 1):
            a, b = w.first[k], w.first[k + 1]
            if not w.lettered[k]:
                out.append((UNKNOWN, 0.0, []))
                continue
            own = labels[a:b]
            share = np.bincount(own, weights=size[a:b], minlength=len(model.langs))
            best = int(share.argmax())
            turns = np.flatnonzero(np.diff(own)) + 1
            begin, end = np.concatenate([[0], turns]), np.concatenate([turns, [len(own)]]) - 1
            spans = [
                {"start": int(w.starts[a + i] - w.base[k]), "end": int(w.ends[a + j] - w.base[k]), "lang": model.langs[own[i]]} for i, j in zip(begin, end)
            ]
            out.append((model.langs[best], float(share[best] / share.sum()), spans))
    return out


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 1500, max_chars: int = 20_000, folds: int = 5) -> Model:
    """Train on a bounded sample: about ``per_lang`` texts of each language, of at most ``max_chars`` characters.

    Rows of fold 0 (crc32 of the identifier modulo ``folds``) and rows without a language
    or text are left out.  Which rows are sampled depends on a hash of the identifier only.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        (F.coalesce(fold_of(F.col("id"), folds), F.lit(0)) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars),
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(part)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / (1 << 20)
    rows = known.filter(draw < part).select("text", "lang").limit(2 * per_lang * max(1, len(counts))).collect()
    return train([(r.text, r.lang) for r in rows])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``lang_score`` and ``lang_spans`` (character offsets), replacing columns of those names.

    Every text is read whole.  Null texts and texts without a letter are ``und`` with score
    0 and no span; so is every text if the model knows no language.  Rows, repeated ones
    included, and other columns stay as they are; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)   # BUCKETS x languages: bounded

    @pandas_udf(f"lang string, score double, spans {SPANS}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language")
        for texts in batches:
            yield pd.DataFrame(label(list(texts), shared.value), columns=["lang", "score", "spans"])
        release()

    found = free_name(df, "found")
    named = {"lang_pred": F.col(f"{found}.lang"), "lang_score": F.col(f"{found}.score"), "lang_spans": F.col(f"{found}.spans")}
    return df.withColumn(found, of(F.col(text_col))).withColumns(named).drop(found)
