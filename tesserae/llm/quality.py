"""Quality of whole texts: base rules, and a log-likelihood ratio of hashed character n-grams.

Two multinomials over hashed character trigrams are counted over whole tables: one over the
documents whose labels are trusted, one over all documents.  A text's score is the mean log
ratio of the two over its trigrams.  A threshold, chosen from the scores of every labelled
document, decides on every text.  Counts, weights and scores are whole numbers, so results
do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tesserae.llm.frames import cut, free_name, pieces
from tesserae.llm.tokens import SPACES, layout, split, terms

#: Buckets of trigrams (a prime), and the factors of a trigram's first two code points.
BUCKETS, FIRST, SECOND = 65_521, 48_271, 16_807
#: Weights are millionths of a nat, scores thousandths.
WEIGHT, SCORE = 1_000_000, 1000
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
BATCH_CHARS = 1_000_000
#: Labels sent to the texts instead of texts to the labels; about 25 bytes each.
LABELS_SENT = 4_000_000
FOUND = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_sum long, quality_grams long"


@dataclass
class Model:
    weights: np.ndarray   # of each bucket, and a zero for places without a trigram
    threshold: int        # least score kept, in thousandths of a nat
    trusted: int          # documents behind the weights and the threshold
    rejected: int


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each stretch [bounds[k], bounds[k + 1]), empty ones included."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


class Texts:
    """Words of a batch of texts, and their code points with one space between words."""

    def __init__(self, texts: pa.Array):
        data, base = layout(texts)
        inside = ~SPACES[data]
        starts, ends, self.first = split(data, base, inside)
        self.words = terms(data, inside, starts, ends)
        kept = inside.copy()
        owner = np.repeat(np.arange(len(base) - 1), np.diff(self.first))
        gaps = ends[:-1][owner[1:] == owner[:-1]]   # the first space behind every word but a text's last
        kept[gaps] = True
        joined = np.where(inside, data, np.uint8(32))[kept]
        points = (joined & 0xC0) != 0x80   # bytes that begin a code point
        self.codes = np.frombuffer(joined.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        bytes_before = np.concatenate([[0], np.cumsum(kept)])[base]
        self.base = np.concatenate([[0], np.cumsum(points)])[bytes_before].astype(np.int64)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the trigram that begins at each code point, BUCKETS where none does; and each text's trigrams."""
        sizes = np.maximum(np.diff(self.base) - 2, 0)
        out = np.full(len(self.codes), BUCKETS, dtype=np.int64)
        if len(self.codes) > 2:
            c = self.codes.astype(np.int64)
            out[:-2] = (c[:-2] * FIRST + c[1:-1] * SECOND + c[2:]) % BUCKETS
        ends = self.base[1:]
        for back in (1, 2):
            at = ends - back
            out[at[at >= self.base[:-1]]] = BUCKETS
        return out, sizes

    def repeats(self, room: int = 62) -> np.ndarray:
        """Words of each text in windows of WINDOW words that it holds twice or more; windows are numbered in ``room`` bits."""
        count = len(self.words)
        if count < WINDOW:
            return np.zeros(len(self.first) - 1, dtype=np.int64)
        ids = self.words.dictionary_encode()
        key, bits = ids.indices.to_numpy().astype(np.int64), max(1, len(ids.dictionary).bit_length())
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        windows = key[:count - WINDOW + 1]
        wide = bits
        for step in range(1, WINDOW):
            if wide + bits > room:   # very large vocabularies: number the windows so far
                windows = np.unique(windows, return_inverse=True)[1].astype(np.int64)
                wide = len(windows).bit_length()
            windows, wide = (windows << bits) | key[step:count - WINDOW + 1 + step], wide + bits
        inside = np.flatnonzero(owner[:count - WINDOW + 1] == owner[WINDOW - 1:])
        order = inside[np.argsort(windows[inside], kind="stable")]
        same = (windows[order[1:]] == windows[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        again = np.zeros(count, dtype=bool)
        for step in range(WINDOW):
            again[order[1:][same] + step] = True
            again[order[:-1][same] + step] = True
        return _sums(again, self.first)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in (text or "").split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, weights: np.ndarray) -> pa.StructArray:
    """FOUND of each text; nulls count as empty."""
    texts = pc.fill_null(texts, "")
    names = [c.split()[0] for c in FOUND.split(", ")]
    out = []
    for part in pieces(pc.binary_length(texts).to_pylist(), BATCH_CHARS):
        own = texts[part]
        batch = Texts(own)
        marks = np.zeros(256, dtype=bool)
        marks[[ord(c) for c in SYMBOLS]] = True
        words = np.diff(batch.first)
        buckets, grams = batch.trigrams()
        out.append(np.stack([
            words, np.diff(batch.base) - np.maximum(words - 1, 0), _sums(marks[np.minimum(batch.codes, 255)] & (batch.codes < 256), batch.base),
            np.array([repeated_lines(t) for t in own.to_pylist()], dtype=np.int64), batch.repeats(), _sums(weights[buckets], batch.base), grams,
        ]))
    values = np.concatenate(out, axis=1) if out else np.zeros((len(names), 0), dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], names=names)


def counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of all texts by bucket; every task hands on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for part in pieces(pc.binary_length(texts).to_pylist(), BATCH_CHARS):
                total += np.bincount(Texts(texts[part]).trigrams()[0], minlength=BUCKETS + 1)
        at = np.flatnonzero(total[:BUCKETS])
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Weight of each bucket: log of its share of the trusted trigrams over its share of all, one added to every count."""
    own, whole = np.log((trusted + 1.0) / (trusted.sum() + float(BUCKETS))), np.log((raw + 1.0) / (raw.sum() + float(BUCKETS)))
    weights = np.floor((own - whole) * WEIGHT + 0.5).astype(np.int64) if trusted.sum() else np.zeros(len(raw), dtype=np.int64)
    return np.append(weights, 0)


def pick(by_score: dict[int, tuple[int, int]]) -> int:
    """Threshold of least error on (trusted, rejected) documents by score: the sum of the shares on the wrong side.

    Of equally good ones the middle of the highest run of scores counts, so that a gap
    between the two is halved.  Without rejected documents it is the lowest trusted score;
    without trusted ones everything is kept.
    """
    scores = sorted(by_score)
    good, bad = sum(t for t, _ in by_score.values()), sum(r for _, r in by_score.values())
    if not good:
        return -(1 << 62)
    if not bad:
        return min(s for s in scores if by_score[s][0])
    best, choice, lost, held = None, 0, 0, bad
    before = None
    for s in [*scores, scores[-1] + 1]:   # keep scores of s and above
        error = lost * bad + held * good
        if best is None or error <= best:
            best, choice = error, s if before is None else before + (s - before + 1) // 2
        if s in by_score:
            lost, held = lost + by_score[s][0], held - by_score[s][1]
        before = s
    return choice


def with_score(df: DataFrame) -> DataFrame:
    """``quality_score``: mean log ratio in thousandths of a nat, 0 for texts of fewer than three characters."""
    each = F.floor(F.col("quality_sum").cast("double") / (F.col("quality_grams") * (WEIGHT // SCORE)).cast("double")).cast("long")
    return df.withColumn("quality_score", F.when(F.col("quality_grams") > 0, each).otherwise(F.lit(0).cast("long")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> Model:
    """Count both multinomials over all documents, and choose the threshold on all labelled ones.

    A document is trusted if all its labels say 1, rejected if one says 0; null labels,
    null identifiers and labels without a document are ignored, repeated documents count
    each time.  What reaches the driver is one number a bucket and two a score.  Up to
    LABELS_SENT labels travel to the texts; more are joined by identifier, and the labelled
    texts are then written once.
    """
    known = labels.filter(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(F.col(quality_col).cast("int")) == 1).alias("good"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    if known.limit(LABELS_SENT + 1).count() <= LABELS_SENT:
        texts = texts.join(F.broadcast(known), "id")
    else:
        texts = cut(texts.join(known, "id"))
    weights = log_ratio(counts(texts.filter("good")), counts(docs, text_col))
    scored = with_score(texts.select("good", _measured(texts, "text", weights).alias("m")).select("good", "m.quality_sum", "m.quality_grams"))
    rows = scored.groupBy("quality_score").agg(F.count_if("good").alias("t"), F.count_if(~F.col("good")).alias("r")).collect()
    by_score = {r.quality_score: (r.t, r.r) for r in rows}
    return Model(weights, pick(by_score), sum(t for t, _ in by_score.values()), sum(r for _, r in by_score.values()))


def _measured(df: DataFrame, text_col: str, weights: np.ndarray):
    shared = df.sparkSession.sparkContext.broadcast(weights)   # BUCKETS numbers

    @arrow_udf(f"struct<{', '.join(c.replace(' ', ':') for c in FOUND.split(', '))}>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield measure(texts, shared.value)

    return of(F.col(text_col).cast("string"))


def judge(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept.

    Columns of these names are replaced.  Null texts are empty; a text of fewer than 50
    words, or with more than half its words in repeated windows of three words, fails the
    base rules, any other is kept if its score reaches the model's threshold.  Every text is
    read whole; repeated rows are judged alike, an empty table stays empty.
    """
    found = free_name(df, "found")
    base = [c.split()[0] for c in FOUND.split(", ")]
    out = df.withColumn(found, _measured(df, text_col, model.weights)).withColumns({c: F.col(f"{found}.{c}") for c in base}).drop(found)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = with_score(out).drop("quality_sum", "quality_grams").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= model.threshold))
