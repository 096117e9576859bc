"""Packing of whole documents into sequences of a fixed length, in their order.

The token stream of a partition is cut into windows of at most ``length`` tokens.  Cuts may
lie at document ends (free), at sentence ends and, at a higher price, inside sentences.  A
dynamic program over the possible cuts finds the windows of least padding plus penalties;
padding falls linearly with a window's length, so the best start of each window comes from
a monotone queue.  Windows whose length is a power of two need no padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.frames import claim, forgetting, pieces, release
from tesserae.llm.tokens import layout, split, terms

LENGTH = 2048
END_ID = 1
#: Price, in tokens, of a cut at a sentence end and inside a sentence; the latter are offered every HARD_STEP tokens.
SENTENCE, INSIDE, HARD_STEP = 6.0, 40.0, 96
#: Price of a sequence, so that short ones are taken only where they save that much padding.
SEQUENCE = 16.0
#: Tokens gathered before windows are chosen; the last TAIL windows wait for the tokens that follow.
BUFFER, TAIL = 1 << 18, 4
#: Distinct runs whose ids a worker remembers.
REMEMBERED = 500_000
BATCH_CHARS = 1_000_000
STOPS = (".", "!", "?", "…", "。", "！", "？")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: itself where printable, else the next letter from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Kinds of bytes: white space that parts words, letters (all bytes outside ASCII at first), marks, and the rest, whose words are read whole.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[32, 10]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND[list(_MARKS)] = _MARK
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Last bytes of the sentence ends outside ASCII, all of three bytes.
_LONG_STOPS = [tuple(c.encode("utf-8")) for c in STOPS if not c.isascii()]


class Encoder:
    """Ids of whole texts; runs of letters and of marks are encoded once and remembered.

    The vocabulary drops white space and never joins over it, nor letters with marks, so a
    text's ids are those of its runs one after another.  Lower-case Latin letters are given
    to the vocabulary's model directly; words with digits, apostrophes, controls, any
    other letter or the first byte of a special token go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.kind = _KIND.copy()
        self.kind[[t.content.encode("utf-8")[0] for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]] = _OTHER
        self.direct = True
        self.forget()
        trial = ["The", "words", "Ünï", "straße", "niño", "façade", "aiaiai", "THING"]
        self.direct = all(self.of_letters(w.lower()) == self.whole([w])[0] for w in trial) and self.whole(["The.,"])[0] == self.whole(["the"])[0] + self.whole([".,"])[0]

    def forget(self) -> None:
        """Drop what is remembered; row 0 stays for runs without ids."""
        self.place: dict[bytes, int] = {}      # row of each run
        self.words: dict[bytes, int] = {}      # row of each word that is read whole
        self.flat, self.offsets = [np.zeros(0, np.uint32)], [np.zeros(2, np.int64)]
        self.rows = 1

    def whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def of_letters(self, core: str) -> bytes:
        written = core if core.isascii() else core.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def _add(self, place: dict[bytes, int], keys: list[bytes], ids: list[bytes]) -> None:
        if not keys:
            return
        place.update(zip(keys, range(self.rows, self.rows + len(keys))))
        self.rows += len(keys)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        self.offsets.append(self.offsets[-1][-1] + np.cumsum(sizes))
        self.flat.append(np.frombuffer(b"".join(ids), dtype=np.uint32))

    def _learn_runs(self, fresh: list[bytes]) -> None:
        """Remember new runs; those that are neither Latin letters nor marks get row -1: their words are read whole."""
        keys, ids, marks = [], [], []
        for run in fresh:
            if run.isalpha():   # ASCII letters, lower-case already
                keys.append(run)
                ids.append(self.of_letters(run.decode("ascii")))
            elif not run.translate(None, _MARKS) and all(self.kind[b] == _MARK for b in run):
                marks.append(run)
            else:
                core = run.decode("utf-8")
                if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
                    keys.append(run)
                    ids.append(self.of_letters(core.lower()))
                else:
                    self.place[run] = -1
        self._add(self.place, keys + marks, ids + (self.whole([m.decode("ascii") for m in marks]) if marks else []))

    def _learn_words(self, fresh: list[bytes]) -> None:
        for start in range(0, len(fresh), 4096):
            part = fresh[start:start + 4096]
            self._add(self.words, part, self.whole([w.decode("utf-8") for w in part]))

    @staticmethod
    def _rows_of(place: dict[bytes, int], keys: list[bytes], learn) -> np.ndarray:
        rows = list(map(place.get, keys))
        fresh = [k for k, row in zip(keys, rows) if row is None]
        if fresh:
            learn(list(dict.fromkeys(fresh)))
            rows = [place[k] if row is None else row for k, row in zip(keys, rows)]
        return np.array(rows, dtype=np.int64)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the token count of each, and the positions just after which a sentence ends."""
        if self.rows > REMEMBERED:
            self.forget()
        data, base = layout(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        kind = self.kind[data]
        inside = kind != _SPACE
        starts, ends, first = split(data, base, inside)
        closed = np.zeros(len(starts), dtype=bool)   # words read whole
        closed[np.searchsorted(starts, np.flatnonzero(kind == _OTHER), side="right") - 1] = True
        # runs: whole words of the closed kind, else stretches of letters or of marks
        turn = np.zeros(len(data), dtype=bool)
        if len(data):
            np.not_equal(kind[1:], kind[:-1], out=turn[1:])
            turn &= inside
        shut = ends[closed] - starts[closed]
        turn[np.repeat(starts[closed] - np.concatenate([[0], np.cumsum(shut)[:-1]]).astype(np.int64), shut) + np.arange(shut.sum())] = False
        turn[starts] = True
        begin = np.flatnonzero(turn)
        fresh_word = np.zeros(len(data), dtype=bool)
        fresh_word[starts] = True
        word = np.cumsum(fresh_word[begin]) - 1
        stop = np.append(begin[1:], 0)
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        stop[last] = ends[word[last]]
        coded = terms(_LOWER[data], inside, begin, stop).dictionary_encode()
        at = self._rows_of(self.place, coded.dictionary.to_pylist(), self._learn_runs)[coded.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64)
        if (at < 0).any() or not self.direct:   # the word of such a run is read whole: once, at its first run
            wide = np.unique(word[at < 0]) if self.direct else np.arange(len(starts))
            raw = data.tobytes()
            found = self._rows_of(self.words, [raw[a:b] for a, b in zip(starts[wide].tolist(), ends[wide].tolist())], self._learn_words)
            at[np.isin(word, wide)] = 0
            at[np.searchsorted(word, wide)] = found
        self.flat, self.offsets = [np.concatenate(self.flat)], [np.concatenate(self.offsets)]
        flat, offsets = self.flat[0], self.offsets[0]
        size = offsets[at + 1] - offsets[at]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(offsets[at] - after[:-1], size) + np.arange(after[-1])]
        runs = np.append(np.flatnonzero(fresh_word[begin]), len(word))   # first run of each word
        tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        closing = np.isin(tail, [ord(c) for c in STOPS if c.isascii()])
        for a, b, c in _LONG_STOPS:
            closing |= (tail == c) & (ends - starts >= 3) & (data[np.maximum(ends - 2, 0)] == b) & (data[np.maximum(ends - 3, 0)] == a)
        breaks = np.searchsorted(starts, np.flatnonzero(data == 10))   # words before each line break
        counts = after[runs]
        return ids, np.diff(counts[first]), np.unique(np.concatenate([counts[1:][closing], counts[breaks]]))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


forgetting["packing"] = encoder.cache_clear


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of a stream, from 0 to its end, and the price of each."""
    total = int(doc_ends[-1])
    hard = [np.arange(HARD_STEP, total, HARD_STEP), total - (total % (1 << np.arange(12)))]   # the end may fall into powers of two
    at = np.unique(np.concatenate([[0], doc_ends, sentence_ends, *hard]))
    at = at[(at >= 0) & (at <= total)]
    price = np.where(np.isin(at, sentence_ends), SENTENCE, INSIDE)
    price[np.isin(at, doc_ends) | (at == 0)] = 0.0
    # inside long sentences only: other hard cuts next to cheaper ones are never needed
    far = np.minimum(at - np.maximum.accumulate(np.where(price < INSIDE, at, 0)), np.minimum.accumulate(np.where(price < INSIDE, at, total)[::-1])[::-1] - at)
    keep = (price < INSIDE) | (far >= HARD_STEP // 2) | np.isin(at, hard[1])
    return at[keep], price[keep]


def choose(at: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into ``at`` of the window bounds of least padding plus price."""
    whole = [k for k in (1 << p for p in range(int(length).bit_length())) if k <= length]
    exact: dict[int, list[int]] = {}
    for k in whole:
        where = np.searchsorted(at, at - k)
        where = np.minimum(where, len(at) - 1)
        for j in np.flatnonzero(at[where] == at - k).tolist():
            exact.setdefault(j, []).append(int(where[j]))
    spots, prices = at.tolist(), price.tolist()
    best, back = [0.0] * len(spots), [0] * len(spots)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])   # (best + position, index), increasing from the left
    for j in range(1, len(spots)):
        spot = spots[j]
        while spots[queue[0][1]] < spot - length:
            queue.popleft()
        value, i = queue[0][0] + length - spot, queue[0][1]
        for other in exact.get(j, ()):
            if best[other] < value:
                value, i = best[other], other
        best[j], back[j] = value + prices[j] + SEQUENCE, i
        key = best[j] + spot
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(spots) - 1
    while j:
        out.append(j)
        j = back[j]
    return [0, *out[::-1]]


class _Stream:
    """Tokens of documents that wait to be cut, and the pieces of those that have been."""

    def __init__(self, length: int, prefix: int):
        self.length, self.sequence = length, prefix
        self.docs: list[tuple] = []      # (doc_id, tokens of the document, tokens already cut)
        self.ids = np.zeros(0, np.uint32)
        self.stops = np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append((doc, len(ids), 0))
        self.fresh.append((ids, stops + self.size))
        self.size += len(ids)

    def cut(self, last: bool) -> Iterator[tuple]:
        self.ids = np.concatenate([self.ids, *[f[0] for f in self.fresh]])
        self.stops = np.concatenate([self.stops, *[f[1] for f in self.fresh]])
        self.fresh = []
        if not self.size:
            return
        doc_ends = np.cumsum([n - done for _, n, done in self.docs])
        at, price = cuts(doc_ends, self.stops)
        bounds = at[choose(at, price, self.length)]
        if not last:
            bounds = bounds[:max(1, len(bounds) - TAIL)]
        stop = int(bounds[-1])
        edges = np.unique(np.concatenate([bounds, doc_ends[doc_ends < stop]]))
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        owner = np.searchsorted(doc_ends, edges[:-1], side="right")
        window = np.searchsorted(bounds, edges[:-1], side="right") - 1
        for a, b, d, w in zip(edges.tolist(), edges[1:].tolist(), owner.tolist(), window.tolist()):
            doc, n, done = self.docs[d]
            crc = zlib.crc32(self.ids[a:b].astype("<u4").tobytes())
            yield doc, done + a - int(doc_starts[d]), b - a, crc, n, self.sequence + w, a - int(bounds[w])
        self.sequence += len(bounds) - 1
        rest = int(np.searchsorted(doc_ends, stop, side="right"))
        self.docs = self.docs[rest:]
        if self.docs:
            doc, n, done = self.docs[0]
            self.docs[0] = (doc, n, done + stop - int(doc_starts[rest]))
        self.ids, self.stops = self.ids[stop:].copy(), self.stops[self.stops > stop] - stop
        self.size = len(self.ids)


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: PIECES columns, one row per piece.

    A document's ids are those of its whole text followed by END_ID; null and empty texts
    are the end id alone.  Documents follow the order of the input's partitions; each task
    packs its own rows, so nothing is shuffled, and numbers its sequences under its
    partition.  Null identifiers and repeated rows are packed like any other, an empty
    table gives no pieces, other columns are ignored.  ``vocabulary`` is the path of a
    tokenizer file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        names = [c.split()[0] for c in PIECES.split(", ")]
        stream = _Stream(length, TaskContext.get().partitionId() << 40)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=names)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            rows = list(stream.cut(last))
            for k in range(0, len(rows), 10_000):
                yield table(rows[k:k + 10_000])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in pieces([len(t) for t in texts], BATCH_CHARS):
                ids, sizes, stops = encoder(vocabulary).encode(texts[part])
                start = 0
                for doc, n in zip(docs[part], sizes.tolist()):
                    a, b = np.searchsorted(stops, (start, start + n), side="right")
                    stream.add(doc, np.append(ids[start:start + n], np.uint32(END_ID)), stops[a:b] - start)
                    start += n
                    if stream.size >= BUFFER:
                        yield from cut(False)
        yield from cut(True)
        release()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
