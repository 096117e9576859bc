"""Encoding and decoding with the scored pieces of a SentencePiece model file.

A text's encoding is the sequence of pieces of largest summed score.  An Aho-Corasick
automaton over all pieces reads the text once; at each position its output links give
every piece that ends there, and each relaxes the best score of that position.  Characters
that no piece covers fall back to their bytes' pieces, or to the unknown piece.

No piece but runs of the space mark holds the mark after another character (checked when
the file is read), so texts fall apart before each run of spaces, and the parts, mostly
words, are encoded once and remembered.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Added to the lowest score for each byte of a character without a piece.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
_PART = re.compile(f"{SPACE}*[^{SPACE}]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message of the model file."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            if kind == 2:
                size, at = number(at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The pieces of a model file, their automaton, and what has been encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        rules: dict[int, int | bytes] = {}
        for field, value in fields:
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 3:
                rules |= dict(_fields(value))
        if rules.get(2) or rules.get(4, 1):
            raise ValueError("model files that rewrite characters or drop spaces are not lossless and not supported")
        self.dummy = bool(rules.get(3, 1))
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((k for k, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        usable = [(p, s, k) for k, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)]
        low = min((s for _, s, _ in usable), default=0.0)
        self.missing = low - UNKNOWN_PENALTY
        top = max((s for _, s, _ in usable), default=0.0)
        self.automaton = ahocorasick.Automaton()
        for piece, score, k in usable:
            # a user-defined piece always wins over what it covers, as in the library
            self.automaton.add_word(piece, (len(piece), len(piece) * top + 1.0 if self.pieces[k][2] == USER else score, k))
        self.automaton.make_automaton()
        self.apart = not any(SPACE in p.lstrip(SPACE) for p, _, _ in usable)
        self.known: dict[str, array] = {}
        self.shown = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]

    def best(self, part: str) -> array:
        """Ids of the best segmentation of ``part`` (spaces already marked)."""
        n = len(part)
        score = [0.0] + [float("-inf")] * n
        start_of, piece_of = [0] * (n + 1), [-1] * (n + 1)
        missing, done = self.missing, 0          # positions up to ``done`` are final
        for last, (size, value, k) in self.automaton.iter(part):
            while done < last:
                # the one character before may stand without a piece, if no piece does better
                done += 1
                if score[done - 1] + missing > score[done]:
                    score[done], start_of[done], piece_of[done] = score[done - 1] + missing, done - 1, -1
            end = last + 1
            total = score[end - size] + value
            if total > score[end]:
                score[end], start_of[end], piece_of[end] = total, end - size, k
        while done < n:
            done += 1
            if score[done - 1] + missing > score[done]:
                score[done], start_of[done], piece_of[done] = score[done - 1] + missing, done - 1, -1
        steps, at = [], n
        while at:
            steps.append((start_of[at], at, piece_of[at]))
            at = start_of[at]
        ids = array("i")
        for start, end, k in reversed(steps):
            if k >= 0:
                ids.append(k)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in part[start:end].encode("utf-8"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def encode(self, text: str | None) -> array:
        """Ids of a whole text; null and empty texts have none."""
        ids = array("i")
        if not text:
            return ids
        marked = text.replace(" ", SPACE)
        if self.dummy:
            marked = SPACE + marked
        if not self.apart:
            return self.best(marked)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for part in _PART.findall(marked):
            found = known.get(part)
            if found is None:
                found = known[part] = self.best(part)
            ids += found
        return ids

    def decode(self, ids: list[int] | None) -> str:
        """Text of ids; bytes that form no character become the replacement character.

        One space that encoding put before the text is taken away again.
        """
        raw = b"".join(map(self.shown.__getitem__, () if ids is None else ids))
        text = raw.decode("utf-8", errors="replace")
        return text[1:] if self.dummy and text[:1] == " " else text


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``out`` (replacing a column of that name); null and empty texts have none."""

    @pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(pieces(model).encode(t), dtype=np.int32) for t in texts], dtype=object)

    return df.withColumn(out, of(F.col(text_col)))


def decode(df: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of each row's ids as ``out``; null ids give an empty text."""

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([pieces(model).decode(None if r is None else r.tolist()) for r in rows], dtype=object)

    return df.withColumn(out, of(F.col(ids_col)))

