"""Words of many texts at once, as numpy arrays over code points.

Texts are laid out one after another; words are runs of letters and marks.  Every later
step (n-grams, hashes, features) is then array work over a bounded batch, with no Python
per word.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

_STEP = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Characters handled at once by the operators that work on batches of texts.
BATCH_CHARS = 1_000_000
#: Longest series of powers a worker keeps.
KEPT_POWERS = 1 << 22


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks, else 0; and the lower-case code point."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group == "L":
            kind[c] = 2
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif group == "M":
            kind[c] = 1
    return kind, lower


@dataclass
class Words:
    codes: np.ndarray    # lower-cased code points of all texts, a line break after each
    starts: np.ndarray   # of each word
    ends: np.ndarray
    base: np.ndarray     # where each text starts; one more at the end
    first: np.ndarray    # each text's first word; one more at the end
    lettered: np.ndarray # whether each text has a letter


def words(texts: list[str]) -> Words:
    base = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    kind, lower = tables()
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32) if texts else np.zeros(0, np.uint32)
    kinds = kind[codes]
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = kinds > 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    letters = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(kinds == 2, out=letters[1:])
    return Words(lower[codes], starts, ends, base, np.searchsorted(starts, base), np.diff(letters[base]) > 0)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their high bits can be used."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


_held: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of the step and of its inverse; one pair serves all sizes, very long ones are not kept."""
    if size <= len(_held[0]):
        return _held[0], _held[1]

    def series(factor: int) -> np.ndarray:
        steps = np.full(size, factor, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    pair = series(_STEP), series(pow(_STEP, -1, 1 << 64))
    if size <= KEPT_POWERS:
        _held[:] = pair
    return pair


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    up, _ = _powers(1 << max(10, int(len(codes)).bit_length()))
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], out=sums[1:], dtype=np.uint64)
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal content, equal hash, wherever it stands."""
    _, down = _powers(1 << max(10, int(len(sums) - 1).bit_length()))
    return mix((sums[ends] - sums[starts]) * down[starts])
