"""Recursions over many label chains at once.

Chains of one batch lie one after another.  Sorted by length, the chains that reach step t
are a prefix, so each step is a few array operations over all of them and nothing is padded.
"""

from __future__ import annotations

import numpy as np


def _order(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the non-empty chains, longest first, and how many reach each step."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    length = length[order]
    reach = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
    return first[:-1][order], length, reach


def viterbi(emit: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each position when every change of label costs ``penalty``; ties stay, then go to the lower label."""
    starts, length, reach = _order(first)
    labels = np.zeros(len(emit), dtype=np.int64)
    if not len(starts):
        return labels
    came = np.zeros(len(emit), dtype=np.int64)          # best label one step before, if the label changes here
    moved = np.zeros(emit.shape, dtype=bool)
    score = emit[starts].copy()
    for t in range(1, len(reach)):
        n = reach[t]
        at = starts[:n] + t
        held = score[:n]
        best = held.argmax(1)
        jump = held[np.arange(n), best][:, None] - penalty
        change = jump > held
        came[at], moved[at] = best, change
        score[:n] = np.where(change, jump, held) + emit[at]
    now = score.argmax(1)
    for t in range(len(reach) - 1, -1, -1):
        n = reach[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = np.where(moved[at, now[:n]], came[at], now[:n])
    return labels


def marginals(lift: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for two labels.

    ``lift`` is the score of label 1 over label 0 at each position, ``trans[a, b]`` the
    score of b after a, ``start`` that of the first label.  Returns the probability of
    label 1 at each position, the expected counts of each transition, and the summed
    log of the normalizers.
    """
    starts, length, reach = _order(first)
    prob = np.zeros(len(lift))
    pairs = np.zeros((2, 2))
    if not len(starts):
        return prob, pairs, 0.0
    move = np.exp(trans)
    peak = np.maximum(lift, 0)
    one, zero = np.exp(lift - peak), np.exp(-peak)       # scaled potentials of labels 1 and 0
    fwd0, fwd1, norm = np.empty(len(lift)), np.empty(len(lift)), np.empty(len(lift))
    a0, a1 = zero[starts] * np.exp(start[0]), one[starts] * np.exp(start[1])
    for t in range(len(reach)):
        n = reach[t]
        at = starts[:n] + t
        if t:
            b0, b1 = a0[:n], a1[:n]
            n0, n1 = (b0 * move[0, 0] + b1 * move[1, 0]) * zero[at], (b0 * move[0, 1] + b1 * move[1, 1]) * one[at]
        else:
            n0, n1 = a0, a1
        total = n0 + n1
        a0[:n], a1[:n] = n0 / total, n1 / total
        fwd0[at], fwd1[at], norm[at] = a0[:n], a1[:n], total
    back0, back1 = np.ones(len(starts)), np.ones(len(starts))
    for t in range(len(reach) - 1, -1, -1):
        n = reach[t]
        at = starts[:n] + t
        prob[at] = fwd1[at] * back1[:n] / (fwd0[at] * back0[:n] + fwd1[at] * back1[:n])
        if t:
            c0, c1 = back0[:n] * zero[at] / norm[at], back1[:n] * one[at] / norm[at]
            f0, f1 = fwd0[at - 1], fwd1[at - 1]
            pairs += [[(f0 * c0).sum() * move[0, 0], (f0 * c1).sum() * move[0, 1]], [(f1 * c0).sum() * move[1, 0], (f1 * c1).sum() * move[1, 1]]]
            back0[:n], back1[:n] = move[0, 0] * c0 + move[0, 1] * c1, move[1, 0] * c0 + move[1, 1] * c1
    return prob, pairs, float(np.log(norm).sum() + peak.sum())
