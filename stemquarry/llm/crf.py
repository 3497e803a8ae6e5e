"""Linear-chain conditional random field core in numpy: padded batches of sequences.

Callers turn features into emission scores (one row per position); this module adds transitions
and gives log-likelihoods, marginals with expected transitions (forward-backward) and best paths
(Viterbi).  Sequences are laid out time-major and processed longest together, so one array
operation advances every sequence of a batch by one position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Padded cells (positions times sequences) of one batch at most, unless one sequence is longer.
BATCH_CELLS = 1 << 17


def batches(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, length, mask) per batch: rows[t, i] is the flat position of step t of sequence i.

    ``first`` delimits sequences in flat order; empty ones are left out.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < order.size:
        longest = int(n[order[at]])
        pick = order[at : at + max(1, BATCH_CELLS // longest)]
        step = np.arange(longest)[:, None]
        mask = step < n[pick]
        yield np.where(mask, first[pick] + step, first[pick]), n[pick], mask
        at += pick.size


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(state marginals per position, expected transitions, sum of log partition functions)."""
    out, pairs, total = np.zeros_like(emit), np.zeros_like(move), 0.0
    for rows, n, mask in batches(first):
        e = emit[rows]
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[0] = e[0]
        for t in range(1, len(e)):
            step = _lse(fwd[t - 1][:, :, None] + move, 1) + e[t]
            fwd[t] = np.where(mask[t][:, None], step, fwd[t - 1])
        for t in range(len(e) - 2, -1, -1):
            step = _lse(move[None] + (e[t + 1] + bwd[t + 1])[:, None, :], 2)
            bwd[t] = np.where(mask[t + 1][:, None], step, 0.0)
        z = _lse(fwd[-1], 1)
        total += float(z.sum())
        out[rows[mask]] = np.exp(fwd + bwd - z[:, None])[mask]
        if len(e) > 1:
            joint = fwd[:-1, :, :, None] + move + (e[1:] + bwd[1:])[:, :, None, :] - z[None, :, None, None]
            pairs += np.exp(joint[mask[1:]]).sum(axis=0)
    return out, pairs, total


#: Positions from which a chain of two states is run in pieces.
LONG_CHAIN = 4096


def _odds(drive: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward log odds of state 1 of two at every position: x = drive + log odds of a step from the
    position before.  All chains that still run advance together; a long one is run in pieces."""
    ahead = lambda x: np.logaddexp(move[0, 1], x + move[1, 1]) - np.logaddexp(move[0, 0], x + move[1, 0])
    out, n = drive.astype(np.float64).copy(), np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 1]
    for i in order[n[order] > LONG_CHAIN].tolist():
        out[first[i] : first[i + 1]] = _long_odds(out[first[i] : first[i + 1]], move, ahead)
    order = order[n[order] <= LONG_CHAIN]
    begin, size = first[:-1][order], n[order]
    for t in range(1, int(size[0]) if size.size else 0):
        rows = begin[: np.searchsorted(-size, -t, side="left")] + t
        out[rows] += ahead(out[rows - 1])
    return out


def _long_odds(drive: np.ndarray, move: np.ndarray, ahead) -> np.ndarray:
    """One chain as square-root many pieces: a step is a fractional linear map of the odds, so a piece is
    a 2 x 2 matrix; the pieces' entry odds come from their products, then all pieces run together."""
    steps = drive.size - 1
    size = math.isqrt(steps) + 1
    pieces = -(-steps // size)
    d = np.zeros(pieces * size)
    d[:steps] = drive[1:]
    d = d.reshape(pieces, size)
    map_ = np.broadcast_to(np.eye(2), (pieces, 2, 2)).copy()
    for t in range(size):
        up = np.stack([np.stack([d[:, t] + move[1, 1], d[:, t] + move[0, 1]], axis=1), np.broadcast_to([move[1, 0], move[0, 0]], (pieces, 2))], axis=1)
        map_ = np.exp(up - up.max(axis=(1, 2), keepdims=True)) @ map_
        map_ /= map_.max(axis=(1, 2), keepdims=True)
    entry, x = np.empty(pieces), drive[0]
    for p in range(pieces):
        entry[p] = x
        top = max(x, 0.0)
        u, v = map_[p] @ np.exp([x - top, -top])
        x = float(np.log(max(u, 1e-300)) - np.log(max(v, 1e-300)))
    out = np.empty((pieces, size))
    for t in range(size):
        entry = d[:, t] + ahead(entry)
        out[:, t] = entry
    return np.concatenate((drive[:1], out.ravel()[:steps]))


def binary_marginals(drive: np.ndarray, first: np.ndarray, move: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of state 1 at each position, expected transitions) of chains of two states; ``drive``
    is the emission score of state 1 less that of state 0."""
    n = drive.size
    fwd = _odds(drive, first, move)
    back = _odds(drive[::-1], n - first[::-1], move.T)[::-1]  # drive and all that follows
    total = np.clip(fwd + back - drive, -500, 500)
    pairs = np.zeros((2, 2))
    if with_pairs and n:
        inner = np.ones(n, bool)
        inner[first[:-1][first[:-1] < n]] = False
        at = np.flatnonzero(inner)
        x, y = fwd[at - 1], back[at]
        log = np.stack([np.full(at.size, move[0, 0]), move[0, 1] + y, move[1, 0] + x, move[1, 1] + x + y])
        weight = np.exp(log - log.max(axis=0)) if at.size else log
        pairs = (weight / weight.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return 1 / (1 + np.exp(-total)), pairs


def viterbi(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best state of each position; ties go to the lower state."""
    out = np.zeros(len(emit), np.int64)
    for rows, n, mask in batches(first):
        e = emit[rows]
        back = np.zeros(e.shape, np.int8)
        best = e[0]
        for t in range(1, len(e)):
            reach = best[:, :, None] + move
            back[t] = np.where(mask[t][:, None], reach.argmax(axis=1), np.arange(move.shape[0]))
            best = np.where(mask[t][:, None], reach.max(axis=1) + e[t], best)
        state = best.argmax(axis=1)
        lane = np.arange(state.size)
        for t in range(len(e) - 1, -1, -1):
            live = mask[t]
            out[rows[t][live]] = state[live]
            state = np.where(live, back[t][lane, state], state)
    return out


def score_of(path: np.ndarray, emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray]:
    """(score of the given paths, their transition counts)."""
    count = np.zeros_like(move)
    inner = np.ones(len(path), bool)
    inner[first[:-1][first[:-1] < len(path)]] = False
    at = np.flatnonzero(inner)
    np.add.at(count, (path[at - 1], path[at]), 1)
    return float(emit[np.arange(len(path)), path].sum() + (count * move).sum()), count


class Adam:
    """Gradient ascent steps with per-parameter rates."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * grad**2
        value += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
