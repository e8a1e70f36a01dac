"""A linear-chain conditional random field over dense features, trained and decoded in numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _batch(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length, the first row of each, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    firsts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), "right")
    return order, firsts, active


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Crf:
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels
    begin: np.ndarray
    forbidden: np.ndarray  # transitions that no path takes
    forbidden_first: np.ndarray

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of every row; rows lie sequence by sequence. A zero length is skipped."""
        return viterbi(x @ self.emit, lengths, self.move + self.forbidden, self.begin + self.forbidden_first)


def viterbi(e: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.zeros(len(e), np.int8)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return out
    _, firsts, active = _batch(lengths)
    back = np.zeros(e.shape, np.int8)
    score = e[firsts] + begin
    for t in range(1, len(active)):
        n = active[t]
        through = score[:n, :, None] + move[None]
        rows = firsts[:n] + t
        back[rows] = through.argmax(1)
        score[:n] = through.max(1) + e[rows]
    label = score.argmax(1).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = firsts[:n] + t
        if t + 1 < len(active):
            m = active[t + 1]
            label[:m] = back[firsts[:m] + t + 1, label[:m]]
        out[rows] = label[:n]
    return out


def train(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, k: int, forbidden: np.ndarray | None = None, forbidden_first: np.ndarray | None = None, steps: int = 120, rate: float = 0.15, penalty: float = 0.02) -> Crf:
    """Penalized maximum likelihood by Adam; the same input gives the same weights."""
    lengths = lengths[lengths > 0]
    order, firsts, active = _batch(lengths)
    forbidden = np.zeros((k, k)) if forbidden is None else forbidden
    forbidden_first = np.zeros(k) if forbidden_first is None else forbidden_first
    model = Crf(np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros(k), forbidden, forbidden_first)
    params = [model.emit, model.move, model.begin]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    inner = np.ones(len(x), bool)
    inner[np.sort(firsts)] = False
    inner = np.flatnonzero(inner)
    seen_emit = np.zeros_like(model.emit)
    np.add.at(seen_emit.T, y, x)
    seen_move = np.zeros((k, k))
    np.add.at(seen_move, (y[inner - 1], y[inner]), 1)
    seen_begin = np.bincount(y[firsts], minlength=k).astype(float)
    for step in range(1, steps + 1):
        e = x @ model.emit
        move, begin = model.move + forbidden, model.begin + forbidden_first
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[firsts] = e[firsts] + begin
        for t in range(1, len(active)):
            r = firsts[: active[t]] + t
            a[r] = _lse(a[r - 1][:, :, None] + move[None], 1) + e[r]
        for t in range(len(active) - 1, 0, -1):
            r = firsts[: active[t]] + t
            b[r - 1] = _lse(move[None] + (b[r] + e[r])[:, None, :], 2)
        z = np.zeros(len(x))
        z[firsts] = _lse(a[firsts] + b[firsts], 1)
        z = np.repeat(z[np.sort(firsts)], lengths)
        p = np.exp(a + b - z[:, None])
        pair = np.exp(a[inner - 1][:, :, None] + move[None] + (b[inner] + e[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
        n = len(lengths)
        grads = [(seen_emit - x.T @ p) / n - penalty * model.emit / 10, (seen_move - pair) / n - penalty * model.move / 10, (seen_begin - p[firsts].sum(0)) / n - penalty * model.begin / 10]
        for w, g, m, v in zip(params, grads, first_moment, second_moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model
