"""Forward-backward over many linear chains at once, and training of their weights."""

from __future__ import annotations

import numpy as np


def marginals(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every position, and the expected number of each transition over all chains.

    score: one row of label scores per position, chains one after the other; lengths: positions of each chain. Chains
    advance together, one position a step, the longest first, so a step works on one slice.
    """
    n, labels = score.shape
    lengths = lengths[lengths > 0]
    pairs = np.zeros((labels, labels))
    if not n:
        return np.zeros((0, labels)), pairs
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    sorted_lengths = lengths[order]
    steps = int(sorted_lengths[0])
    active = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
    offset = np.cumsum(active) - active
    step = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = offset[step] + np.repeat(rank, lengths)  # the place of each position, ordered by step
    local = np.empty((n, labels))
    local[at] = np.exp(score - score.max(axis=1, keepdims=True))
    move, first = np.exp(transition), np.exp(start)

    ahead = np.empty((n, labels))
    a = local[: active[0]] * first
    a /= a.sum(axis=1, keepdims=True)
    ahead[: active[0]] = a
    for t in range(1, steps):
        i, k = offset[t], active[t]
        a = (a[:k] @ move) * local[i : i + k]
        a /= a.sum(axis=1, keepdims=True)
        ahead[i : i + k] = a
    out = np.empty((n, labels))
    b = np.ones((active[-1], labels))
    for t in range(steps - 1, -1, -1):
        i, k = offset[t], active[t]
        if len(b) < k:  # chains that end here
            b = np.concatenate((b, np.ones((k - len(b), labels))))
        g = ahead[i : i + k] * b
        g /= g.sum(axis=1, keepdims=True)
        out[i : i + k] = g
        if t:
            w = local[i : i + k] * b
            before = ahead[offset[t - 1] : offset[t - 1] + k]
            b = w @ move.T
            pairs += (before.T @ (w / (before * b).sum(axis=1, keepdims=True))) * move
            b /= b.sum(axis=1, keepdims=True)
    return out[at], pairs


class Adam:
    """Gradient ascent with per-weight step sizes."""

    def __init__(self, *weights: np.ndarray, rate: float):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def step(self, *gradients: np.ndarray) -> None:
        self.turn += 1
        for w, g, m, s in zip(self.weights, gradients, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w += self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(s / (1 - 0.99**self.turn)) + 1e-8)


def observed_pairs(label: np.ndarray, lengths: np.ndarray, labels: int) -> np.ndarray:
    """How often each transition occurs in labelled chains."""
    inside = np.ones(len(label), dtype=bool)
    inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    to = np.flatnonzero(inside)
    return np.bincount(label[to - 1] * labels + label[to], minlength=labels * labels).reshape(labels, labels).astype(float)
