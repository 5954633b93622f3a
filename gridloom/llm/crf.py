"""A small linear-chain conditional random field in numpy."""

from __future__ import annotations

import numpy as np


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def apart(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans, in order and apart from each other, that touch none of ``base``, in order of their starts: one walk over both."""
    out, k, end = [], 0, 0
    for s in spans:
        while k < len(base) and base[k][0] < s[1]:
            end = max(end, base[k][1])
            k += 1
        if end <= s[0]:
            out.append(s)
    return out


class LinearChain:
    """Weights of features by label, of label pairs, and of first labels."""

    def __init__(self, features: int, labels: int):
        self.emit = np.zeros((features, labels))
        self.pair = np.zeros((labels, labels))
        self.first = np.zeros(labels)

    def scores(self, tokens: list[list[int]]) -> np.ndarray:
        """Label scores of tokens that are given by their active features."""
        return np.array([self.emit[f].sum(axis=0) for f in tokens]).reshape(len(tokens), -1)

    def viterbi(self, scores: np.ndarray, allowed: np.ndarray | None = None) -> list[int]:
        """The best label sequence; ``allowed`` masks labels that a token cannot have."""
        scores = scores if allowed is None else np.where(allowed, scores, -np.inf)
        best, back = self.first + scores[0], []
        for row in scores[1:]:
            step = best[:, None] + self.pair
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        out = [int(best.argmax())]
        for pointers in reversed(back):
            out.append(int(pointers[out[-1]]))
        return out[::-1]

    def fit(self, sequences: list[tuple[list[list[int]], list[int]]], epochs: int = 120, rate: float = 0.1, l2: float = 1e-3) -> LinearChain:
        """Maximise the regularised likelihood of labelled sequences with Adam.

        All sequences are padded and go through forward-backward together.
        """
        n, m = len(sequences), max(len(t) for t, _ in sequences)
        labels, features = len(self.first), len(self.emit)
        dense = np.zeros((n, m, features))
        gold = np.zeros((n, m), int)
        real = np.zeros((n, m), bool)
        for k, (tokens, ys) in enumerate(sequences):
            for t, (active, y) in enumerate(zip(tokens, ys)):
                dense[k, t, active] = 1
                gold[k, t], real[k, t] = y, True
        target = np.eye(labels)[gold] * real[..., None]
        gold_pair = np.einsum("nti,ntj->ij", target[:, :-1], target[:, 1:])
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (self.emit, self.pair, self.first)]
        for step in range(1, epochs + 1):
            score = dense @ self.emit
            forward = np.zeros((n, m, labels))
            forward[:, 0] = self.first + score[:, 0]
            for t in range(1, m):
                moved = logsumexp(forward[:, t - 1][:, :, None] + self.pair, 1) + score[:, t]
                forward[:, t] = np.where(real[:, t, None], moved, forward[:, t - 1])
            backward = np.zeros((n, m, labels))
            for t in range(m - 2, -1, -1):
                moved = logsumexp(self.pair + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
                backward[:, t] = np.where(real[:, t + 1, None], moved, 0)
            total = logsumexp(forward[:, -1], 1)
            marginal = np.exp(forward + backward - total[:, None, None]) * real[..., None]
            both = forward[:, :-1, :, None] + self.pair + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
            expected = (np.exp(np.minimum(both, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
            slopes = (
                np.einsum("ntf,ntl->fl", dense, target - marginal) / n - l2 * self.emit,
                (gold_pair - expected) / n - l2 * self.pair,
                (target[:, 0] - marginal[:, 0]).mean(axis=0) - l2 * self.first,
            )
            for w, g, (a, b) in zip((self.emit, self.pair, self.first), slopes, moments):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self
