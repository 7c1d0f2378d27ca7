"""A linear-chain conditional random field over few dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Emission weights (features x tags), transitions (tags x tags), and scores of the first and last tag."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def viterbi(self, x: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
        """Best tags of the rows of x; `before` and `after` fix the tags next to them."""
        e = x @ self.emit
        score = e[0] + (self.first if before is None else self.move[before])
        back = []
        for t in range(1, len(e)):
            s = score[:, None] + self.move
            back.append(s.argmax(axis=0))
            score = s.max(axis=0) + e[t]
        score = score + (self.last if after is None else self.move[:, after])
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray, tags: int, rounds: int = 150, l2: float = 0.05) -> Chain:
    """Maximise the penalised log-likelihood of padded sequences: x (n, t, f), y (n, t), mask (n, t).

    Gradients are expectations from the forward-backward recursion, all sequences
    at once; steps are Adam's.  The same input gives the same chain.
    """
    n, t, f = x.shape
    w = [np.zeros((f, tags)), np.zeros((tags, tags)), np.zeros(tags), np.zeros(tags)]
    m1, m2 = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    hot = np.eye(tags)[y] * mask[..., None]
    size = mask.sum(axis=1).astype(int)
    ends = np.arange(n), size - 1
    pair = mask[:, 1:, None, None]
    seen = [np.einsum("ntf,ntk->fk", x, hot), (hot[:, :-1, :, None] * hot[:, 1:, None, :] * pair).sum((0, 1)), hot[:, 0].sum(0), np.eye(tags)[y[ends]].sum(0)]
    for step in range(1, rounds + 1):
        e = x @ w[0]
        a, b = np.empty((n, t, tags)), np.empty((n, t, tags))
        a[:, 0] = e[:, 0] + w[2]
        for i in range(1, t):
            a[:, i] = np.where(mask[:, i, None] > 0, _logsumexp(a[:, i - 1, :, None] + w[1], 1) + e[:, i], a[:, i - 1])
        b[:, t - 1] = w[3]
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(mask[:, i + 1, None] > 0, _logsumexp(w[1] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), b[:, i + 1])
        z = _logsumexp(a[:, t - 1] + w[3], 1)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        q = np.exp(a[:, :-1, :, None] + w[1] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair
        want = [np.einsum("ntf,ntk->fk", x, p), q.sum((0, 1)), p[:, 0].sum(0), p[ends].sum(0)]
        for k in range(4):
            g = (seen[k] - want[k]) / n - l2 / n * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] = w[k] + 0.15 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-9)
    return Chain(*w)
