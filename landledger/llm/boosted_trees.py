"""Gradient-boosted regression trees for yes/no questions, in numpy, for a few thousand rows.

Newton boosting on the logistic loss with quantile-binned features and depth-wise trees; then a Platt
scaling of the scores on rows that were held out.  Deterministic: no sampling, ties go to the first feature.
"""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, LEAST_WEIGHT, RIDGE, BINS = 40, 3, 0.3, 5.0, 1.0, 32


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BoostedTrees:
    """``feature``, ``cut``, ``value``: a row for each tree, nodes in heap order; a node without a split has feature -1."""

    def __init__(self) -> None:
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> BoostedTrees:
        """Grow on ``x``, calibrate on ``held_x``."""
        self._grow(x, y)
        self._calibrate(self.raw(held_x), held_y)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        nodes = 2 ** (DEPTH + 1)
        self.feature, self.cut, self.value = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
        z = np.full(len(y), self.bias)
        for t in range(TREES):
            p = _sigmoid(z)
            grad, hess = y - p, p * (1 - p)
            at = np.ones(len(y), int)
            for node in range(1, nodes):
                here = np.flatnonzero(at == node)
                g, h = grad[here].sum(), hess[here].sum()
                self.value[t, node] = RATE * g / (h + RIDGE)
                if node >= nodes // 2 or h < 2 * LEAST_WEIGHT / 10 or not len(here):
                    continue
                best = (1e-6, -1, 0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[here, f]
                    gl = np.bincount(b, grad[here], len(c) + 1)[:-1].cumsum()
                    hl = np.bincount(b, hess[here], len(c) + 1)[:-1].cumsum()
                    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                    gain[(hl < LEAST_WEIGHT / 10) | (h - hl < LEAST_WEIGHT / 10)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    _, f, k = best
                    self.feature[t, node], self.cut[t, node] = f, cuts[f][k]
                    at[here] = 2 * node + (binned[here, f] > k)
            z += self._tree(t, x)

    def _tree(self, t: int, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), int)
        for _ in range(DEPTH):
            f = self.feature[t, at]
            go = f >= 0
            at[go] = 2 * at[go] + (x[go, f[go]] > self.cut[t, at[go]])
        return self.value[t, at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._tree(t, x) for t in range(TREES)), np.zeros(len(x)))

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt: Newton steps for scale and shift, with targets drawn in from 0 and 1."""
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        w = np.array([1.0, 0.0])
        a = np.stack([z, np.ones_like(z)], 1)
        for _ in range(30):
            p = _sigmoid(a @ w)
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(h, a.T @ (goal - p))
        self.scale, self.shift = max(float(w[0]), 1e-3), float(w[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.raw(x) + self.shift)
