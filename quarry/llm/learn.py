"""Linear models on sparse features, fitted on the driver to bounded samples."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: index and value of each entry, and where each row begins."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray] | None = None):
        self.size = np.array([len(x) for x in index], "i8")
        self.index = np.concatenate(index) if index else np.zeros(0, "i4")
        self.value = np.concatenate(value) if value else np.ones(len(self.index))
        self.row = np.repeat(np.arange(len(index), dtype="i4"), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.index], minlength=len(self.size)).astype(float)  # of no entries it counts in integers

    def back(self, r: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * r[self.row], minlength=dims).astype(float)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: Rows, y: np.ndarray, dims: int, weight: np.ndarray | None = None, l1: float = 0.0, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias: accelerated proximal gradient, y in [0, 1], the bias free of penalties."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    v = np.ones(dims)
    for _ in range(8):
        v = x.back(weight * x.dot(v), dims)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * np.linalg.norm(x.back(weight * x.dot(v), dims)) * 1.1 + 0.25 + l2)
    w, b, t = np.zeros(dims), 0.0, 1.0
    zw, zb = w, b
    for _ in range(steps):
        r = weight * (sigmoid(x.dot(zw) + zb) - y)
        nw = zw - rate * (x.back(r, dims) + l2 * zw)
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * l1)
        nb = zb - rate * r.sum()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        zw, zb = nw + (old - 1) / t * (nw - w), nb + (old - 1) / t * (nb - b)
        w, b = nw, nb
    return w, b


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties halved."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    pos = y == 1
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum()))
