"""Follow-the-regularised-leader (proximal) for sparse multinomial logistic regression."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of ``classes`` linear scores over ``width`` features, with elastic-net penalties (``l1``, ``l2``)."""

    def __init__(self, width: int, classes: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        """One example: features ``at`` (distinct) with values ``x``; ``target`` is a distribution over classes."""
        w = self.weights(at)
        g = np.outer(x, softmax(x @ w) - target)
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown

    def fit_sets(self, rows: list[np.ndarray], targets: np.ndarray, epochs: int) -> np.ndarray:
        """As ``fit`` for features that are present or not."""
        return self.fit(_Present(rows), targets, epochs)

    def fit(self, rows, targets: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
        order = np.arange(len(rows))
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order.tolist():
                at, x = rows[i]
                self.step(at, x, targets[i])
        return self.weights()


class _Present:
    """Rows of feature numbers as rows with values of one."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.rows[i].astype(np.int64)
        return at, np.ones(len(at))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of scores that makes the likelihood of ``truth`` (class numbers) greatest; golden-section search on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) < loss(b):
            high = b
        else:
            low = a
        a, b = high - ratio * (high - low), low + ratio * (high - low)
    return float(np.exp((low + high) / 2))
