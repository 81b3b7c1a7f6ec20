"""Scale and shift that turn the logits of a two-class model into probabilities."""

from __future__ import annotations

import numpy as np

RIDGE = 1e-2  # pull of the scale towards 1, per standard deviation of the logits


def _loss(x: np.ndarray, goal: np.ndarray, w: np.ndarray, n: np.ndarray) -> float:
    t = x @ w
    return float(((np.logaddexp(0, t) - goal * t) * n).sum() + RIDGE * (w[0] - 1) ** 2 / 2)


def platt(z: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and shift that make ``sigmoid(a*z+b)`` a probability.

    Newton steps on a penalised likelihood of standardised logits, each halved until the loss
    falls, so that they converge on separated labels, too. The scale stays positive: scores keep
    the order of the logits. An entry stands for ``times`` rows, or for one.
    """
    n = np.ones(len(z)) if times is None else times.astype(float)
    mean = float(np.average(z, weights=n))
    spread = float(np.sqrt(np.average((z - mean) ** 2, weights=n))) or 1.0
    ones = float((y * n).sum())
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (float(n.sum()) - ones + 2))
    x = np.stack([(z - mean) / spread, np.ones_like(z)], 1)
    rate = float(np.average(goal, weights=n))
    w = np.array([0.0, np.log(rate / (1 - rate))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ ((p - goal) * n) + [RIDGE * (w[0] - 1), 0]
        hess = (x * (p * (1 - p) * n)[:, None]).T @ x + np.diag([RIDGE, 1e-9])
        step, now, size = np.linalg.solve(hess, grad), _loss(x, goal, w, n), 1.0
        while size > 1e-6 and _loss(x, goal, w - size * step, n) > now:
            size /= 2
        w = w - size * step
        if size <= 1e-6 or np.abs(step).max() < 1e-9:
            break
    a = max(float(w[0]), 0.05)
    return a / spread, float(w[1]) - a * mean / spread
