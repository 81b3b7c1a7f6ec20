"""Binary classifiers in numpy, fitted and applied inside one task.

A model is a pickled dict. Trees are complete to their depth: a node without a useful split sends
every row to the left. Data are binned once a model, as many bins as Spark's trees use.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np

BINS, DEPTH, TREES, ROUNDS, STEP = 32, 5, 100, 20, 0.1
ITERATIONS = 100
HIDDEN, MLP_ITERATIONS = (64, 32), 50


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """At most ``BINS - 1`` cuts per feature: all values if they are few, else quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.arange(1, BINS + 1) / BINS, method="lower"))
        out.append(values[:-1])
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)


def _tree(binned: np.ndarray, y: np.ndarray, w: np.ndarray, subset: int, rng, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """Splits by the largest fall of the weighted variance (for 0/1 labels: of Gini impurity)."""
    n, f = binned.shape
    node, rows = np.zeros(n, np.int64), np.arange(n)
    feats, cuts = [], []
    ws, ys = np.repeat(w, f), np.repeat(w * y, f)
    column = np.arange(f) * BINS + binned
    for level in range(depth):
        k = 1 << level
        code = (node[:, None] * (f * BINS) + column).ravel()
        cw = np.bincount(code, ws, k * f * BINS).reshape(k, f, BINS).cumsum(2)
        cy = np.bincount(code, ys, k * f * BINS).reshape(k, f, BINS).cumsum(2)
        rest, other = cw[:, :, -1:] - cw, cy[:, :, -1:] - cy
        valid = (cw > 1e-9) & (rest > 1e-9)
        gain = cy**2 / np.where(valid, cw, 1) + other**2 / np.where(valid, rest, 1)
        gain -= cy[:, :, -1:] ** 2 / np.maximum(cw[:, :, -1:], 1e-9)
        gain = np.where(valid, gain, -np.inf)
        if subset < f:
            left_out = rng.random((k, f)).argsort(1)[:, subset:]
            gain[np.arange(k)[:, None], left_out] = -np.inf
        flat = gain.reshape(k, -1)
        best = flat.argmax(1)
        feat = best // BINS
        cut = np.where(flat[np.arange(k), best] > 1e-9, best % BINS, BINS)
        node = node * 2 + (binned[rows, feat[node]] > cut[node])
        feats.append(feat)
        cuts.append(cut)
    size = np.bincount(node, w, 1 << depth)
    leaf = np.bincount(node, w * y, 1 << depth) / np.maximum(size, 1e-9)
    return np.concatenate(feats).astype(np.int8), np.concatenate(cuts).astype(np.int8), leaf


def _walk(binned: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    feats, cuts, leaf = tree
    node, rows, first = np.zeros(len(binned), np.int64), np.arange(len(binned)), 0
    for level in range(len(leaf).bit_length() - 1):
        at = first + node
        node = node * 2 + (binned[rows, feats[at]] > cuts[at])
        first += 1 << level
    return leaf[node]


def _forest(x: np.ndarray, y: np.ndarray, bootstrap: bool, depth: int = DEPTH, trees: int = TREES) -> dict:
    rng, edges = np.random.default_rng(0), _edges(x)
    binned = _binned(x, edges)
    subset = int(np.ceil(np.sqrt(x.shape[1])))
    weights = (rng.poisson(1.0, len(y)).astype(float) if bootstrap else np.ones(len(y)) for _ in range(trees))
    return {"kind": "forest", "edges": edges, "trees": [_tree(binned, y, w, subset, rng, depth) for w in weights]}


def _boosted(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, rounds: int = ROUNDS, step: float = STEP) -> dict:
    """Gradient boosting of the log loss on labels -1 and 1; the first tree has the full step."""
    edges, sign, ones = _edges(x), 2 * y - 1, np.ones(len(y))
    binned = _binned(x, edges)
    trees, total, want = [], np.zeros(len(y)), sign
    for k in range(rounds):
        feats, cuts, leaf = _tree(binned, want, ones, x.shape[1], None, depth)
        trees.append((feats, cuts, leaf * (step if k else 1.0)))
        total += _walk(binned, trees[-1])
        want = 4 * sign / (1 + np.exp(np.clip(2 * sign * total, -500, 500)))
    return {"kind": "boosted", "edges": edges, "trees": trees}


def _least(value: Callable, start: np.ndarray, iterations: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with a backtracking line search; ``value`` gives the loss and its gradient."""
    x, pairs = start, []
    loss, grad = value(x)
    for _ in range(iterations):
        step, used = grad.copy(), []
        for s, t, r in reversed(pairs):
            a = r * (s @ step)
            step -= a * t
            used.append(a)
        if pairs:
            s, t, _r = pairs[-1]
            step *= (s @ t) / (t @ t)
        else:
            step /= max(1.0, np.linalg.norm(grad))
        for (s, t, r), a in zip(pairs, reversed(used)):
            step += s * (a - r * (t @ step))
        slope, rate = grad @ step, 1.0
        if slope <= 0:
            break
        for _ in range(20):
            new = x - rate * step
            new_loss, new_grad = value(new)
            if new_loss <= loss - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, t = new - x, new_grad - grad
        done = loss - new_loss <= 1e-6 * max(abs(loss), 1e-12)
        x, loss, grad = new, new_loss, new_grad
        if s @ t > 1e-12:
            pairs = [*pairs, (s, t, 1 / (s @ t))][-memory:]
        if done:
            break
    return x


def _scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = x.std(0)
    return x.mean(0), np.where(spread > 0, spread, 1.0)


def _svm(x: np.ndarray, y: np.ndarray) -> dict:
    """Linear hinge loss on standardised features, no penalty."""
    mean, spread = _scale(x)
    z, sign = np.column_stack([(x - mean) / spread, np.ones(len(y))]), 2 * y - 1

    def value(w):
        slack = 1 - sign * (z @ w)
        on = slack > 0
        return slack[on].sum() / len(y), -(sign[on] @ z[on]) / len(y)

    return {"kind": "svm", "mean": mean, "spread": spread, "w": _least(value, np.zeros(z.shape[1]), ITERATIONS)}


def _split(w: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(w[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def _layers(z: np.ndarray, ws: list[np.ndarray]) -> list[np.ndarray]:
    """Outputs of every layer; sigmoid inside, the last one is the logit."""
    out = [z]
    for k, w in enumerate(ws):
        v = out[-1] @ w[:-1] + w[-1]
        out.append(v if k == len(ws) - 1 else 1 / (1 + np.exp(-np.clip(v, -500, 500))))
    return out


def _mlp(x: np.ndarray, y: np.ndarray) -> dict:
    """Two hidden layers on standardised features and the log loss."""
    mean, spread = _scale(x)
    z, sizes = (x - mean) / spread, [x.shape[1], *HIDDEN, 1]
    rng = np.random.default_rng(0)
    start = np.concatenate([(rng.normal(0, 1 / np.sqrt(a), (a + 1, b))).ravel() for a, b in zip(sizes, sizes[1:])])

    def value(w):
        ws = _split(w, sizes)
        out = _layers(z, ws)
        logit = out[-1][:, 0]
        loss = (np.logaddexp(0, logit) - y * logit).mean()
        back = ((1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) / len(y))[:, None]
        grads = []
        for k in range(len(ws) - 1, -1, -1):
            grads.append(np.vstack([out[k].T @ back, back.sum(0)]).ravel())
            if k:
                back = back @ ws[k][:-1].T * out[k] * (1 - out[k])
        return loss, np.concatenate(grads[::-1])

    w = _least(value, start, MLP_ITERATIONS)
    return {"kind": "mlp", "mean": mean, "spread": spread, "w": w, "sizes": sizes}


FAMILIES: dict[str, Callable[..., dict]] = {  # parameters of a family are keyword arguments
    "random_forest": lambda x, y, **p: _forest(x, y, True, **p),
    "extra_trees": lambda x, y, **p: _forest(x, y, False, **p),
    "gradient_boosting": _boosted,
    "svm": _svm,
    "mlp": _mlp,
}


def fit(family: str, x: np.ndarray, y: np.ndarray, **parameters) -> bytes:
    """A model of 0/1 labels; without both classes it predicts the only one."""
    if not len(y) or y.min() == y.max():
        return pickle.dumps({"kind": "constant", "value": float(y[0]) if len(y) else 0.0})
    return pickle.dumps(FAMILIES[family](x, y, **parameters))


def score(model: bytes, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and 0/1 prediction of every row."""
    m = pickle.loads(model)
    kind = m["kind"]
    if kind == "constant":
        return np.full(len(x), m["value"]), np.full(len(x), m["value"])
    if kind in ("forest", "boosted"):
        binned = _binned(x, m["edges"])
        total = sum(_walk(binned, t) for t in m["trees"])
        s = total / len(m["trees"]) if kind == "forest" else 1 / (1 + np.exp(-2 * np.clip(total, -250, 250)))
        return s, (s > 0.5).astype(float)
    z = (x - m["mean"]) / m["spread"]
    if kind == "svm":
        s = z @ m["w"][:-1] + m["w"][-1]
        return s, (s > 0).astype(float)
    logit = _layers(z, _split(m["w"], m["sizes"]))[-1][:, 0]
    s = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return s, (s > 0.5).astype(float)
