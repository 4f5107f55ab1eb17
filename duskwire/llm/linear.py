"""Small linear models, fitted on the driver on samples of stated size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept (unpenalised) last; damped Newton steps.

    With one class only, the model is the constant that the smoothed rate of it gives.
    """
    n, d = x.shape
    w = np.zeros(d + 1)
    c = np.ones(n) if weight is None else weight
    rate = (np.sum(c * y) + 0.5) / (np.sum(c) + 1)
    w[-1] = logit(np.array(rate))
    if n == 0 or y.min() == y.max():
        return w
    xs = np.hstack([x, np.ones((n, 1))])
    ridge = np.append(np.full(d, l2), 1e-6)

    def loss(v):
        z = xs @ v
        return np.sum(c * (np.logaddexp(0, z) - y * z)) + 0.5 * np.sum(ridge * v * v)

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(xs @ w)
        g = xs.T @ (c * (p - y)) + ridge * w
        h = (xs * (c * p * (1 - p))[:, None]).T @ xs + np.diag(ridge + 1e-9)
        step, t = np.linalg.solve(h, g), 1.0
        while (new := loss(w - t * step)) > now and t > 1e-4:
            t /= 2
        if new > now:
            break
        w, gain, now = w - t * step, now - new, new
        if gain < 1e-7 * max(1.0, abs(now)):
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


class Scaler:
    """Zero mean and unit deviation, clipped so that no outlying text leaves the range the model knows."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.dev = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(x.shape[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -6, 6)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Up to ``rows`` labelled documents: those whose ids have the smallest hashes.

    The ids are chosen first, from the labels alone, so no text moves to find them.
    A label is the rounded mean of an id's non-null labels; columns of ``docs`` called
    ``label`` or ``label_id`` give way.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    some = known.join(docs.select(F.col(id_col).alias("label_id")).distinct(), "label_id", "left_semi").orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    kept = docs.drop("label", "label_id")
    return kept.join(F.broadcast(some), kept[id_col] == some.label_id).drop("label_id")
