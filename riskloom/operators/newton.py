"""Logistic regression by Newton steps on grouped sums.

A step is one pass: every task adds up the gradient, the weighted Gram matrix
and the objective of its rows ((k + 1)^2 + k + 2 numbers, whatever the rows),
Spark sums them, and the driver solves one k + 1 by k + 1 system.  The penalty
is ``l2 / 2 * |coefficients|^2`` on standardised features, the intercept is
free.  A step that would raise the objective is halved, so every start
converges; the loss is convex and has one minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.boost import matrix


@dataclass
class Standardised:
    mean: np.ndarray
    scale: np.ndarray  # population deviation; 0 for a constant feature

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Standardised features after a leading 1; missing and constant ones are 0."""
        z = np.divide(x - self.mean, self.scale, out=np.zeros_like(x), where=self.scale > 0)
        return np.concatenate([np.ones((len(x), 1)), np.nan_to_num(z, nan=0.0)], 1)


@dataclass
class LogisticModel:
    standardised: Standardised
    weights: np.ndarray  # the intercept first
    steps: int
    gradient: float      # its largest component at the end

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.standardised(x) @ self.weights)))


def standardise(train: DataFrame, n_features: int) -> Standardised:
    """Mean and population deviation per feature of ``x``, one aggregate."""
    def value(i):
        v = F.col("x")[i]
        return F.when(~F.isnan(v), v)
    row = train.agg(*[F.avg(value(i)).alias(f"m{i}") for i in range(n_features)],
                    *[F.stddev_pop(value(i)).alias(f"s{i}") for i in range(n_features)]).first()
    return Standardised(*(np.array([row[f"{c}{i}"] or 0.0 for i in range(n_features)]) for c in "ms"))


def sums_at(train: DataFrame, standardised: Standardised, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Gradient, Hessian, loss and total weight of the unpenalised loss at ``weights``: one job."""
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = standardised(matrix(batch.column("x"), k - 1))
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            m = z @ weights
            p = 1.0 / (1.0 + np.exp(-m))
            loss = (w * (np.logaddexp(0.0, m) - y * m)).sum()
            total += np.concatenate([z.T @ (w * (p - y)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel(), [loss, w.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["s"])

    parts = train.select("x", "y", "w").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    total = np.zeros(k + k * k + 2)
    for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r["i"]] = r["s"]
    return total[:k], total[k:-2].reshape(k, k), float(total[-2]), float(total[-1])


def fit(train: DataFrame, n_features: int, l2: float = 1.0, max_steps: int = 1000, tolerance: float = 1e-12) -> LogisticModel:
    """Weights for ``train``: y (0 or 1), w (weight) and x (array of doubles).

    Ends when no component of the gradient exceeds ``tolerance`` times the
    total weight, when halving no longer helps, or after ``max_steps``."""
    standardised = standardise(train, n_features)
    weights = np.zeros(n_features + 1)
    free = np.r_[0.0, np.full(n_features, l2)]  # the intercept carries no penalty

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        g, h, loss, total = sums_at(train, standardised, w)
        return g + free * w, h + np.diag(free), loss + 0.5 * (free * w * w).sum(), total

    g, h, loss, total = at(weights)
    steps = 0
    while steps < max_steps and np.abs(g).max() > tolerance * max(total, 1.0):
        step, share = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        while True:
            steps += 1
            new = weights - share * step
            g_new, h_new, loss_new, _ = at(new)
            if loss_new <= loss + 1e-12 * abs(loss) or steps >= max_steps or share < 1e-6:
                break
            share /= 2
        if loss_new > loss + 1e-12 * abs(loss) or np.abs(g_new).max() >= np.abs(g).max() and loss_new >= loss:
            break  # rounding: no step improves the sums any more
        weights, g, h, loss = new, g_new, h_new, loss_new
    return LogisticModel(standardised, weights, steps, float(np.abs(g).max()))
