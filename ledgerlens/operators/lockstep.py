"""Many penalised linear models fitted at once.

All trials and folds of a search see the same rows.  Each pass over the data
scores a batch of rows for all models with one matrix product and adds up their
losses and derivatives; the driver holds only those sums (models x features)
and takes a step for every model.  A grid of hundreds of fits so costs a few
dozen passes instead of hundreds of fits.

* ``logistic_grid``: elastic-net logistic regressions by proximal Newton steps.
* ``svm_grid``: linear support vector machines over kernel feature maps, by
  L-BFGS on the hinge loss rounded off within ``ROUND`` of its corner.
* ``svm_fit``: one such machine, by Newton steps on the hinge loss rounded off
  less and less.

A model learns from the rows outside its fold.  Rows: (fold, y 0/1, x array).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import sigmoid

ROUND = 0.1
FAN_IN = 64                     # partial sums that one task or the driver adds up


@dataclass(frozen=True)
class Model:
    """One fit: rows outside ``fold``; class weights balanced or none; the
    penalty strength C and the share of the absolute penalty."""

    fold: int
    balanced: bool
    C: float
    l1_ratio: float = 0.0
    kernel: int = 0             # which feature map


def matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``part(fold, y, x)``, an array of ``size`` doubles.

    A task adds up its batches; sums of many tasks are added in groups of
    ``FAN_IN`` before the last of them meet on the driver."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b.column("fold").to_numpy(), b.column("y").to_numpy(), matrix(b.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    sums, n = rows.mapInArrow(run, "s binary"), rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        sums = sums.repartition(n).mapInArrow(add, "s binary")
    return sum((np.frombuffer(r["s"]) for r in sums.collect()), np.zeros(size))


def class_counts(rows: DataFrame, k: int) -> np.ndarray:
    """Rows of each fold and class: k x 2."""
    out = np.zeros((k, 2))
    for r in rows.groupBy("fold", "y").count().collect():
        out[r["fold"], int(r["y"])] = r["count"]
    return out


def class_weights(models: list[Model], counts: np.ndarray) -> np.ndarray:
    """Weight of class 0 and 1 in each model, 2 x models."""
    total = counts.sum(0)
    out = np.ones((2, len(models)))
    for j, m in enumerate(models):
        n = total - counts[m.fold] if m.fold >= 0 else total
        if m.balanced:
            out[:, j] = n.sum() / (2 * np.maximum(n, 1))
    return out


def _weights(fold, y, folds, weights):
    """Row weights, rows x models: none inside a model's own fold."""
    return np.where(fold[:, None] == folds[None, :], 0.0, weights[y.astype(int)])


def _directions(g, h, beta, l1, sweeps=200):
    """Minimisers of g.d + d.h.d/2 + l1 |beta + d| by coordinate descent, all models at once."""
    d = np.zeros_like(beta)
    hd = np.zeros_like(beta)
    diagonal = np.einsum("jii->ji", h)
    for _ in range(sweeps):
        change = 0.0
        for i in range(beta.shape[1]):
            a, z = diagonal[:, i], beta[:, i] + d[:, i]
            c = z - (g[:, i] + hd[:, i]) / a
            new = np.sign(c) * np.maximum(np.abs(c) - l1[:, i] / a, 0.0)
            step = new - z
            d[:, i] += step
            hd += step[:, None] * h[:, i, :]
            change = max(change, float(np.abs(step * np.sqrt(a)).max()))
        if change < 1e-10:
            break
    return d


def logistic_grid(rows: DataFrame, models: list[Model], k: int, passes: int = 60, tol: float = 1e-10) -> np.ndarray:
    """Coefficients of every model, the intercept (not penalised) last: models x (features + 1).

    Model j minimises the weighted mean of the logistic loss plus
    (l1_ratio |b| + (1 - l1_ratio) / 2 |b|^2) / (C * sum of weights)."""
    d = len(rows.first()["x"])
    n = len(models)
    counts = class_counts(rows, k)
    weights = class_weights(models, counts)
    folds = np.array([m.fold for m in models])
    outside = np.array([counts.sum(0) - (counts[m.fold] if m.fold >= 0 else 0) for m in models])
    w_sum = (outside * weights.T).sum(1)
    strength = 1.0 / (np.array([m.C for m in models]) * w_sum)
    ratio = np.array([m.l1_ratio for m in models])
    on = np.append(np.ones(d), 0.0)                     # the intercept has no penalty
    l1, l2 = (strength * ratio)[:, None] * on, (strength * (1 - ratio))[:, None] * on
    pairs = np.triu_indices(d + 1)

    def sums(at):
        def part(fold, y, x):
            x1 = np.hstack([x, np.ones((len(x), 1))])
            m = x1 @ at.T
            w = _weights(fold, y, folds, weights)
            p = sigmoid(m)
            loss = (w * (np.logaddexp(0.0, m) - y[:, None] * m)).sum(0)
            gradient = (w * (p - y[:, None])).T @ x1
            hessian = (w * p * (1 - p)).T @ (x1[:, pairs[0]] * x1[:, pairs[1]])
            return np.concatenate([loss, gradient.ravel(), hessian.ravel()])

        s = summed(rows, part, n * (1 + d + 1 + len(pairs[0])))
        loss, gradient, flat = s[:n] / w_sum, s[n:n * (d + 2)].reshape(n, d + 1) / w_sum[:, None], s[n * (d + 2):].reshape(n, -1) / w_sum[:, None]
        h = np.zeros((n, d + 1, d + 1))
        h[:, pairs[0], pairs[1]] = flat
        h[:, pairs[1], pairs[0]] = flat
        return loss + (l1 * np.abs(at)).sum(1) + (l2 * at * at).sum(1) / 2, gradient + l2 * at, h + np.eye(d + 1) * (l2[:, None, :] + 1e-12)

    beta, best = np.zeros((n, d + 1)), np.full(n, np.inf)
    direction, step, slope = np.zeros_like(beta), np.ones(n), np.zeros(n)
    for _ in range(passes):
        at = beta + step[:, None] * direction
        value, g, h = sums(at)
        good = value <= best + 1e-4 * step * slope
        gain = np.where(good, best - value, np.inf)
        step = np.where(good, 1.0, step / 2)
        if good.any():
            beta[good], best[good] = at[good], value[good]
            new = _directions(g[good], h[good], beta[good], l1[good])
            direction[good] = new
            slope[good] = (g[good] * new).sum(1) + (l1[good] * (np.abs(beta[good] + new) - np.abs(beta[good]))).sum(1)
        if ((gain < tol) | (slope > -tol) | (step < 1e-6)).all():
            break
    return beta


def svm_grid(rows: DataFrame, models: list[Model], maps: list[Callable], k: int, passes: int = 120, history: int = 8) -> np.ndarray:
    """Coefficients over the models' feature maps, the intercept last: models x (map features + 1).

    Model j minimises the weighted mean of the hinge loss plus |b|^2 / (2 C n)
    over features scaled to unit deviation."""
    first = np.asarray([rows.first()["x"]], float)
    d, n = maps[0](first).shape[1], len(models)
    counts = class_counts(rows, k)
    weights = class_weights(models, counts)
    folds = np.array([m.fold for m in models])
    outside = np.array([counts.sum(0) - (counts[m.fold] if m.fold >= 0 else 0) for m in models])
    w_sum, n_rows = (outside * weights.T).sum(1), outside.sum(1)
    l2 = (1.0 / (np.array([m.C for m in models]) * n_rows))[:, None] * np.append(np.ones(d), 0.0)
    groups = [np.array([j for j, m in enumerate(models) if m.kernel == i], int) for i in range(len(maps))]

    def moments(fold, y, x):
        return np.concatenate([v for f in maps for z in [f(x)] for v in (z.sum(0), (z * z).sum(0))])

    total = counts.sum()
    s = summed(rows, moments, len(maps) * 2 * d).reshape(len(maps), 2, d) / total
    deviation = np.sqrt(np.maximum(s[:, 1] - s[:, 0] ** 2, 0.0))
    deviation[deviation == 0] = 1.0

    def sums(at):
        def part(fold, y, x):
            loss, gradient = np.zeros(n), np.zeros((n, d + 1))
            sign = 2 * y[:, None] - 1
            for f, mine, scale in zip(maps, groups, deviation):
                if len(mine):
                    z = np.hstack([f(x) / scale, np.ones((len(x), 1))])
                    short = 1 - sign * (z @ at[mine].T)
                    w = _weights(fold, y, folds[mine], weights[:, mine])
                    inside = np.clip((short + ROUND) / (2 * ROUND), 0.0, 1.0)          # the loss's slope
                    loss[mine] = (w * np.where(short > ROUND, short, inside * inside * ROUND)).sum(0)
                    gradient[mine] = (-w * sign * inside).T @ z
            return np.concatenate([loss, gradient.ravel()])

        s = summed(rows, part, n * (d + 2))
        return s[:n] / w_sum + (l2 * at * at).sum(1) / 2, s[n:].reshape(n, d + 1) / w_sum[:, None] + l2 * at

    beta = np.zeros((n, d + 1))
    best, g = sums(beta)
    pairs: list[tuple] = []
    step = np.ones(n)

    def descent(g):
        """Two-loop recursion for all models; a model without a curved pair goes down its gradient."""
        q, used = g.copy(), []
        for s_, y_, rho in reversed(pairs):
            a = rho * (s_ * q).sum(1)
            q -= a[:, None] * y_
            used.append(a)
        s_, y_, rho = pairs[-1] if pairs else (None, None, np.zeros(n))
        scale = np.where(rho > 0, 1 / np.maximum(rho * ((y_ * y_).sum(1) if pairs else 1.0), 1e-300), 1.0 / np.maximum(np.sqrt((g * g).sum(1)), 1.0))
        q *= scale[:, None]
        for (s_, y_, rho), a in zip(pairs, reversed(used)):
            q += (a - rho * (y_ * q).sum(1))[:, None] * s_
        down = (q * g).sum(1) > 0
        return -np.where(down[:, None], q, g)

    direction = descent(g)
    for _ in range(passes):
        at = beta + step[:, None] * direction
        value, g_new = sums(at)
        good = value <= best + 1e-4 * step * (g * direction).sum(1)
        moved = np.where(good[:, None], at - beta, 0.0)
        bent = np.where(good[:, None], g_new - g, 0.0)
        curved = (moved * bent).sum(1)
        if good.any():
            rho = np.where(curved > 1e-12, 1 / np.maximum(curved, 1e-300), 0.0)
            pairs = [*pairs, (moved, bent, rho)][-history:]
        done = np.where(good, best - value, np.inf) < 1e-7 * np.maximum(best, 1e-3)
        beta, best, g = np.where(good[:, None], at, beta), np.where(good, value, best), np.where(good[:, None], g_new, g)
        if (done | (step < 1e-6)).all():
            break
        fresh = descent(g)
        direction = np.where(good[:, None], fresh, direction)
        step = np.where(good, 1.0, step / 2)
    return np.hstack([beta[:, :d] / deviation[[m.kernel for m in models]], beta[:, d:]])


def feature_moments(rows: DataFrame, fmap: Callable[[np.ndarray], np.ndarray], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of the weights (of class 0 and 1) over all rows, and the deviation of every feature as
    ``Summarizer.std`` tells it."""
    d = fmap(np.zeros((1, len(rows.first()["x"])))).shape[1]

    def part(fold, y, x):
        z, w = fmap(x), weights[y.astype(int)]
        return np.concatenate([[w.sum(), (w * w).sum()], w @ z, w @ (z * z)])

    s = summed(rows, part, 2 + 2 * d)
    if not np.isfinite(s).all():
        raise ValueError("features must not be null, NaN or infinite")
    total, squares, mean = s[0], s[1], s[2:2 + d] / s[0]
    spread = np.maximum(s[2 + d:] / total - mean * mean, 0.0) * total / max(total - squares / total, 1e-300)
    return total, np.sqrt(spread)


def rounded_hinge(short: np.ndarray, r: float) -> np.ndarray:
    """The hinge loss max(0, short), a parabola within ``r`` of its corner."""
    inside = np.clip((short + r) / (2 * r), 0.0, 1.0)
    return np.where(short > r, short, inside * inside * r)


def svm_fit(rows: DataFrame, fmap: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, reg: float,
            rounds=(2.0, 0.5, 0.15, 0.03), steps: int = 12, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Coefficients over the features of ``fmap`` and the intercept of one support vector machine.

    It minimises the weighted mean of the hinge loss plus ``reg`` / 2 |b|^2 over
    features scaled to unit deviation, the objective of ``LinearSVC``.  One pass
    gives the gradient and the curvature, the next the loss at all lengths of the
    step.  The first rounding takes in the margin of zero, so every row bends the loss there.  Each pass makes the features anew, so only the rows' own columns are
    kept; the driver holds a square of the features."""
    w_sum, deviation = feature_moments(rows, fmap, weights)
    scale = np.where(deviation > 0, deviation, 1.0)
    d = len(scale)
    l2 = np.append(np.full(d, reg), 0.0)
    lengths = 2.0 ** np.arange(1, -13, -1)

    def features(x):
        return np.hstack([fmap(x) / scale, np.ones((len(x), 1))])

    def bend(at, r):
        def part(fold, y, x):
            z, sign, w = features(x), 2 * y - 1, weights[y.astype(int)]
            short = 1 - sign * (z @ at)
            slope = np.clip((short + r) / (2 * r), 0.0, 1.0)
            near = np.abs(short) <= r
            zn = z[near]
            return np.concatenate([-(w * sign * slope) @ z, (zn.T @ (zn * (w[near] / (2 * r))[:, None])).ravel()])

        s = summed(rows, part, (d + 1) * (d + 2)) / w_sum
        return s[:d + 1] + l2 * at, s[d + 1:].reshape(d + 1, d + 1) + np.diag(l2)

    def losses(at, way, r):
        def part(fold, y, x):
            sign, w = 2 * y - 1, weights[y.astype(int)]
            m = features(x) @ np.stack([at, way], 1)
            return np.array([w @ rounded_hinge(1 - sign * (m[:, 0] + t * m[:, 1]), r) for t in (0.0, *lengths)])

        points = at + np.append(0.0, lengths)[:, None] * way
        return summed(rows, part, len(lengths) + 1) / w_sum + (l2 * points * points).sum(1) / 2

    at, damp = np.zeros(d + 1), 1e-6
    for r in rounds:
        for _ in range(steps):
            g, h = bend(at, r)
            way = -np.linalg.solve(h + damp * max(np.trace(h) / (d + 1), 1e-9) * np.eye(d + 1), g)
            value = losses(at, way, r)
            best = int(value[1:].argmin())
            gain = value[0] - value[best + 1]
            if gain > 0:
                at = at + lengths[best] * way
            damp = min(damp * 10, 1e3) if lengths[best] < 0.25 or gain <= 0 else max(damp / 10, 1e-9)
            if 0 <= gain < tol * max(value[0], 1e-3) and (lengths[best] >= 0.25 or damp >= 1e3):
                break
    return at[:d] / scale, float(at[d])


def fold_f1(rows: DataFrame, models: list[Model], margin: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """F1 of class 1 of every model on the rows of its fold; ``margin(x)``: rows x
    models, above 0 for class 1.  One pass for all models."""
    n, folds = len(models), np.array([m.fold for m in models])

    def part(fold, y, x):
        flagged = margin(x) > 0
        mine, true = fold[:, None] == folds[None, :], y[:, None] == 1
        return np.concatenate([(flagged & true & mine).sum(0), ((flagged != true) & mine).sum(0)]).astype(float)

    hit, off = summed(rows, part, 2 * n).reshape(2, n)
    return np.where(hit > 0, np.round(2 * hit / np.maximum(2 * hit + off, 1), 4), 0.0)


def fold_rows(folded: DataFrame, cols, label: str, fold_col: str = "fold") -> DataFrame:
    """(fold, y, x) of a table."""
    return folded.select(F.col(fold_col).cast("long").alias("fold"), F.col(label).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
