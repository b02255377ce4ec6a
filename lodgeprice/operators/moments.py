"""Linear models from sufficient statistics: one pass over the rows serves every fold and every strength.

The pass sums, per fold, the products of all columns (label and a constant
included), shifted by rough means so that no digits are lost. A training part is
the total less its fold; scaling by population deviations, ridge in closed form,
lasso by coordinate descent on the products, and the error on the fold left out all
follow from these tables of (columns + 2) squared numbers, whatever the row count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Sums of products of ``[1, x - shift..., y - shift]`` over some rows."""

    shift: np.ndarray  # of the columns and, last, the label
    s: np.ndarray

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.shift, self.s - other.s)

    @property
    def n(self) -> float:
        return float(self.s[0, 0])


def fold_moments(rows: DataFrame, features: list[str], label: str, fold: Column | None = None) -> dict[int, Moments]:
    """The products of each fold's rows (all rows in fold 0 if there is none); rows with a null are left out."""
    cols = [*features, label]
    vectors = rows.where(" and ".join(f"`{c}` is not null" for c in cols)).select(
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    means = vectors.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(cols))]).first()
    shift = np.array([m or 0.0 for m in means])
    width = len(cols) + 1

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            fold_of = np.asarray(b.column(0))
            v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, width - 1) - shift
            v = np.hstack([np.ones((len(v), 1)), v])
            for f in np.unique(fold_of):
                part = v[fold_of == f]
                total[int(f)] = total.get(int(f), 0.0) + part.T @ part
        for f, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width * width, f), pa.int32()), pa.array(np.arange(width * width), pa.int32()),
                 pa.array(s.ravel(), pa.float64())], ["fold", "at", "value"])

    sums = vectors.mapInArrow(add, "fold int, at int, value double").groupBy("fold", "at").agg(F.sum("value").alias("value"))
    out: dict[int, Moments] = {}
    for r in sums.collect():  # folds x (columns + 2)^2 numbers
        m = out.setdefault(r["fold"], Moments(shift, np.zeros((width, width))))
        m.s.flat[r["at"]] = r["value"]
    return out


@dataclass
class Line:
    """A linear model in the columns' own units."""

    coef: np.ndarray
    intercept: float

    def error(self, m: Moments) -> float:
        """Root mean squared error over the rows of ``m``."""
        w = np.concatenate([[self.intercept + self.coef @ m.shift[:-1] - m.shift[-1]], self.coef, [-1.0]])
        return float(np.sqrt(max(w @ m.s @ w, 0.0) / m.n)) if m.n else float("nan")

    def column(self, features: list[str]) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(features, self.coef):
            if w:
                out = out + F.lit(float(w)) * F.col(c)
        return out


def _centred(m: Moments, scale: bool):
    """(mean, deviation, X'X, X'y) of centred and, if asked, scaled columns; a constant column has deviation 1."""
    mean = m.s[0, 1:] / m.n
    c = m.s[1:, 1:] - m.n * np.outer(mean, mean)
    var = np.diag(c)[:-1] / m.n
    size = np.abs(m.shift[:-1]) + np.sqrt(np.diag(m.s)[1:-1] / m.n)
    flat = var <= (1e-9 * size) ** 2
    dev = np.where(flat, 1.0, np.sqrt(np.maximum(var, 0))) if scale else np.ones(len(var))
    xx, xy = c[:-1, :-1] / np.outer(dev, dev), c[:-1, -1] / dev
    xx[flat, :], xx[:, flat], xy[flat] = 0.0, 0.0, 0.0
    return mean, dev, xx, xy


def _line(m: Moments, mean: np.ndarray, dev: np.ndarray, w: np.ndarray) -> Line:
    coef = w / dev
    return Line(coef, float(m.shift[-1] + mean[-1] - coef @ (m.shift[:-1] + mean[:-1])))


def ridge(m: Moments, alpha: float, scale: bool = True) -> Line:
    """min |y - Xw|^2 + alpha |w|^2 with a free intercept; ``alpha`` 0: least squares, of the least norm."""
    mean, dev, xx, xy = _centred(m, scale)
    if alpha:
        w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    else:
        w = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    return _line(m, mean, dev, w)


def lasso(m: Moments, alpha: float, scale: bool = True, max_iter: int = 10_000, tol: float = 1e-10) -> Line:
    """min |y - Xw|^2 / 2n + alpha |w|_1 by cyclic coordinate descent on the products."""
    mean, dev, xx, xy = _centred(m, scale)
    xx, xy = xx / m.n, xy / m.n
    w, grad = np.zeros(len(xy)), xy.copy()  # grad = X'(y - Xw) / n
    live = np.flatnonzero(np.diag(xx) > 0)
    for _ in range(max_iter):
        most = 0.0
        for j in live:
            pull = grad[j] + xx[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / xx[j, j]
            if new != w[j]:
                most = max(most, abs(new - w[j]))
                grad -= xx[:, j] * (new - w[j])
                w[j] = new
        if most <= tol * max(np.abs(w).max(initial=0), 1e-30):
            break
    return _line(m, mean, dev, w)


SOLVERS = {"ridge": ridge, "lasso": lasso}


def search(kind: str, by_fold: dict[int, Moments], alphas, scale: bool = True) -> tuple[Line, float, float]:
    """(line refitted on all rows, best alpha, its mean error over the folds); ties go to the first alpha."""
    total = Moments(next(iter(by_fold.values())).shift, sum(m.s for m in by_fold.values()))
    solve = SOLVERS[kind]
    score = {}
    for alpha in alphas:
        errors = [solve(total - m, alpha, scale).error(m) for m in by_fold.values() if m.n and (total - m).n]
        score[alpha] = float(np.mean(errors)) if errors else float("nan")
    best = min(alphas, key=lambda a: score[a])
    return solve(total, best, scale), best, score[best]
