"""Minimisation of objectives that Spark evaluates: sums over rows, at several points in one pass.

Defined cases: rows whose term is null add nothing to an objective, NaN makes it NaN and ends a descent; in a grid search null values are never the best one, and of equal ones the smallest row_id is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Objective:
    """The sum over the rows of ``df`` of ``loss(*parameters)``, an expression over its columns. Derivatives are differences.

    ``stop`` (parameters, gradient) is a stopping criterion of the objective's own, asked after each step.
    """

    df: DataFrame
    loss: Callable[..., Column]
    h: float = 1e-4
    passes: int = 0
    stop: Callable[[np.ndarray, np.ndarray], bool] | None = None

    def values(self, points: Sequence[Sequence[float]]) -> np.ndarray:
        """At all of ``points``, in one job."""
        self.passes += 1
        sums = [F.sum(self.loss(*[F.lit(float(v)) for v in p])).alias(f"f{i}") for i, p in enumerate(points)]
        return np.array(list(self.df.agg(*sums).first()), dtype=float)

    def __call__(self, x: Sequence[float]) -> float:
        return float(self.values([x])[0])

    def _moves(self, n: int) -> np.ndarray:
        return self.h * np.eye(n)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        moves = self._moves(len(x))
        f = self.values([*(x + m for m in moves), *(x - m for m in moves)])
        return (f[: len(x)] - f[len(x) :]) / (2 * self.h)

    def hessian(self, x: np.ndarray) -> np.ndarray:
        n, moves, points, at = len(x), self._moves(len(x)), [x], {}
        for i in range(n):
            for j in range(i, n):
                a, b = moves[i], moves[j]
                near = [x + 2 * a, x + a, x - a, x - 2 * a] if i == j else [x + a + b, x + a - b, x - a + b, x - a - b]
                at[i, j] = len(points)
                points += near
        f = self.values(points)
        out = np.zeros((n, n))
        for (i, j), k in at.items():
            if i == j:
                out[i, i] = (-f[k] + 16 * f[k + 1] - 30 * f[0] + 16 * f[k + 2] - f[k + 3]) / (12 * self.h**2)
            else:
                out[i, j] = out[j, i] = (f[k] - f[k + 1] - f[k + 2] + f[k + 3]) / (4 * self.h**2)
        return out


def grid_search(grid: DataFrame, f: Column, row: str = "row_id", callbacks: Sequence[object] = (), batch: int = 100_000) -> DataFrame:
    """The row of least ``f`` (column ``f``); of equal ones the first.

    With callbacks, rows are taken in batches by their dense ids; a ``post_update`` (best row so far, its ``f``) that returns True ends the search.
    """
    best_of = lambda df: df.withColumn("f", f).where("f IS NOT NULL").agg(F.min_by(F.struct(*grid.columns, "f"), F.struct("f", row)).alias("best")).select("best.*")
    if not callbacks:
        return best_of(grid)
    best, last = None, grid.agg(F.max(row)).first()[0]
    for first in range(0, (-1 if last is None else last) + 1, batch):
        found = best_of(grid.where(F.col(row).between(first, first + batch - 1))).first()
        if found is not None and found["f"] is not None and (best is None or found["f"] < best["f"]):
            best = found
        if best is not None and any(c.post_update(best, best["f"]) for c in callbacks):
            break
    schema = best_of(grid.limit(0)).schema
    return grid.sparkSession.createDataFrame([best] if best is not None else [], schema)


@dataclass
class Result:
    optimum: np.ndarray
    value: float
    n_iter: int


class Backtracking:
    """Shrinks the step while the decrease is short of a share of what the slope promises."""

    def __init__(self, alpha: float = 2.0, beta: float = 0.5, gamma: float = 0.5):
        self.alpha, self.beta, self.gamma = alpha, beta, gamma

    def __call__(self, f: Objective, x: np.ndarray, direction: np.ndarray, gradient: np.ndarray) -> float:
        slope = float(gradient @ direction)
        if slope >= 0:
            return self.alpha
        steps = self.alpha * self.beta ** np.arange(30)
        values = f.values([x, *(x + s * direction for s in steps)])  # all steps in one pass
        good = np.flatnonzero(values[0] - values[1:] + self.gamma * steps * slope >= 0)
        return float(steps[good[0]] if len(good) else steps[-1])


class Wolfe:
    """Bisection for the weak Wolfe conditions."""

    def __init__(self, alpha: float = 1.0, c1: float = 1e-4, c2: float = 0.9, most: int = 40):
        self.alpha, self.c1, self.c2, self.most = alpha, c1, c2, most

    def __call__(self, f: Objective, x: np.ndarray, direction: np.ndarray, gradient: np.ndarray) -> float:
        low, high, step = 0.0, np.inf, self.alpha
        now, slope = f(x), float(gradient @ direction)
        for _ in range(self.most):
            if f(x + step * direction) > now + self.c1 * step * slope:
                high = step
            elif float(f.gradient(x + step * direction) @ direction) < self.c2 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * low
        return step


@dataclass
class Descent:
    """Steps along a direction until the gradient is short; subclasses say which direction.

    Callbacks with ``pre_update`` or ``post_update`` may end the search by returning True.
    """

    most: int = 1000
    tolerance: float = 1e-6
    step: float = 0.01
    search: Callable[..., float] | None = None
    callbacks: Sequence[object] = field(default_factory=tuple)

    def direction(self, f: Objective, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def updated(self, dx: np.ndarray, dg: np.ndarray) -> None:
        """After each step."""

    def minimise(self, f: Objective, x0: Sequence[float]) -> Result:
        x, k = np.array(x0, dtype=float), 0
        g = f.gradient(x)
        asked = lambda name: any(getattr(c, name)(x, g) for c in self.callbacks if hasattr(c, name))  # noqa: B023, E731
        while k < self.most and np.linalg.norm(g) > self.tolerance and not asked("pre_update"):
            d = self.direction(f, x, g)
            new = x + (self.search(f, x, d, g) if self.search else self.step) * d
            after = f.gradient(new)
            self.updated(new - x, after - g)
            x, g, k = new, after, k + 1
            if asked("post_update") or (f.stop and f.stop(x, g)):
                break
        return Result(x, f(x), k)


class GradientDescent(Descent):
    def direction(self, f: Objective, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return -g


class Newton(Descent):
    def direction(self, f: Objective, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return -np.linalg.solve(f.hessian(x), g)


class BFGS(Descent):
    inverse: np.ndarray | None = None

    def direction(self, f: Objective, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.inverse is None:
            self.inverse = np.eye(len(x))
        return -self.inverse @ g

    def updated(self, dx: np.ndarray, dg: np.ndarray) -> None:
        s = float(dx @ dg)
        if s > 0:
            hy = self.inverse @ dg
            self.inverse = self.inverse + (1 + dg @ hy / s) * np.outer(dx, dx) / s - (np.outer(hy, dx) + np.outer(dx, hy)) / s
