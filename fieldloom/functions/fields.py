"""Fields: functions of coordinate columns. Their algebra is that of Columns, so Catalyst is the expression template engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import TOLERANCE, Vec, col, total

Function = Callable[..., Column]


def opaque(f: Callable[..., object]) -> Function:
    """A Python function of arrays that can't be an expression, as one of columns: batches go to it through Arrow.

    ``f`` takes a numpy array for each coordinate and returns as many numbers; nulls come as NaN, and NaN is NaN.
    """

    def of(*x: Column) -> Column:
        def evaluate(*parts: pd.Series) -> pd.Series:
            values = f(*[p.to_numpy("float64") for p in parts])
            return pd.Series(np.broadcast_to(np.asarray(values, np.float64), len(parts[0])))

        evaluate.__annotations__ = {"parts": pd.Series, "return": pd.Series}
        return F.pandas_udf(evaluate, "double")(*x)

    return of


class ScalarField:
    """A function of n columns. Derivatives are central differences with step h, unless given."""

    def __init__(self, f: Function, n: int, h: float = 1e-3, gradient: Sequence[Function] | None = None, hessian: Sequence[Sequence[Function]] | None = None):
        self.f, self.n, self.h, self._gradient, self._hessian = f, n, h, gradient, hessian

    def __call__(self, *x: Column) -> Column:
        return col(self.f(*x))

    def _with(self, other: ScalarField | float, op: Callable[[Column, Column], Column]) -> ScalarField:
        if isinstance(other, ScalarField):
            return ScalarField(lambda *x: op(self(*x), other(*x)), self.n, self.h)
        return ScalarField(lambda *x: op(self(*x), F.lit(float(other))), self.n, self.h)

    def __add__(self, other: ScalarField | float) -> ScalarField:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other: ScalarField | float) -> ScalarField:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other: ScalarField | float) -> ScalarField:
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other: ScalarField | float) -> ScalarField:
        """Null where the divisor is zero."""
        return self._with(other, F.try_divide)

    def __radd__(self, other: float) -> ScalarField:
        return self + other

    def __rmul__(self, other: float) -> ScalarField:
        return self * other

    def __rsub__(self, other: float) -> ScalarField:
        return self._with(other, lambda a, b: b - a)

    def __rtruediv__(self, other: float) -> ScalarField:
        return self._with(other, lambda a, b: F.try_divide(b, a))

    def __neg__(self) -> ScalarField:
        return self.map(lambda v: -v)

    def map(self, g: Callable[[Column], Column]) -> ScalarField:
        """g after this field: sin, cos, tan, exp, log and the like."""
        return ScalarField(lambda *x: g(self(*x)), self.n, self.h)

    def _moved(self, x: Sequence[Column], *moves: tuple[int, float]) -> Column:
        y = list(x)
        for i, d in moves:
            y[i] = y[i] + d
        return self(*y)

    def gradient(self) -> VectorField:
        if self._gradient:
            return VectorField([ScalarField(g, self.n, self.h) for g in self._gradient])
        h = self.h
        part = lambda i: lambda *x: (self._moved(x, (i, h)) - self._moved(x, (i, -h))) / (2 * h)
        return VectorField([ScalarField(part(i), self.n, h) for i in range(self.n)])

    def hessian(self) -> MatrixField:
        """Five points for pure derivatives, four for mixed ones."""
        h = self.h

        def entry(i: int, j: int) -> Function:
            if self._hessian:
                return self._hessian[i][j]
            if i == j:
                return lambda *x: (-self._moved(x, (i, 2 * h)) + 16 * self._moved(x, (i, h)) - 30 * self(*x) + 16 * self._moved(x, (i, -h)) - self._moved(x, (i, -2 * h))) / (12 * h * h)
            return lambda *x: (self._moved(x, (i, h), (j, h)) - self._moved(x, (i, h), (j, -h)) - self._moved(x, (i, -h), (j, h)) + self._moved(x, (i, -h), (j, -h))) / (4 * h * h)

        return MatrixField([[ScalarField(entry(i, j), self.n, h) for j in range(self.n)] for i in range(self.n)])


def constant(c: float, n: int) -> ScalarField:
    return ScalarField(lambda *_: F.lit(float(c)), n)


class VectorField:
    """A list of scalar fields over the same columns."""

    def __init__(self, parts: Sequence[ScalarField]):
        self.parts = list(parts)

    def __getitem__(self, i: int) -> ScalarField:
        return self.parts[i]

    def __call__(self, *x: Column) -> Vec:
        return [p(*x) for p in self.parts]

    def __add__(self, other: VectorField | Sequence[float]) -> VectorField:
        return VectorField([a + b for a, b in zip(self.parts, getattr(other, "parts", other), strict=True)])

    def __sub__(self, other: VectorField | Sequence[float]) -> VectorField:
        return VectorField([a - b for a, b in zip(self.parts, getattr(other, "parts", other), strict=True)])

    def __mul__(self, s: ScalarField | float) -> VectorField:
        return VectorField([p * s for p in self.parts])

    __rmul__ = __mul__

    def __neg__(self) -> VectorField:
        return VectorField([-p for p in self.parts])

    def dot(self, other: VectorField | Sequence[float]) -> ScalarField:
        products = [a * b for a, b in zip(self.parts, getattr(other, "parts", other), strict=True)]
        return ScalarField(lambda *x: total([p(*x) for p in products]), self.parts[0].n)


class MatrixField:
    """Rows of scalar fields over the same columns."""

    def __init__(self, rows: Sequence[Sequence[ScalarField]]):
        self.rows = [list(r) for r in rows]

    def __getitem__(self, at: tuple[int, int]) -> ScalarField:
        return self.rows[at[0]][at[1]]

    def __call__(self, *x: Column) -> list[Vec]:
        return [[f(*x) for f in r] for r in self.rows]

    def row(self, i: int) -> VectorField:
        return VectorField(self.rows[i])

    def column(self, j: int) -> VectorField:
        return VectorField([r[j] for r in self.rows])

    def __add__(self, other: MatrixField) -> MatrixField:
        return MatrixField([[a + b for a, b in zip(r, s, strict=True)] for r, s in zip(self.rows, other.rows, strict=True)])

    def __sub__(self, other: MatrixField) -> MatrixField:
        return self + -other

    def __neg__(self) -> MatrixField:
        return MatrixField([[-f for f in r] for r in self.rows])

    def __mul__(self, s: ScalarField | float) -> MatrixField:
        return MatrixField([[f * s for f in r] for r in self.rows])

    __rmul__ = __mul__

    def __matmul__(self, other: MatrixField | VectorField | Sequence[float]) -> MatrixField | VectorField:
        if isinstance(other, MatrixField):
            return MatrixField([[self.row(i).dot(other.column(j)) for j in range(len(other.rows[0]))] for i in range(len(self.rows))])
        return VectorField([self.row(i).dot(other) for i in range(len(self.rows))])


def discretized(rows: DataFrame, data: DataFrame, key: str = "qnode_id") -> DataFrame:
    """Values of a field that is given per node: ``data`` joined to ``rows`` by the node's id."""
    return rows.join(data, key)


def log1pexp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow or loss of small values."""
    return F.when(x <= -37, F.exp(x)).when(x <= 18, F.log1p(F.exp(x))).when(x <= 33.3, x + F.exp(-x)).otherwise(x)


def almost_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal up to an absolute or relative difference."""
    d = F.abs(a - b)
    return (d < tolerance) | (d < F.greatest(F.abs(a), F.abs(b)) * tolerance)


def monomials(order: int, n: int) -> list[tuple[int, ...]]:
    """Exponents of all monomials of degree up to ``order``; the first variable varies fastest."""
    return [e[::-1] for e in product(range(order + 1), repeat=n) if sum(e) <= order]


def power(x: Column, k: int) -> Column:
    return F.lit(1.0) if k == 0 else x if k == 1 else x * power(x, k - 1)


def polynomial(coefficients: Sequence[float], order: int, n: int) -> ScalarField:
    """A polynomial of ``n`` variables with exact gradient."""
    terms = list(zip(coefficients, monomials(order, n), strict=True))

    def evaluated(ts: Sequence[tuple[float, tuple[int, ...]]]) -> Function:
        def f(*x: Column) -> Column:
            parts = []
            for c, e in ts:
                if c:
                    term = F.lit(float(c))
                    for v, k in zip(x, e, strict=True):
                        term = term * power(v, k) if k else term
                    parts.append(term)
            return total(parts) if parts else F.lit(0.0)

        return f

    gradient = [evaluated([(c * e[i], tuple(k - (j == i) for j, k in enumerate(e))) for c, e in terms if e[i]]) for i in range(n)]
    return ScalarField(evaluated(terms), n, gradient=gradient)


