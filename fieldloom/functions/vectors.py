"""Small vectors and matrices as lists of Columns; Catalyst folds and fuses what they build.

Defined cases: as for arithmetic of columns, a null component makes what depends on it null, and NaN makes it NaN; lengths that differ are an error when the expression is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]
Mat = list[Vec]

#: 10 and 50 machine epsilons: tolerances of point location and of comparisons.
EPSILON, TOLERANCE = 10 * 2.220446049250313e-16, 50 * 2.220446049250313e-16


def col(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def vec(*xs: Column | float | str) -> Vec:
    return [col(x) for x in xs]


def total(xs: Sequence[Column]) -> Column:
    return reduce(add, xs)


def plus(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def minus(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def times(s: Column | float, a: Vec) -> Vec:
    return [s * x for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def transpose(m: Mat) -> Mat:
    return [list(r) for r in zip(*m, strict=True)]


def apply(m: Mat, v: Vec) -> Vec:
    return [dot(r, v) for r in m]


def matmul(a: Mat, b: Mat) -> Mat:
    return [[dot(r, c) for c in transpose(b)] for r in a]


def determinant(m: Mat) -> Column:
    """Of a matrix of up to three rows."""
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return dot(m[0], cross(m[1], m[2]))


def inverse(m: Mat) -> Mat:
    """Of a square matrix of up to three rows, null where it is singular."""
    d = determinant(m)
    if len(m) == 1:
        return [[F.try_divide(F.lit(1.0), d)]]
    if len(m) == 2:
        adjugate = [[m[1][1], -m[0][1]], [-m[1][0], m[0][0]]]
    else:
        adjugate = transpose([cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])])
    return [[F.try_divide(x, d) for x in r] for r in adjugate]


def pseudo_inverse(m: Mat) -> Mat:
    """The inverse of a square matrix, else the left inverse by the normal equations."""
    if len(m) == len(m[0]):
        return inverse(m)
    t = transpose(m)
    return matmul(inverse(matmul(t, m)), t)


def orthogonal_project(v: Vec, u: Vec) -> Vec:
    """The part of ``v`` along ``u``."""
    return times(F.try_divide(dot(v, u), dot(u, u)), u)
