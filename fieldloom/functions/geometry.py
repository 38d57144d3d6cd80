"""Simplices and hyperplanes as expressions over coordinate columns: one row, one simplex.

Defined cases: a null coordinate gives null results, NaN gives NaN; a degenerate simplex has measure 0, and no finite barycentric coordinates or circumcenter.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import EPSILON, Mat, Vec, apply, cross, determinant, dot, inverse, minus, norm, plus, pseudo_inverse, times, total, transpose

OUTSIDE, INSIDE, ON_FACE, ON_VERTEX = 0, 1, 2, 3


class Simplex:
    """A simplex of order d (d + 1 vertices) in a space of up to three dimensions."""

    def __init__(self, vertices: list[Vec]):
        self.vertices, self.order, self.space = vertices, len(vertices) - 1, len(vertices[0])

    def jacobian(self) -> Mat:
        """Columns are the edges from the first vertex."""
        return transpose([minus(v, self.vertices[0]) for v in self.vertices[1:]])

    def inverse(self) -> Mat:
        """Of the jacobian: its left inverse on manifolds."""
        return pseudo_inverse(self.jacobian())

    def measure(self) -> Column:
        edges = transpose(self.jacobian()) if self.order else []
        if not edges:
            return F.lit(0.0)
        if self.order == self.space:
            return F.abs(determinant(edges)) / factorial(self.order)
        return norm(edges[0]) if self.order == 1 else norm(cross(*edges)) / 2

    def bounding_box(self) -> tuple[Vec, Vec]:
        axes = transpose(self.vertices)
        return [F.least(*a) for a in axes], [F.greatest(*a) for a in axes]

    def barycenter(self) -> Vec:
        return [total(a) / float(self.order + 1) for a in transpose(self.vertices)]

    def barycentric(self, p: Vec) -> Vec:
        z = apply(self.inverse(), minus(p, self.vertices[0]))
        return [1.0 - total(z), *z]

    def circumcenter(self) -> Vec:
        x0 = self.vertices[0]
        edges = transpose(self.jacobian())
        if self.order == 1:
            return times(0.5, plus(*self.vertices))
        if self.order < self.space:
            a, b = edges
            n = cross(a, b)
            top = plus(times(dot(b, b), cross(n, a)), times(dot(a, a), cross(b, n)))
            return plus(x0, [F.try_divide(t, 2 * dot(n, n)) for t in top])
        half = [dot(minus(v, x0), plus(v, x0)) / 2 for v in self.vertices[1:]]
        return apply(inverse(edges), half)

    def circumradius(self) -> Column:
        return norm(minus(self.circumcenter(), self.vertices[0]))

    def normal(self) -> Vec:
        """Of unit length, for a simplex of one dimension less than its space."""
        return Hyperplane.through(self.vertices).normal

    def contains(self, p: Vec) -> Column:
        """OUTSIDE, INSIDE, ON_FACE or ON_VERTEX, by the number of barycentric coordinates that aren't zero."""
        z = self.barycentric(p)
        active = total([F.when(F.abs(x) > EPSILON, 1).otherwise(0) for x in z])
        inside = F.when(active == 1, ON_VERTEX).when(active == self.order, ON_FACE).otherwise(INSIDE)
        off = F.least(*z, F.lit(1.0)) < -EPSILON
        if self.order < self.space:
            off = off | (Hyperplane.through(self.vertices).distance(p) > EPSILON)
        return F.when(off, OUTSIDE).otherwise(inside)

    def facets(self) -> list[Simplex]:
        """Facet k leaves out vertex order - k."""
        return [Simplex([self.vertices[i] for i in c]) for c in combinations(range(self.order + 1), self.order)]

    def nearest(self, p: Vec) -> Vec:
        """The point of the simplex that is nearest to ``p``."""
        found = self._nearest(p)
        return [found[f"x{i}"] for i in range(self.space)]

    def _candidate(self, p: Vec, x: Vec) -> Column:
        d = minus(p, x)
        return F.struct(dot(d, d).alias("d2"), *[c.alias(f"x{i}") for i, c in enumerate(x)])

    def _nearest(self, p: Vec) -> Column:
        x0 = self.vertices[0]
        if self.order == 0:
            return self._candidate(p, x0)
        if self.order == 1:
            e = minus(self.vertices[1], x0)
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(minus(p, x0), e), dot(e, e)), F.lit(0.0))))
            return self._candidate(p, plus(x0, times(t, e)))
        z = self.barycentric(p)
        on = plus(x0, apply(self.jacobian(), z[1:]))
        return F.when(F.least(*z) >= 0, self._candidate(p, on)).otherwise(F.least(*[f._nearest(p) for f in self.facets()]))


class Hyperplane:
    """An affine subspace: a point of it and an orthonormal basis; a normal where it has one dimension less than the space."""

    def __init__(self, point: Vec, basis: list[Vec]):
        self.point, self.basis = point, basis
        if len(basis) == len(point) - 1:
            n = [-basis[0][1], basis[0][0]] if len(point) == 2 else cross(*basis)
            self.normal = [F.try_divide(x, norm(n)) for x in n]

    @staticmethod
    def through(points: list[Vec]) -> Hyperplane:
        """Orthonormal by the modified Gram-Schmidt process."""
        basis: list[Vec] = []
        for p in points[1:]:
            e = minus(p, points[0])
            for b in basis:
                e = minus(e, times(dot(e, b), b))
            basis.append([F.try_divide(x, norm(e)) for x in e])
        return Hyperplane(points[0], basis)

    def coordinates(self, x: Vec) -> Vec:
        """Of the projection of ``x``, in the basis."""
        return [dot(b, minus(x, self.point)) for b in self.basis]

    def at(self, coordinates: Vec) -> Vec:
        out = self.point
        for c, b in zip(coordinates, self.basis, strict=True):
            out = plus(out, times(c, b))
        return out

    def project(self, x: Vec) -> Vec:
        return self.at(self.coordinates(x))

    def distance(self, x: Vec) -> Column:
        return norm(minus(x, self.project(x)))

    def offset(self) -> Column:
        """d of the equation normal . x + d = 0."""
        return -dot(self.normal, self.point)

    def evaluate(self, x: Vec) -> Column:
        """normal . x + d: the signed distance."""
        return dot(self.normal, x) + self.offset()
