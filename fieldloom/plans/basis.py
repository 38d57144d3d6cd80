"""Lagrangian bases on meshes and B-splines on intervals: degrees of freedom, shape functions, evaluation matrices."""

from __future__ import annotations

from functools import cached_property
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import TOLERANCE, Mat, Vec, apply, transpose
from ..operators.coo import Coo
from ..operators.mesh import Mesh
from ..operators.spatial import located
from ..sources.shared import large
from .quadrature import quadrature_rows, rule


def shape_functions(z: Vec, order: int) -> Vec:
    """Values by the barycentric coordinates: vertices first, then (order 2) edges in the order of their vertex pairs."""
    if order == 1:
        return list(z)
    return [*(a * (2 * a - 1) for a in z), *(4 * z[i] * z[j] for i, j in combinations(range(len(z)), 2))]


def reference_gradients(z: Vec, order: int) -> Mat:
    """Gradients in reference coordinates, of which the first barycentric coordinate is one minus the sum."""
    d = len(z) - 1
    dz = [[-1.0] * d, *[[1.0 if k == i else 0.0 for k in range(d)] for i in range(d)]]
    if order == 1:
        return [[F.lit(v) for v in r] for r in dz]
    corner = [[(4 * a - 1) * F.lit(v) for v in r] for a, r in zip(z, dz, strict=True)]
    return corner + [[4 * (z[i] * dz[j][k] + z[j] * dz[i][k]) for k in range(d)] for i, j in combinations(range(len(z)), 2)]


class Lagrange:
    """Continuous piecewise polynomials of order 1 (one dof for each node) or 2 (and one for each edge) on a mesh."""

    def __init__(self, mesh: Mesh, order: int = 1):
        if order not in (1, 2):
            raise ValueError("orders 1 and 2")
        self.mesh, self.order = mesh, order
        d = mesh.order
        self.n_local = d + 1 if order == 1 else (d + 1) * (d + 2) // 2

    @cached_property
    def edges(self) -> DataFrame:
        """The edges of the mesh, numbered (and written) once."""
        return self.mesh.edges()

    def cell_dofs(self) -> DataFrame:
        """cell_id, local, dof_id."""
        vertices = self.mesh.cells.select("cell_id", F.posexplode(F.array(*self.mesh.vertices)).alias("local", "dof_id"))
        if self.order == 1:
            return vertices
        n = self.mesh.nodes.count()
        edges = self.mesh.cell_edges(self.edges).select("cell_id", (F.col("side") + self.mesh.order + 1).alias("local"), (F.col("edge_id") + n).alias("dof_id"))
        return large(vertices.unionByName(edges))

    def dofs(self) -> DataFrame:
        """dof_id, its coordinates and on_boundary."""
        axes, mesh = self.mesh.axes, self.mesh
        flags = mesh.boundary_nodes().withColumn("on_boundary", F.lit(True))
        nodes = mesh.nodes.join(flags, "node_id", "left").select(F.col("node_id").alias("dof_id"), *axes, F.coalesce("on_boundary", F.lit(False)).alias("on_boundary"))
        if self.order == 1:
            return nodes
        n, edges = mesh.nodes.count(), self.edges
        for end in ("n0", "n1"):
            edges = edges.join(mesh.nodes.select(F.col("node_id").alias(end), *[F.col(a).alias(f"{a}_{end}") for a in axes]), end)
        middle = [((F.col(f"{a}_n0") + F.col(f"{a}_n1")) / 2).alias(a) for a in axes]
        return nodes.unionByName(edges.select((F.col("edge_id") + n).alias("dof_id"), *middle, "on_boundary"))

    def n_dofs(self) -> int:
        return self.mesh.nodes.count() + (self.edges.count() if self.order == 2 else 0)

    def values(self, rows: DataFrame, z: Vec, name: str = "value") -> DataFrame:
        """``rows`` (with cell_id) once for each local dof, with local and its value at the barycentric coordinates ``z``."""
        parts = F.array(*shape_functions(z, self.order))
        return rows.select("*", F.posexplode(parts).alias("local", name))

    def evaluate(self, points: DataFrame, h: float) -> DataFrame:
        """Evaluation matrix (pid, dof_id, value): no entries for points outside, on shared sides the cell of ``spatial.located``."""
        z = [f"z{i}" for i in range(self.mesh.order + 1)]
        hits = located(points, self.mesh, h).select("pid", "cell_id", *z)
        values = self.values(hits, [F.col(n) for n in z])
        return values.join(self.cell_dofs(), ["cell_id", "local"]).select("pid", "dof_id", "value")

    def areal(self, regions: DataFrame) -> DataFrame:
        """(sub_id, dof_id, value): means of the basis functions over regions (sub_id, cell_id)."""
        q = quadrature_rows(self.mesh.geometry(), self.mesh, rule(self.mesh.order, self.order))
        x = [F.col(f"q{k}") for k in range(self.mesh.order)]
        z = [1.0 - sum(x[1:], x[0]), *x]
        local = self.values(q, z).groupBy("cell_id", "local").agg(F.sum(F.col("w") * F.col("measure") * F.col("value")).alias("integral"), F.first("measure").alias("measure"))
        parts = regions.join(local, "cell_id").join(self.cell_dofs(), ["cell_id", "local"])
        sums = parts.groupBy("sub_id", "dof_id").agg(F.sum("integral").alias("integral"))
        sizes = parts.where("local = 0").groupBy("sub_id").agg(F.sum("measure").alias("measure"))
        return sums.join(large(sizes), "sub_id").select("sub_id", "dof_id", (F.col("integral") / F.col("measure")).alias("value"))

    def expand(self, coefficients: DataFrame, points: DataFrame, h: float) -> DataFrame:
        """pid, value of the expansion with coefficients (dof_id, c); null outside."""
        inside = self.evaluate(points, h).join(coefficients, "dof_id").groupBy("pid").agg(F.sum(F.col("value") * F.col("c")).alias("value"))
        return points.select("pid").join(inside, "pid", "left")

    def physical_gradients(self, z: Vec) -> Mat:
        """Gradients of the shape functions in a row of mesh.geometry()."""
        back = transpose(self.mesh.simplex().inverse())
        return [apply(back, g) for g in reference_gradients(z, self.order)]


class Splines:
    """B-splines of an order on knots, the first and last of which are repeated ``order`` times."""

    def __init__(self, knots: list[float], order: int = 3):
        self.order = order
        self.knots = [*[float(knots[0])] * order, *map(float, knots), *[float(knots[-1])] * order]
        self.n = len(self.knots) - order - 1

    def value(self, i: int, x: Column, derivative: int = 0) -> Column:
        """The i-th spline, or a derivative of it, by the recursion over the knots."""
        return self._value(i, self.order, x, derivative)

    def _value(self, i: int, r: int, x: Column, k: int) -> Column:
        u = self.knots
        if r == 0:
            inside = (x >= u[i]) & (x < u[i + 1])
            if i == len(u) - self.order - 2:
                inside = inside | (F.abs(x - u[-1]) < TOLERANCE)
            return F.when(inside, 1.0).otherwise(0.0)
        a = 1 / (u[i + r] - u[i]) if u[i + r] > u[i] else 0.0
        b = 1 / (u[i + r + 1] - u[i + 1]) if u[i + r + 1] > u[i + 1] else 0.0
        parts = []
        if a:
            left = self._value(i, r - 1, x, max(k - 1, 0))
            parts.append((r * a) * left if k else (a * (x - u[i])) * left)
        if b:
            right = self._value(i + 1, r - 1, x, max(k - 1, 0))
            parts.append((-r * b) * right if k else (b * (u[i + r + 1] - x)) * right)
        return parts[0] + parts[1] if len(parts) > 1 else parts[0] if parts else F.lit(0.0)

    def dofs_coords(self) -> list[float]:
        """A place for each spline: the mean of its inner knots, so that these as coefficients give the identity."""
        r = self.order
        return [sum(self.knots[i + 1 : i + r + 1]) / r if r else self.knots[i] for i in range(self.n)]

    def pieces(self, derivative: int = 0) -> dict[int, list[list[float]]]:
        """For the knot k of each span that isn't empty, the ``order`` + 1 splines from k - order on as polynomials in x - knots[k], lowest power first."""
        u, r, out = self.knots, self.order, {}
        for k in range(r, len(u) - r - 1):
            if u[k + 1] <= u[k]:
                continue
            level = {k: np.array([1.0])}
            for d in range(1, r + 1):
                new = {}
                for i in range(k - d, k + 1):
                    total = np.zeros(d + 1)
                    for side, a, b in ((i, u[i], u[i + d]), (i + 1, u[i + d + 1], u[i + 1])):
                        if side in level and b != a:
                            # (x - a) / (b - a), or (a - x) / (a - b), with x counted from u[k]
                            total += np.convolve(level[side], np.array([u[k] - a, 1.0]) / (b - a))
                    new[i] = total
                level = new
            polynomials = [level[i] for i in range(k - r, k + 1)]
            for _ in range(derivative):
                polynomials = [c[1:] * np.arange(1, len(c)) if len(c) > 1 else np.zeros(1) for c in polynomials]
            out[k] = [c.tolist() for c in polynomials]
        return out

    def evaluate(self, points: DataFrame, derivative: int = 0, x: str = "x") -> DataFrame:
        """``points`` with dof_id, value, for the splines that aren't zero there.

        The knot span of a point comes first; then only its order + 1 polynomials are evaluated. Outside the knots, and for nulls and NaN, there are none.
        """
        spans = self.pieces(derivative)
        lasts, at = sorted(spans), F.col(x)
        knots = F.array(*[F.lit(self.knots[k]) for k in lasts])
        inside = (at >= self.knots[0]) & (at <= self.knots[-1])
        place = F.greatest(F.size(F.filter(knots, lambda k: k <= at)) - 1, F.lit(0))
        table = F.array(*[F.array(*[F.array(*[F.lit(c) for c in p]) for p in spans[k]]) for k in lasts])
        rows = points.where(inside).select("*", place.alias("_span")).select("*", (at - F.get(knots, F.col("_span"))).alias("_t"), F.get(table, F.col("_span")).alias("_p"), F.get(F.array(*[F.lit(k - self.order) for k in lasts]), F.col("_span")).alias("_first"))
        value = lambda p: F.aggregate(F.reverse(p), F.lit(0.0), lambda a, c: a * F.col("_t") + c)
        rows = rows.select(*points.columns, "_first", F.posexplode(F.transform("_p", value)).alias("_i", "value"))
        return rows.select(*points.columns, (F.col("_first") + F.col("_i")).cast("int").alias("dof_id"), "value").where("value <> 0")

    def expand(self, coefficients: DataFrame, points: DataFrame, key: str = "pid", x: str = "x") -> DataFrame:
        """key, value of the expansion with coefficients (dof_id, c)."""
        return self.evaluate(points, 0, x).join(coefficients, "dof_id").groupBy(key).agg(F.sum(F.col("value") * F.col("c")).alias("value"))


def as_matrix(values: DataFrame, row: str, n_rows: int, n_cols: int) -> Coo:
    """An evaluation (row, dof_id, value) as a matrix."""
    return Coo(values.select(F.col(row).cast("bigint").alias("row"), F.col("dof_id").cast("bigint").alias("col"), "value"), n_rows, n_cols)
