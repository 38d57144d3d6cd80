"""Differential operators as small sums of terms, and their assembly into sparse matrices by one join of cells and one aggregation of entries.

Defined cases: cells with a vertex that has no node are left out, null coordinates or coefficients add nothing, NaN stays NaN; unknowns without a cell have no entries; an empty mesh gives a matrix of zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec, dot
from ..operators.coo import Coo
from ..sources.shared import large
from .basis import Lagrange, Splines, shape_functions
from .quadrature import LEGENDRE, interval_rows, quadrature_rows, rule

Coefficient = float | Sequence | Callable[..., Column | Sequence]


@dataclass(frozen=True)
class Term:
    """kind: laplacian, diffusion, advection, reaction, bilaplacian or dt; parameter: a constant or a function of the coordinates.

    symmetric: whether its form is; None where that isn't known, as of a diffusion whose matrix is a function.
    """

    kind: str
    parameter: Coefficient | None = None
    factor: float = 1.0
    symmetric: bool | None = True


@dataclass(frozen=True)
class Operator:
    """A sum of terms; operators can be added, subtracted, negated and scaled."""

    terms: tuple[Term, ...]

    def __add__(self, other: Operator) -> Operator:
        return Operator(self.terms + other.terms)

    def __neg__(self) -> Operator:
        return -1.0 * self

    def __sub__(self, other: Operator) -> Operator:
        return self + -other

    def __rmul__(self, s: float) -> Operator:
        return Operator(tuple(replace(t, factor=t.factor * float(s)) for t in self.terms))

    @property
    def is_symmetric(self) -> bool:
        return all(t.symmetric for t in self.terms)

    @property
    def is_parabolic(self) -> bool:
        return any(t.kind == "dt" for t in self.terms)

    def without(self, kind: str) -> Operator:
        return Operator(tuple(t for t in self.terms if t.kind != kind))


def laplacian() -> Operator:
    return Operator((Term("laplacian"),))


def diffusion(k: Coefficient, symmetric: bool | None = None) -> Operator:
    """A matrix of numbers is compared with its transpose; of a function ``symmetric`` says that its values are."""
    if symmetric is None and not callable(k):
        numbers = all(isinstance(v, (int, float)) for r in k for v in r)
        symmetric = numbers and all(k[i][j] == k[j][i] for i in range(len(k)) for j in range(i))
    return Operator((Term("diffusion", k, symmetric=symmetric),))


def advection(b: Coefficient) -> Operator:
    return Operator((Term("advection", b, symmetric=False),))


def reaction(c: Coefficient) -> Operator:
    return Operator((Term("reaction", c),))


def bilaplacian() -> Operator:
    return Operator((Term("bilaplacian"),))


def dt() -> Operator:
    return Operator((Term("dt"),))


def _at(parameter: Coefficient, x: Vec) -> Column | Sequence:
    return parameter(*x) if callable(parameter) else parameter


def _column(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _form(term: Term, i: int, j: int, phi: Vec, grad: list[Vec], x: Vec) -> Column | None:
    """The integrand of a term for test function i and trial function j."""
    if term.kind == "laplacian":
        value = -dot(grad[i], grad[j])
    elif term.kind == "diffusion":
        k = _at(term.parameter, x)
        value = -dot(grad[i], [dot([_column(v) for v in r], grad[j]) for r in k])
    elif term.kind == "advection":
        value = phi[i] * dot([_column(v) for v in _at(term.parameter, x)], grad[j])
    elif term.kind == "reaction":
        value = _column(_at(term.parameter, x)) * phi[i] * phi[j]
    elif term.kind == "dt":
        return None
    else:
        raise ValueError(f"{term.kind} isn't for finite elements")
    return value * term.factor


def tabulated(basis: Lagrange, keep: Sequence[str] = ("cell_id",)) -> tuple[DataFrame, Vec, list[Vec], Vec]:
    """Rows of ``_quadrature`` (their columns ``keep``) with values and gradients of the shape functions as columns, so that every form reads them."""
    rows, z, x = _quadrature(basis)
    phi, grad = shape_functions(z, basis.order), basis.physical_gradients(z)
    n, axes = basis.n_local, basis.mesh.axes
    wide = rows.select(
        *keep, *axes, (F.col("w") * F.col("measure")).alias("wm"), *[phi[i].alias(f"phi{i}") for i in range(n)],
        *[grad[i][k].alias(f"g{i}_{k}") for i in range(n) for k in range(len(axes))],
    )
    return wide, [F.col(f"phi{i}") for i in range(n)], [[F.col(f"g{i}_{k}") for k in range(len(axes))] for i in range(n)], x


def _quadrature(basis: Lagrange) -> tuple[DataFrame, Vec, Vec]:
    """Rows for each cell and quadrature node, the barycentric and the physical coordinates of the node."""
    rows = quadrature_rows(basis.mesh.geometry(), basis.mesh, rule(basis.mesh.order, basis.order))
    q = [F.col(f"q{k}") for k in range(basis.mesh.order)]
    return rows, [1.0 - sum(q[1:], q[0]), *q], [F.col(a) for a in basis.mesh.axes]


def entries(operator: Operator, n: int, phi: Vec, grad: list[Vec], x: Vec) -> list[Column]:
    """Structs (i, j, v) of a row of ``tabulated``: what it adds to the local matrix of n x n entries, of symmetric operators to its lower triangle."""
    out = []
    for i in range(n):
        for j in range(i + 1 if operator.is_symmetric else n):
            forms = [f for t in operator.terms if (f := _form(t, i, j, phi, grad, x)) is not None]
            if forms:
                value = sum(forms[1:], forms[0]) * F.col("wm")
                out.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value.alias("v")))
    return out


def assemble(operator: Operator, basis: Lagrange) -> Coo:
    """The matrix of an operator: local matrices as expressions, one row for each cell, then one sum by (row, col). Symmetric operators compute and sum a triangle."""
    rows, phi, grad, x = tabulated(basis)
    n, n_local = basis.n_dofs(), basis.n_local
    places = [(i, j) for i in range(n_local) for j in range(i + 1 if operator.is_symmetric else n_local)]
    forms = entries(operator, n_local, phi, grad, x)
    if not forms:
        return Coo(rows.sparkSession.createDataFrame([], "row bigint, col bigint, value double"), n, n)
    # the entries of a cell stay one row until they have their place
    local = rows.groupBy("cell_id").agg(*[F.sum(e["v"]).alias(f"v{i}_{j}") for e, (i, j) in zip(forms, places, strict=True)])
    dofs = basis.cell_dofs().groupBy("cell_id").agg(*[F.max(F.when(F.col("local") == k, F.col("dof_id"))).alias(f"d{k}") for k in range(n_local)])
    placed = []
    for i, j in places:
        r, c, v = F.col(f"d{i}"), F.col(f"d{j}"), F.col(f"v{i}_{j}")
        if operator.is_symmetric and i != j:
            # both of (i, j) and (j, i), which are one place where the unknowns are the same
            r, c, v = F.greatest(r, c), F.least(r, c), F.when(r == c, 2 * v).otherwise(v)
        placed.append(F.struct(r.alias("row"), c.alias("col"), v.alias("v")))
    wide = large(local).join(large(dofs), "cell_id").select(F.explode(F.array(*placed)).alias("e")).where("e.row IS NOT NULL AND e.col IS NOT NULL")
    summed = wide.groupBy(F.col("e.row").alias("row"), F.col("e.col").alias("col")).agg(F.sum("e.v").alias("value"))
    if operator.is_symmetric:
        own, other = F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))
        summed = summed.select(F.explode(F.when(F.col("row") == F.col("col"), F.array(own)).otherwise(F.array(own, other))).alias("at"), "value").select("at.row", "at.col", "value")
    return Coo(summed, n, n)


def mass(basis: Lagrange) -> Coo:
    return assemble(reaction(1.0), basis)


def forcing(basis: Lagrange, f: Callable[..., Column] | str, data: DataFrame | None = None) -> DataFrame:
    """(idx, value): integrals of a field (or of the column ``f`` of ``data`` by qnode_id) times every basis function."""
    rows, z, x = _quadrature(basis)
    if data is not None:
        rows = rows.join(data, "qnode_id")
    value = F.col(f) if isinstance(f, str) else f(*x)
    parts = F.array(*[value * p * F.col("w") * F.col("measure") for p in shape_functions(z, basis.order)])
    local = rows.select("cell_id", F.posexplode(parts).alias("local", "v")).groupBy("cell_id", "local").agg(F.sum("v").alias("v"))
    return local.join(basis.cell_dofs(), ["cell_id", "local"]).groupBy(F.col("dof_id").alias("idx")).agg(F.sum("v").alias("value"))


def assemble_splines(operator: Operator, splines: Splines, spans: DataFrame) -> Coo:
    """The matrix of reactions and bilaplacians over knot spans (a, b): three Gauss nodes in each, splines that overlap only."""
    rows = interval_rows(spans, LEGENDRE[3])
    parts = []
    for t in operator.terms:
        if t.kind not in ("reaction", "bilaplacian"):
            raise ValueError(f"{t.kind} isn't for splines")
        d = 2 if t.kind == "bilaplacian" else 0
        sign = -t.factor if d else t.factor
        c = F.lit(1.0) if d else _column(_at(t.parameter, [F.col("x")]))
        active = F.filter(F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), splines.value(i, F.col("x"), d).alias("v")) for i in range(splines.n)]), lambda s: s["v"] != 0)
        at = rows.select((F.col("w") * c * sign).alias("w"), active.alias("s"))
        pairs = at.select("w", "s", F.explode("s").alias("p")).select("w", "p", F.explode("s").alias("q"))
        parts.append(pairs.select(F.col("p.i").alias("row"), F.col("q.i").alias("col"), (F.col("w") * F.col("p.v") * F.col("q.v")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Coo(out, splines.n, splines.n).summed()
