"""Linear systems in coordinate form, boundary conditions, elliptic and parabolic problems."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators.coo import Coo
from ..operators.mesh import Mesh
from ..sources.shared import large, remove, scratch, written
from .assembly import Operator, assemble, forcing, mass
from .basis import Lagrange
from .factor import Factors, FrontTooLarge, factorise

#: Columns of a low-rank update; the inner system of that size is solved with numpy.
MOST_COLUMNS = 1024


class NotConverged(RuntimeError):
    """An iteration ended before its residual was small enough."""


def _filled(b: DataFrame, n: int) -> DataFrame:
    grid = b.sparkSession.range(n).withColumnRenamed("id", "idx")
    return grid.join(large(b).groupBy("idx").agg(F.sum("value").alias("value")), "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))


class _Vectors:
    """Vectors of one length as columns of a table that every step of an iteration writes anew; sums come with the writing."""

    def __init__(self, a: Coo, start: DataFrame, paths: list[str]):
        self.spark, self.paths = start.sparkSession, paths
        n = F.abs(F.when(F.col("row") == F.col("col"), F.col("value")).otherwise(0.0))
        # rows without a diagonal entry are left as they are
        scale = large(a.df).groupBy(F.col("row").alias("idx")).agg(F.sum(n).alias("d")).select("idx", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0).alias("m"))
        self.a = Coo(written(a.df, "matrix"), a.n_rows, a.n_cols)
        self.kept = 1
        self.table = start.join(scale, "idx", "left").withColumn("m", F.coalesce("m", F.lit(1.0)))

    def step(self, columns: dict[str, Column], sums: dict[str, Column], *products: tuple[str, str] | tuple[str, str, Coo]) -> dict[str, float]:
        """Adds ``columns``, and after them with each of ``products`` (x, y) the column y = A x, or of (x, y, m) y = m x; gives ``sums`` over the new table."""
        table = self.table.withColumns(columns)
        for x, y, *by in products:
            table = table.drop(y).join((by[0] if by else self.a).times_vector(table.select("idx", F.col(x).alias("value"))).withColumnRenamed("value", y), "idx", "left").withColumn(y, F.coalesce(y, F.lit(0.0)))
        seen = Observation()
        self.table = written(table.observe(seen, *[F.sum(c).alias(n) for n, c in sums.items()]), "vectors")
        while len(self.paths) > self.kept + 2:
            remove(self.spark, self.paths.pop(self.kept))
        return {n: v or 0.0 for n, v in seen.get.items()}


def _dot(x: str, y: str) -> Column:
    return F.col(x) * F.col(y)


def solve(a: Coo, b: DataFrame, symmetric: bool = True, tolerance: float = 1e-11, most: int = 10_000, low: Coo | None = None) -> DataFrame:
    """(idx, value) with a x = b: conjugate gradients, or where ``a`` isn't symmetric and positive, stabilised biconjugate gradients, scaled by the diagonal.

    A product is one join and one sum; a step writes one table, and its sums reach the driver with the writing. The residual falls to
    ``tolerance`` times that of zero; if it doesn't within ``most`` steps, ``NotConverged`` is raised. Entries of ``b`` of one index add up.

    With ``low``, a written L of an approximate inverse L Lt (``sparse_inverse``), conjugate gradients take it in place of the diagonal: fewer steps, of two tables each.
    """
    if a.n_rows != a.n_cols:
        raise ValueError("a square matrix is needed")
    with scratch(b.sparkSession, keep=1) as paths:
        start = _filled(b, a.n_rows).select("idx", F.lit(0.0).alias("x"), F.col("value").alias("r"))
        state = _Vectors(a, start, paths)
        if low:
            if not symmetric:
                raise ValueError("an approximate inverse L Lt is for symmetric matrices")
            _preconditioned(state, low, tolerance, most)
        else:
            (_conjugate if symmetric else _stabilised)(state, tolerance, most)
        return written(state.table.select("idx", F.col("x").alias("value")), "solution")


def _conjugate(v: _Vectors, tolerance: float, most: int) -> None:
    """One table for each step: the sums of a step give the next residual's, the true one follows with the next table."""
    z, rr, goal = F.col("r") * F.col("m"), 0.0, None
    sums = {"rr": _dot("r", "r"), "rz": F.col("r") * z, "pq": _dot("p", "q"), "zq": z * F.col("q"), "qq": F.col("q") * F.col("q") * F.col("m")}
    columns = {"p": z}
    for _ in range(most + 1):
        s = v.step(columns, sums, ("p", "q"))
        rr, goal = s["rr"], s["rr"] * tolerance**2 if goal is None else goal
        if rr <= goal:
            return
        if not s["pq"]:
            break
        alpha = s["rz"] / s["pq"]
        beta = max(s["rz"] - 2 * alpha * s["zq"] + alpha * alpha * s["qq"], 0.0) / s["rz"]
        r = F.col("r") - alpha * F.col("q")
        columns = {"x": F.col("x") + alpha * F.col("p"), "r": r, "p": r * F.col("m") + beta * F.col("p")}
    raise NotConverged(f"residual {rr ** 0.5:g} after {most} steps")


def _preconditioned(v: _Vectors, low: Coo, tolerance: float, most: int) -> None:
    """Two tables for each step: the direction and its product, then the residual and what the approximate inverse makes of it."""
    sums, apply = {"rr": _dot("r", "r"), "rz": _dot("r", "z")}, (("r", "t", low.transpose()), ("t", "z", low))
    s = v.step({}, sums, *apply)
    goal, p = s["rr"] * tolerance**2, F.col("z")
    for _ in range(most):
        if s["rr"] <= goal:
            return
        pq = v.step({"p": p}, {"pq": _dot("p", "q")}, ("p", "q"))["pq"]
        if not pq or not s["rz"]:
            break
        alpha, rz = s["rz"] / pq, s["rz"]
        s = v.step({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("q")}, sums, *apply)
        p = F.col("z") + s["rz"] / rz * F.col("p")
    if s["rr"] > goal:
        raise NotConverged(f"residual {s['rr'] ** 0.5:g} after {most} steps")


def _stabilised(v: _Vectors, tolerance: float, most: int) -> None:
    """Two tables for each step, one for each product."""
    rr = rho = v.step({"s0": F.col("r"), "p": F.col("r")}, {"rr": _dot("r", "r")})["rr"]
    goal, columns = rr * tolerance**2, {"y": F.col("p") * F.col("m")}
    for _ in range(most):
        if rr <= goal:
            return
        sq = v.step(columns, {"sq": _dot("s0", "q")}, ("y", "q"))["sq"]
        if not sq or not rho:
            break
        alpha = rho / sq
        half = F.col("r") - alpha * F.col("q")
        s = v.step({"h": half, "w": half * F.col("m")}, {n: _dot(*n) for n in ("tt", "th", "hh")} | {"sh": _dot("s0", "h"), "st": _dot("s0", "t")}, ("w", "t"))
        omega = s["th"] / s["tt"] if s["tt"] else 0.0
        rr = max(s["hh"] - 2 * omega * s["th"] + omega * omega * s["tt"], 0.0)
        r, x = F.col("h") - omega * F.col("t"), F.col("x") + alpha * F.col("y") + omega * F.col("w")
        if rr <= goal:
            # the sums foretell the residual; the table says whether it's true
            rr = v.step({"x": x, "r": r}, {"rr": _dot("r", "r")})["rr"]
            if rr <= 4 * goal:
                return
            x, r = F.col("x"), F.col("r")
        if not omega:
            break
        beta, rho = (s["sh"] - omega * s["st"]) / rho * alpha / omega, s["sh"] - omega * s["st"]
        p = r + beta * (F.col("p") - omega * F.col("q"))
        columns = {"x": x, "r": r, "p": p, "y": p * F.col("m")}
    raise NotConverged(f"residual {rr ** 0.5:g} after {most} steps")


def fixed_rows(a: Coo, rows: DataFrame) -> Coo:
    """``a`` with the rows and columns of ``rows`` (row) as those of the identity: whatever the values there, the same matrix."""
    rows = large(rows).distinct()
    inner = large(a.df).join(rows, "row", "left_anti").join(rows.withColumnRenamed("row", "col"), "col", "left_anti").select("row", "col", "value")
    return Coo(inner.unionByName(rows.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))), a.n_rows, a.n_cols)


def fixed_right(a: Coo, b: DataFrame, fixed: DataFrame) -> DataFrame:
    """The right side of ``fixed_rows``: values of ``fixed`` (idx, value) in their rows, and what they add to the others."""
    known = a.times_vector(fixed).withColumn("value", -F.col("value"))
    return b.unionByName(known).groupBy("idx").agg(F.sum("value").alias("value")).join(large(fixed).select("idx"), "idx", "left_anti").unionByName(fixed.select("idx", "value"))


def dirichlet(a: Coo, b: DataFrame, fixed: DataFrame) -> tuple[Coo, DataFrame]:
    """The system in which the unknowns of ``fixed`` (idx, value) have these values; a symmetric matrix stays symmetric.

    Known values move to the right side; their rows and columns become those of the identity.
    """
    return fixed_rows(a, fixed.select(F.col("idx").alias("row"))), fixed_right(a, b, fixed)


def woodbury(solve_a: Factors | Callable[[DataFrame], DataFrame], u: Coo, inverse_c: np.ndarray, v: Coo, b: DataFrame) -> DataFrame:
    """(idx, value) of (A + U C V) x = b, by solutions with A; U has few columns, so the inner system is of their number.

    With ``Factors`` of A the right side and all columns of U are solved at once; a function solves one right side (idx, value) after the other.
    """
    q = u.n_cols
    if q > MOST_COLUMNS:
        raise ValueError(f"at most {MOST_COLUMNS} columns")
    right = b.select("idx", F.lit(q).cast("bigint").alias("col"), "value").unionByName(u.df.select(F.col("row").alias("idx"), "col", "value"))
    if isinstance(solve_a, Factors):
        ys = solve_a.solve(right)
    else:
        one = lambda j: solve_a(right.where(F.col("col") == j).select("idx", "value")).select("idx", F.lit(j).cast("bigint").alias("col"), "value")
        ys = written(reduce(DataFrame.unionByName, [one(j) for j in range(q + 1)]), "solutions")
    met = v.df.join(ys.select(F.col("idx").alias("col"), F.col("col").alias("side"), F.col("value").alias("y")), "col")
    small = np.zeros((v.n_rows, q + 1))
    for r in met.groupBy("row", "side").agg(F.sum(F.col("value") * F.col("y")).alias("s")).collect():  # as many as V has rows, of which there are q, by q + 1
        small[r.row, r.side] = r.s
    t = np.linalg.solve(inverse_c + small[:, :q], small[:, q])
    weight = F.try_element_at(F.array(*[F.lit(x) for x in [*(-t).tolist(), 1.0]]), (F.col("col") + 1).cast("int"))
    return ys.groupBy("idx").agg(F.sum(F.col("value") * weight).alias("value"))


def sparse_inverse(a: Coo, alpha: int = 2, beta: int = 4, epsilon: float = 1e-3) -> Coo:
    """L of an approximate inverse L Lt of a symmetric positive matrix, whose pattern grows in ``alpha`` rounds, for all columns at once.

    In a round the residual A L of all columns is one join and one sum; below a column's diagonal, beside its new entries, those rows whose residual would
    fall by more than ``epsilon`` and more than the mean come to its pattern, ``beta`` of them at most, the largest first (of equal ones the smallest row). Then the
    matrix within each pattern, of up to 1 + ``alpha`` * ``beta`` rows, is gathered by two joins, and systems of one size are solved together. A round writes two tables.

    Entries of one place add up; columns without a positive diagonal entry are left out; a matrix of zeros has an L of zeros.
    """
    spark = a.df.sparkSession
    with scratch(spark, keep=1):
        m = written(a.summed().df.where("value <> 0"), "matrix")
        diagonal = m.where("row = col AND value > 0").select(F.col("row").alias("j"), F.col("value").alias("d"))
        low = written(diagonal.select(F.col("j").alias("k"), F.col("j").alias("row"), (1 / F.sqrt("d")).alias("value"), F.lit(True).alias("new")), "inverse")
        beside = m.select(F.col("row").alias("j"), F.col("col").alias("row"), F.col("value").alias("a"))
        each = Window.partitionBy("k")
        for _ in range(alpha):
            residual = low.join(beside, "row").where("j > k").groupBy("k", "j").agg(F.sum(F.col("a") * F.col("value")).alias("r"), F.bool_or("new").alias("near")).where("near")
            gain = residual.join(low.select("k", F.col("row").alias("j")), ["k", "j"], "left_anti").join(diagonal, "j").select("k", "j", (F.col("r") * F.col("r") / F.col("d")).alias("tau"))
            ranked = gain.select("*", *[f("tau").over(each).alias(n) for f, n in ((F.max, "most"), (F.min, "least"), (F.avg, "mean"))], F.row_number().over(each.orderBy(F.desc("tau"), "j")).alias("place"))
            chosen = ranked.where((F.col("most") > epsilon) & (F.col("place") <= beta) & ((F.col("tau") > F.col("mean")) | (F.col("least") == F.col("most"))))
            pattern = written(low.select("k", "row", F.lit(False).alias("new")).unionByName(chosen.select("k", F.col("j").alias("row"), F.lit(True).alias("new"))), "pattern")
            inside = pattern.join(m, "row").where("row >= col").join(pattern.select("k", F.col("row").alias("col")), ["k", "col"])
            # at most as many as a pattern has pairs
            systems = inside.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("row", "col", "value", "new"))).alias("e"))
            low = written(systems.select("k", *[F.col(f"e.{c}").alias(c) for c in ("row", "col", "value", "new")]).mapInPandas(_small_systems, "k bigint, row bigint, value double, new boolean"), "inverse")
        return Coo(low.select("row", F.col("k").alias("col"), "value"), a.n_rows, a.n_cols)


def _small_systems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Columns of the approximate inverse on their patterns (the lower triangles ``row``, ``col``, ``value`` in order), those of one size together."""
    for pdf in batches:
        by_size: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, row, col, value, new in pdf.itertuples(index=False):
            ids, first = np.unique(row, return_index=True)
            dense = np.zeros((len(ids), len(ids)))
            at, to = np.searchsorted(ids, row), np.searchsorted(ids, col)
            dense[at, to] = dense[to, at] = value
            by_size.setdefault(len(ids), []).append((k, ids, np.asarray(new)[first], dense))
        for size, group in by_size.items():
            m = np.stack([g[3] for g in group])
            # a pattern begins with its diagonal
            y = np.linalg.solve(m[:, 1:, 1:], m[:, 1:, :1])[:, :, 0]
            top = 1 / np.sqrt(m[:, 0, 0] - (m[:, 0, 1:] * y).sum(1))
            values = np.concatenate([top[:, None], -top[:, None] * y], axis=1)
            yield pd.DataFrame({"k": np.repeat([g[0] for g in group], size), "row": np.concatenate([g[1] for g in group]), "value": values.ravel(), "new": np.concatenate([g[2] for g in group]).astype(bool)})


@dataclass
class PDE:
    """An elliptic problem, or with ``times`` and a dt term a parabolic one, by finite elements of order 1 or 2."""

    mesh: Mesh
    operator: Operator
    order: int = 1
    times: list[float] = field(default_factory=list)
    source: Callable[..., Column] | None = None
    boundary: Callable[..., Column] | None = None
    initial: Callable[..., Column] | None = None

    def __post_init__(self) -> None:
        self.basis = Lagrange(self.mesh, self.order)
        self.stiff: Coo | None = None
        self.mass: Coo | None = None

    def init(self) -> PDE:
        """Assemble the matrices, that of the mass for parabolic problems alone; written, since every step reads them."""
        assembled = lambda x: Coo(written(x.df, "assembled"), x.n_rows, x.n_cols)
        self.stiff = assembled(assemble(self.operator.without("dt"), self.basis))
        if self.operator.is_parabolic:
            self.mass = assembled(mass(self.basis))
        self.points = written(self.basis.dofs(), "dofs")
        return self

    def _fixed(self, t: float) -> DataFrame | None:
        if self.boundary is None:
            return None
        x = [F.col(a) for a in self.mesh.axes]
        g = self.boundary(*x, F.lit(t)) if self.operator.is_parabolic else self.boundary(*x)
        return self.points.where("on_boundary").select(F.col("dof_id").alias("idx"), g.alias("value"))

    def _force(self, t: float) -> DataFrame:
        if self.source is None:
            return self.points.select(F.col("dof_id").alias("idx"), F.lit(0.0).alias("value"))
        f = (lambda *x: self.source(*x, F.lit(t))) if self.operator.is_parabolic else self.source
        return forcing(self.basis, f)

    def _solver(self, a: Coo) -> Callable[[DataFrame, float], DataFrame]:
        """A function of right side and time that gives (idx, value); the matrix is factorised once for all times, or iterated where its fronts are too large."""
        ids = None if self.boundary is None else self.points.where("on_boundary").select(F.col("dof_id").alias("row"))
        matrix = a if ids is None else fixed_rows(a, ids)
        right = lambda b, t: b if ids is None else fixed_right(a, b, self._fixed(t))
        try:
            factors = factorise(matrix, self.points.select(F.col("dof_id").alias("idx"), *self.mesh.axes), self.operator.is_symmetric)
        except FrontTooLarge:
            matrix = Coo(written(matrix.df, "fixed"), matrix.n_rows, matrix.n_cols)
            return lambda b, t: solve(matrix, right(b, t), self.operator.is_symmetric)
        return lambda b, t: factors.solve(right(b, t))

    def solve(self) -> DataFrame:
        """dof_id, coordinates and u; of parabolic problems for every time (t_index), by implicit Euler steps."""
        if self.stiff is None:
            self.init()
        named = lambda u: self.points.join(u.select(F.col("idx").alias("dof_id"), F.col("value").alias("u")), "dof_id").drop("on_boundary")
        if not self.operator.is_parabolic:
            return named(self._solver(self.stiff)(self._force(0.0), 0.0))
        step = self.times[1] - self.times[0]
        left = self.mass.scale(1 / step).plus(self.stiff)
        advance = self._solver(Coo(written(left.df, "euler"), left.n_rows, left.n_cols))
        x = [F.col(a) for a in self.mesh.axes]
        u = written(self.points.select(F.col("dof_id").alias("idx"), (self.initial(*x) if self.initial else F.lit(0.0)).alias("value")), "state")
        states = [u]
        for t in self.times[1:]:
            b = self.mass.times_vector(u).withColumn("value", F.col("value") / step).unionByName(self._force(t)).groupBy("idx").agg(F.sum("value").alias("value"))
            u = advance(b, t)
            states.append(u)
        every = reduce(DataFrame.unionByName, [s.select(F.col("idx").alias("dof_id"), F.col("value").alias("u"), F.lit(k).alias("t_index")) for k, s in enumerate(states)])
        return self.points.drop("on_boundary").join(every, "dof_id")
