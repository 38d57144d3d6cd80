"""Linear systems and elliptic problems, against dense solutions and manufactured ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import coo as cm
from fieldloom.operators import mesh as ms
from fieldloom.plans import assembly as asm
from fieldloom.plans import basis as ba
from fieldloom.plans import solve as so


def matrix(spark, m):
    return cm.Coo(spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "row long, col long, value double"), *m.shape)


def vector(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx long, value double")


def values(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r.idx] = r.value
    return out


@pytest.mark.parametrize("symmetric", [True, False])
def test_badly_scaled_systems(spark, symmetric):
    """The diagonal scaling keeps the iteration short where rows differ by many orders."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 30)) * 0.05
    a = (a @ a.T if symmetric else a) + np.diag(np.ones(30))
    d = np.diag(10.0 ** rng.integers(-3, 4, 30) ** 1.0)
    a = d @ a @ d if symmetric else d @ a
    x = rng.normal(size=30)
    found = values(so.solve(matrix(spark, a), vector(spark, a @ x), symmetric), 30)
    assert np.allclose(a @ found, a @ x, rtol=1e-6, atol=1e-8 * np.abs(a @ x).max())


def test_sparse_right_sides(spark):
    """Entries that are absent are zero, those of one index add up, and a right side of zeros has a solution of zeros."""
    a = np.diag([2.0, 4.0, 8.0])
    b = spark.createDataFrame([(1, 1.0), (1, 3.0)], "idx long, value double")
    assert values(so.solve(matrix(spark, a), b), 3).tolist() == [0, 1, 0]
    assert so.solve(matrix(spark, a), b.limit(0), symmetric=False).where("value <> 0").isEmpty()


def test_no_convergence_is_an_error(spark):
    a = np.diag(np.full(20, 2.0)) - np.eye(20, k=1) - np.eye(20, k=-1)
    with pytest.raises(so.NotConverged):
        so.solve(matrix(spark, a), vector(spark, np.ones(20)), most=3)
    with pytest.raises(so.NotConverged):
        so.solve(matrix(spark, np.zeros((3, 3))), vector(spark, np.ones(3)), symmetric=False)
    with pytest.raises(ValueError):
        so.solve(matrix(spark, np.ones((2, 3))), vector(spark, np.ones(2)))


def test_diffusion_that_is_not_symmetric(spark):
    """K = [[1, 2], [0, 1]]: the whole matrix, and the solver for such."""
    mesh = ms.square(spark, 1)
    o = asm.diffusion([[1.0, 2.0], [0.0, 1.0]])
    assert not o.is_symmetric and asm.diffusion([[1.0, 2.0], [2.0, 1.0]]).is_symmetric
    assert not asm.diffusion(lambda x, y: [[x, y], [y, x]]).is_symmetric and asm.diffusion(lambda x, y: [[x, y], [y, x]], symmetric=True).is_symmetric
    found = np.zeros((4, 4))
    for r in asm.assemble(o, ba.Lagrange(mesh)).df.collect():
        found[r.row, r.col] = r.value
    k, xy, expected = np.array([[1.0, 2], [0, 1]]), np.array([[0.0, 0], [1, 0], [0, 1], [1, 1]]), np.zeros((4, 4))
    for cell in ((0, 1, 3), (0, 3, 2)):
        p = xy[list(cell)]
        g = np.linalg.inv(np.c_[np.ones(3), p])[1:]
        expected[np.ix_(cell, cell)] -= 0.5 * g.T @ k @ g
    assert np.allclose(found, expected) and not np.allclose(found, found.T) and np.isclose(found[1, 0], 0.5)


def test_problem_with_a_diffusion_that_is_not_symmetric(spark):
    """u = x^2 + x y; the equation -div(K grad u) = f with K = [[1, 2], [0, 1]] has f = -(2 + 2)."""
    o = -asm.diffusion([[1.0, 2.0], [0.0, 1.0]])
    exact = lambda x, y: x * x + x * y
    u = so.PDE(ms.square(spark, 3), o, 2, source=lambda x, y: F.lit(-4.0), boundary=exact).solve()
    assert u.agg(F.max(F.abs(F.col("u") - exact(F.col("x"), F.col("y"))))).first()[0] < 1e-7


def test_solution_takes_no_system_to_the_driver(spark, monkeypatch):
    """Only sums reach it: a few numbers for each step."""
    from pyspark.sql import DataFrame

    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(len(out := collect(self))) or out)
    a = np.diag(np.full(12, 3.0)) - np.eye(12, k=1) - np.eye(12, k=-1)
    x = so.solve(matrix(spark, a), vector(spark, np.ones(12)))
    assert max(seen, default=0) <= 1
    monkeypatch.undo()
    assert np.allclose(values(x, 12), np.linalg.solve(a, np.ones(12)), atol=1e-9)


@pytest.mark.parametrize("kind", ["diagonal", "inverse", "stabilised"])
def test_steps_broadcast_no_vector(spark, monkeypatch, kind):
    """Vectors compress well, so Spark would take products for small ones: every join of a step asks for a merge, the second product's, too."""
    plans = []
    writing = so.written
    monkeypatch.setattr(so, "written", lambda df, name, *a: (name == "vectors" and plans.append(df._jdf.queryExecution().optimizedPlan().toString())) or writing(df, name, *a))
    a = np.diag(np.full(12, 3.0)) - np.eye(12, k=1) - np.eye(12, k=-1)
    m = matrix(spark, a)
    x = so.solve(m, vector(spark, np.ones(12)), kind != "stabilised", low=so.sparse_inverse(m) if kind == "inverse" else None)
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert joins and not [line for line in joins if "strategy=merge" not in line]
    assert np.allclose(values(x, 12), np.linalg.solve(a, np.ones(12)), atol=1e-9)
