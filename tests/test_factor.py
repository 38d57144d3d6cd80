"""Factors by nested dissection, against numpy and manufactured problems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import coo as cm
from fieldloom.operators import mesh as ms
from fieldloom.plans import assembly as asm
from fieldloom.plans import basis as ba
from fieldloom.plans import factor as fa
from fieldloom.plans import solve as so

from .test_solve import matrix, values, vector


def grid(n, symmetric, rng):
    """A five-point matrix of an n x n grid, with places, in a random order of unknowns."""
    m, order = np.zeros((n * n, n * n)), rng.permutation(n * n)
    at = order.reshape(n, n)
    for i in range(n):
        for j in range(n):
            m[at[i, j], at[i, j]] = 4.5 + rng.random()
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < n and y < n:
                    m[at[i, j], at[x, y]] = -rng.random()
                    m[at[x, y], at[i, j]] = m[at[i, j], at[x, y]] if symmetric else -rng.random() * (rng.random() < 0.7)
    return m, {int(at[i, j]): (float(i), float(j)) for i in range(n) for j in range(n)}


@pytest.mark.parametrize(("symmetric", "placed", "leaf"), [(True, True, 6), (False, True, 10), (True, False, 30), (False, False, 500)])
def test_against_numpy(spark, symmetric, placed, leaf):
    rng = np.random.default_rng(3)
    m, at = grid(12, symmetric, rng)
    places = spark.createDataFrame([(k, *p) for k, p in at.items() if k != 5], "idx long, x double, y double") if placed else None
    f = fa.factorise(matrix(spark, m), places, symmetric, leaf)
    assert len(f.levels) == {6: 4, 10: 3, 30: 3, 500: 1}[leaf]
    x = rng.normal(size=(144, 3))
    assert np.allclose(values(f.solve(vector(spark, m @ x[:, 0])), 144), x[:, 0], atol=1e-9)
    b = m @ x
    many = spark.createDataFrame([(i, 10 * k, float(b[i, k])) for i in range(144) for k in range(3)], "idx long, col long, value double")
    out = np.zeros((144, 3))
    for r in f.solve(many).collect():
        out[r.idx, r.col // 10] = r.value
    assert np.allclose(out, x, atol=1e-9)


def test_defined_cases(spark, monkeypatch):
    d = np.arange(1.0, 41.0)
    apart = fa.factorise(matrix(spark, np.diag(d)), leaf=3)
    assert len(apart.levels) == 3 and np.allclose(values(apart.solve(vector(spark, d * d)), 40), d)
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (1, 1, 4.0), (2, 2, 8.0), (2, 0, None), (7, 0, 1.0)], "row long, col long, value double")
    f = fa.factorise(cm.Coo(rows, 3, 3), leaf=1)
    b = spark.createDataFrame([(1, 1.0), (1, 3.0), (9, 1.0)], "idx long, value double")
    assert values(f.solve(b), 3).tolist() == [0, 1, 0] and values(f.solve(b.limit(0)), 3).tolist() == [0, 0, 0]
    assert fa.factorise(cm.Coo(rows.limit(0), 0, 0)).solve(b).count() == 0
    with pytest.raises(fa.Singular):
        fa.factorise(matrix(spark, np.zeros((3, 3)))).solve(b)
    with pytest.raises(ValueError):
        fa.factorise(cm.Coo(rows, 3, 4))


def test_large_fronts_are_iterated(spark, monkeypatch):
    monkeypatch.setattr(so, "factorise", lambda *a: (_ for _ in ()).throw(fa.FrontTooLarge("large")))
    u = so.PDE(ms.square(spark, 4), -asm.laplacian(), boundary=lambda x, y: x + y).solve().collect()
    assert len(u) == 25 and all(abs(r.u - r.x - r.y) < 1e-8 for r in u)


def test_front_limit_reaches_the_driver(spark):
    a = asm.assemble(asm.reaction(1.0) - asm.laplacian(), ba.Lagrange(ms.square(spark, 8)))

    def small(level, symmetric):
        def run(entries, below):
            raise fa.FrontTooLarge("a front of 81 unknowns")

        return run

    real = fa._eliminate
    fa._eliminate = small
    try:
        with pytest.raises(fa.FrontTooLarge, match="81"):
            fa.factorise(a)
    finally:
        fa._eliminate = real


def test_many_heat_steps_reuse_one_factorisation(spark, monkeypatch):
    calls, real = [], so.factorise
    monkeypatch.setattr(so, "factorise", lambda *a: (calls.append(1), real(*a))[1])
    times = [0.1 * k for k in range(6)]
    o = asm.dt() - asm.laplacian()
    p = so.PDE(ms.square(spark, 6), o, times=times, source=lambda x, y, t: F.lit(1.0), boundary=lambda x, y, t: x + y + t, initial=lambda x, y: x + y)
    off = p.solve().select(F.max(F.abs(F.col("u") - F.col("x") - F.col("y") - 0.1 * F.col("t_index"))).alias("e"), F.count("*").alias("n")).first()
    assert off.e < 1e-9 and off.n == 6 * 49 and len(calls) == 1


def test_woodbury_with_many_columns(spark):
    """Fifty columns are one pass through the factors."""
    rng = np.random.default_rng(1)
    a = np.diag(3.0 + rng.random(60)) + np.diag(-np.ones(59), 1) + np.diag(-np.ones(59), -1)
    u, c, x = rng.normal(size=(60, 50)) / 8, np.diag(1.0 + rng.random(50)), rng.normal(size=60)
    b = (a + u @ c @ u.T) @ x
    f = fa.factorise(matrix(spark, a), leaf=20)
    found = values(so.woodbury(f, matrix(spark, u), np.linalg.inv(c), matrix(spark, u.T), vector(spark, b)), 60)
    assert np.allclose(found, x, atol=1e-8)


def test_strip_is_cut_across(spark):
    """Parts of a long strip have borders as short as it is narrow, so fronts don't grow with its length."""
    w, n = 5, 1500
    edges = [(i, j) for i in range(n) for j in ((i + 1) if i % w < w - 1 else -1, i + w) if 0 <= j < n]
    rows = [(i, i, 5.0) for i in range(n)] + [e for i, j in edges for e in ((i, j, -1.0), (j, i, -1.0))]
    places = spark.createDataFrame([(i, float(i % w), float(i // w)) for i in range(n)], "idx long, x double, y double")
    f = fa.factorise(cm.Coo(spark.createDataFrame(rows, "row long, col long, value double"), n, n), places, leaf=50)
    fronts = [t.agg(F.max((F.octet_length("own") + F.octet_length("bound")) / 8)).first()[0] for t in f.levels]
    assert len(fronts) == 4 and max(fronts) <= 50 + 2 * (w + 2)


def test_leaves_keep_their_entries(spark):
    """Tables of factors hold some entries for each unknown, not the inverses of their parts."""
    n = 40
    a = asm.assemble(asm.reaction(1.0) - asm.laplacian(), ba.Lagrange(ms.square(spark, n)))
    f = fa.factorise(a, leaf=500)
    m = np.zeros((a.n_rows, a.n_rows))
    for r in a.df.collect():
        m[r.row, r.col] = r.value
    size = sum(F.octet_length(c) for c in f.levels[0].columns if c != "node")
    assert f.levels[0].agg(F.sum(size)).first()[0] < 600 * a.n_rows
    b = np.random.default_rng(3).random(a.n_rows)
    assert np.allclose(m @ values(f.solve(vector(spark, b)), a.n_rows), b)
