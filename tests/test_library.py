import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import fields as fl
from fieldloom.functions import vectors as ve
from fieldloom.functions.geometry import Hyperplane, Simplex
from fieldloom.operators import bits as bt
from fieldloom.operators import coo as cm
from fieldloom.operators import mesh as ms
from fieldloom.operators import spatial as sp
from fieldloom.operators import trees as tr
from fieldloom.operators.frame import BlockFrame
from fieldloom.plans import assembly as asm
from fieldloom.plans import basis as ba
from fieldloom.plans import optimize as op
from fieldloom.plans import quadrature as qu
from fieldloom.plans import solve as so
from fieldloom.sources import files, shapefile
from fieldloom.streaming.points import locate_stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def dense(m):
    out = np.zeros((m.n_rows, m.n_cols))
    for r in m.df.collect():
        out[r.row, r.col] += r.value
    return out


def matrix(spark, a):
    a = np.asarray(a, float)
    rows = [(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)]
    return cm.Coo(spark.createDataFrame(rows, "row long, col long, value double"), *a.shape)


def test_triangle(spark):
    t = Simplex([ve.vec(0, 0), ve.vec(0.5, 0), ve.vec(0, 0.8)])
    assert one(spark, t.measure(), *t.circumcenter()) == pytest.approx((0.2, 0.25, 0.4))
    codes = one(spark, *[t.contains(ve.vec(*p)) for p in ((1, 1), (0.1, 0.1), (0.25, 0), (0, 0.8))])
    assert codes == (0, 1, 2, 3)


def test_solid_and_surface_simplices(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(4, 3))
    tet, tri = Simplex([ve.vec(*x) for x in p]), Simplex([ve.vec(*x) for x in p[:3]])
    assert one(spark, tet.measure())[0] == pytest.approx(abs(np.linalg.det(p[1:] - p[0])) / 6)
    c = np.array(one(spark, *tet.circumcenter()))
    assert np.allclose(np.linalg.norm(p - c, axis=1), np.linalg.norm(p[0] - c))
    area = np.linalg.norm(np.cross(p[1] - p[0], p[2] - p[0])) / 2
    assert one(spark, tri.measure())[0] == pytest.approx(area)
    c = np.array(one(spark, *tri.circumcenter()))
    assert np.allclose(np.linalg.norm(p[:3] - c, axis=1), np.linalg.norm(p[0] - c))
    assert one(spark, tri.circumradius())[0] == pytest.approx(np.linalg.norm(p[0] - c))
    assert abs(np.array(one(spark, *tri.normal())) @ (p[1] - p[0])) < 1e-12
    assert [f.order for f in tet.facets()] == [2] * 4


@pytest.mark.parametrize("size", [2, 3, 4])
def test_nearest_points(spark, size):
    """No point of a fine sample of the simplex is nearer than the one found."""
    rng = np.random.default_rng(size)
    for _ in range(4):
        v, q = rng.normal(size=(size, 3)), rng.normal(size=3) * 2
        near = np.array(one(spark, *Simplex([ve.vec(*x) for x in v]).nearest(ve.vec(*q))))
        sample = rng.dirichlet(np.ones(size), 4000) @ v
        least = np.linalg.norm(np.vstack([sample, v]) - q, axis=1).min()
        assert np.linalg.norm(near - q) <= least + 1e-9
        assert np.linalg.norm(near - q) >= least - 0.2


def test_hyperplane(spark):
    h = Hyperplane.through([ve.vec(1, 0, 0), ve.vec(0, 1, 0), ve.vec(0, 0, 1)])
    x = ve.vec(1, 1, 1)
    assert one(spark, h.distance(x), *h.project(x)) == pytest.approx((2 / 3**0.5, 1 / 3, 1 / 3, 1 / 3))
    assert abs(one(spark, h.evaluate(x))[0]) == pytest.approx(2 / 3**0.5)
    assert one(spark, *h.at(h.coordinates(x))) == pytest.approx((1 / 3,) * 3)
    line = Hyperplane.through([ve.vec(0, 0), ve.vec(2, 2)])
    assert one(spark, line.distance(ve.vec(1, 0)))[0] == pytest.approx(0.5**0.5)


def test_search_literals(spark):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate([(2, 3), (5, 4), (9, 6), (4, 7), (8, 1), (7, 2)])], "pid long, x double, y double")
    q = spark.createDataFrame([(0, 9.0, 2.0), (1, 40.0, -40.0)], "qid long, x double, y double")
    found = {r.qid: (r.pid, r.d2) for r in sp.nearest(q, points, 1.0).collect()}
    assert found[0] == (4, 2.0) and found[1][0] == 4
    box = points.where(sp.in_box(ve.vec("x", "y"), ve.vec(3, 2), ve.vec(8, 6)))
    assert {r.pid for r in box.collect()} == {1, 5}
    assert sp.nearest(q, points.limit(0), 1.0).where("pid IS NULL").count() == 2


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(300, 2)), rng.normal(size=(60, 2)) * 3
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double")
    queries = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "qid long, x double, y double")
    for r in sp.nearest(queries, points, 0.25).collect():
        assert r.pid == ((p - q[r.qid]) ** 2).sum(1).argmin()


def test_location_in_a_solid(spark):
    mesh, rng = ms.cube(spark, 2), np.random.default_rng(3)
    p = rng.random((50, 3))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate([*p, (2, 2, 2)])], "pid long, x double, y double, z double")
    rows = {r.pid: r.cell_id for r in sp.locate(points, mesh, 0.5).collect()}
    assert rows[50] == -1 and min(rows[i] for i in range(50)) >= 0
    z = sp.locate_all(points, mesh, 0.5).select("z0", "z1", "z2", "z3").collect()
    assert all(abs(sum(r) - 1) < 1e-12 for r in z)


def test_fields(spark):
    f = fl.ScalarField(lambda x, y: F.exp(2 * x + y) / x, 2, h=1e-4)
    assert one(spark, *f.gradient()(*ve.vec(1, 1))) == pytest.approx((np.e**3,) * 2, rel=1e-5)
    g = fl.ScalarField(lambda x, y: F.exp(x) + x * x * y * F.log(y), 2, h=1e-3)
    h = g.hessian()(*ve.vec(1, 1))
    assert one(spark, h[0][0], h[0][1], h[1][0], h[1][1]) == pytest.approx((np.e, 2, 2, 1), rel=1e-4)
    exact = fl.ScalarField(lambda x: x * x, 1, gradient=[lambda x: 2 * x])
    assert one(spark, exact.gradient()(F.lit(3.0))[0]) == (6.0,)
    assert one(spark, *[fl.log1pexp(F.lit(v)) for v in (-800.0, 0.0, 20.0, 800.0)]) == pytest.approx((0, np.log(2), np.log1p(np.exp(20)), 800))
    assert fl.monomials(2, 2) == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (0, 2)]


def test_kronecker_and_blocks(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, (2, 3)), rng.integers(0, 4, (3, 2))
    ma, mb = matrix(spark, a), matrix(spark, b)
    assert (dense(ma.kronecker(mb)) == np.kron(a, b)).all()
    assert (dense(ma.times(mb)) == a @ b).all()
    assert (dense(cm.block_matrix([[ma, None], [None, mb]])) == np.block([[a, np.zeros((2, 2))], [np.zeros((3, 3)), b]])).all()
    with pytest.raises(ValueError):
        ma.lump()


def test_frame_errors(spark):
    f = BlockFrame.of(spark.range(5).withColumnRenamed("id", "a"), "a")
    with pytest.raises(KeyError):
        f.get("b")
    with pytest.raises(ValueError):
        f.insert("b", spark.range(4).selectExpr("id AS row_id", "id AS b"))
    assert f.insert("b", spark.range(5).selectExpr("id AS row_id", "id * 2 AS b")).dirty_columns() == ["b"]
    assert sorted(r.a for r in f.shuffle(1).df.collect()) == list(range(5))
    assert [r.row_id for r in f.shuffle(1).df.orderBy("a").collect()] == [r.row_id for r in f.shuffle(1).df.orderBy("a").collect()]


@pytest.mark.parametrize(("dimension", "nodes"), sorted(qu.SIMPLEX))
def test_rules_integrate_lines(dimension, nodes):
    """Weights add up to one, and the mean of each coordinate is that of the simplex."""
    table = qu.SIMPLEX[dimension, nodes]
    assert sum(w for _, w in table) == pytest.approx(1, abs=1e-12)
    assert np.allclose(sum(w * np.array(q) for q, w in table), 1 / (dimension + 1))


def test_second_order_basis_has_the_lagrange_property(spark):
    nodes = [(0, 0), (1, 0), (0, 1), (0.5, 0), (0, 0.5), (0.5, 0.5)]
    for k, (x, y) in enumerate(nodes):
        z = [F.lit(1.0 - x - y), F.lit(float(x)), F.lit(float(y))]
        assert one(spark, *ba.shape_functions(z, 2)) == pytest.approx(np.eye(6)[k])
        assert np.allclose(np.array(one(spark, *sum(ba.reference_gradients(z, 2), []))).reshape(6, 2).sum(0), 0)


def test_cubic_splines(spark):
    knots = np.arange(11) / 10
    s = ba.Splines(list(knots), 3)
    points = spark.createDataFrame([(i, i / 100) for i in range(101)], "pid long, x double")
    v = s.evaluate(points).groupBy("pid").agg(F.sum("value").alias("v"), F.count("*").alias("n")).collect()
    assert s.n == 13 and len(v) == 101 and all(abs(r.v - 1) < 1e-12 and r.n <= 4 for r in v)
    second = s.evaluate(points, 2).groupBy("pid").agg(F.sum("value").alias("v")).collect()
    assert all(abs(r.v) < 1e-9 for r in second)


def test_spline_matrices_are_symmetric(spark):
    s = ba.Splines(list(np.arange(11) / 5), 3)
    spans = spark.createDataFrame([(i / 5, (i + 1) / 5) for i in range(10)], "a double, b double")
    m = dense(asm.assemble_splines(asm.reaction(1.0), s, spans))
    k = dense(asm.assemble_splines(asm.bilaplacian(), s, spans))
    assert np.allclose(m, m.T) and m.sum() == pytest.approx(2, abs=1e-3) and (np.abs(m) > 0).sum() == 79
    assert np.allclose(k, k.T) and np.allclose(k.sum(1), 0, atol=1e-9)


def test_conjugate_gradients_against_dense(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 12))
    b = rng.normal(size=12)
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "idx long, value double")
    for m, symmetric in ((a @ a.T + 12 * np.eye(12), True), (a + 12 * np.eye(12), False)):
        x = {r.idx: r.value for r in so.solve(matrix(spark, m), right, symmetric).collect()}
        assert np.allclose([x[i] for i in range(12)], np.linalg.solve(m, b), atol=1e-8)


def test_approximate_inverse(spark):
    a = np.diag(np.full(20, 4.0)) - np.eye(20, k=1) - np.eye(20, k=-1)
    low = dense(so.sparse_inverse(matrix(spark, a), alpha=4, beta=3, epsilon=1e-8))
    assert np.allclose(low, np.tril(low))
    assert np.abs(low @ low.T - np.linalg.inv(a)).max() < 0.02


def approximate_inverse(a, alpha, beta, epsilon):
    """Column by column, on dense arrays."""
    n = len(a)
    out = np.zeros((n, n))
    for k in range(n):
        pattern, new = [k], [k]
        for step in range(alpha + 1):
            rest = [j for j in pattern if j != k]
            y = np.linalg.solve(a[np.ix_(rest, rest)], a[rest, k])
            out[:, k] = 0
            out[k, k] = 1 / np.sqrt(a[k, k] - a[k, rest] @ y)
            out[rest, k] = -out[k, k] * y
            near = [j for j in range(k + 1, n) if j not in pattern and any(a[j, i] for i in new)]
            tau = np.array([(a[j] @ out[:, k]) ** 2 / a[j, j] for j in near])
            if step == alpha or not len(tau) or tau.max() <= epsilon:
                break
            new = [near[i] for i in np.argsort(-tau, kind="stable") if tau[i] > tau.mean() or tau.min() == tau.max()][:beta]
            pattern = sorted([*pattern, *new])
    return out


@pytest.mark.parametrize("alpha, beta", [(0, 3), (1, 1), (2, 4), (5, 2)])
def test_pattern_growth_against_columns(spark, alpha, beta):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((30, 30)) < 0.15, rng.normal(size=(30, 30)), 0.0)
    a = a + a.T + np.diag(np.abs(a + a.T).sum(1) + 0.5)
    low = dense(so.sparse_inverse(matrix(spark, a), alpha, beta, 1e-6))
    assert np.allclose(low, approximate_inverse(a, alpha, beta, 1e-6), atol=1e-12)


def test_preconditioned_gradients_take_fewer_steps(spark):
    a = asm.assemble(asm.reaction(5.0) - asm.laplacian(), ba.Lagrange(ms.square(spark, 8))).summed()
    m = dense(a)
    b = np.random.default_rng(8).normal(size=len(m))
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "idx long, value double")
    x = {r.idx: r.value for r in so.solve(a, right, tolerance=1e-6, most=20, low=so.sparse_inverse(a, 4, 4, 1e-4)).collect()}
    assert np.abs(m @ [x[i] for i in range(len(m))] - b).max() < 1e-4
    with pytest.raises(so.NotConverged):
        so.solve(a, right, tolerance=1e-6, most=30)


def test_heat_equation_converges_with_second_order(spark):
    """exp(-t) sin-like solution: the error falls by four when the mesh is halved and the steps are quartered."""
    exact = lambda x, y, t: F.exp(-t) * (x * x + y * y)
    errors = []
    for n, m in ((2, 2), (4, 8)):
        p = so.PDE(ms.square(spark, n), asm.dt() - asm.laplacian(), times=[0.2 * i / m for i in range(m + 1)], source=lambda x, y, t: -F.exp(-t) * (x * x + y * y + 4), boundary=exact, initial=lambda x, y: exact(x, y, F.lit(0.0)))
        last = p.solve().where(F.col("t_index") == m)
        errors.append(last.agg(F.max(F.abs(F.col("u") - exact(F.col("x"), F.col("y"), F.lit(0.2))))).first()[0])
    assert errors[1] < errors[0] / 2 or errors[1] < 1e-3


def test_optimisers(spark):
    loss = lambda x, y: x * F.exp(-x * x - y * y) + (x * x + y * y) / 20
    f = op.Objective(spark.range(1), loss, h=1e-4)
    goal = (-0.6690718221499544, 0)
    for method, near in ((op.Newton(step=1.0), 1e-5), (op.BFGS(search=op.Wolfe()), 1e-5), (op.GradientDescent(most=40, search=op.Backtracking(alpha=1.0, gamma=0.3), tolerance=1e-3), 1e-2)):
        found = method.minimise(f, [-0.7, 0.1])
        assert np.allclose(found.optimum, goal, atol=near), method

    class Stop:
        def post_update(self, x, g):
            return True

    assert op.GradientDescent(callbacks=[Stop()]).minimise(f, [-1.0, -1.0]).n_iter == 1


def test_tree_orders(spark):
    rows = [(1, None, False), (2, 1, True), (7, 1, False), (3, 2, True), (4, 2, False), (8, 7, False), (5, 3, True), (6, 3, False), (9, 8, False)]
    paths = tr.with_paths(spark.createDataFrame(rows, "node_id long, parent_id long, is_left boolean"))
    assert [r.node_id for r in paths.orderBy(*tr.breadth_first()).collect()] == [1, 2, 7, 3, 4, 8, 5, 6, 9]
    assert [r.node_id for r in paths.orderBy(*tr.depth_first()).collect()] == [1, 2, 3, 5, 6, 4, 7, 8, 9]
    assert {r.node_id for r in tr.leaves(paths).collect()} == {4, 5, 6, 9}
    assert {r.node_id for r in tr.subtree(paths, "LL").collect()} == {3, 5, 6}
    new = spark.createDataFrame([(70, "R"), (71, "RL")], "node_id long, path string")
    assert {r.node_id for r in tr.put(paths, new).collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 70, 71}


def test_text_sources(spark, tmp_path):
    (tmp_path / "dense.csv").write_text('"","V1","V2"\n"1","-0.925"," 0.5"\n"2","NA","nan"\n')
    rows = files.read_dense(spark, str(tmp_path / "dense.csv"), ["x", "y"]).orderBy("row_id").collect()
    assert rows[0] == (0, -0.925, 0.5) and np.isnan(rows[1][1]) and np.isnan(rows[1][2])
    (tmp_path / "sparse.csv").write_text('"","r","c","v"\n"1",1,2,3.5\n"2",1,2,1\n"3",4,1,2\n')
    m = files.read_triplets(spark, str(tmp_path / "sparse.csv"))
    assert (m.n_rows, m.n_cols) == (4, 2) and dense(m)[0, 1] == 4.5 and dense(m)[3, 0] == 2
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 2 2\n1 1 2.5\n3 2 -1\n")
    m = files.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    assert dense(m).tolist() == [[2.5, 0], [0, 0], [0, -1]]
    (tmp_path / "points.csv").write_text('"","V1","V2"\n"1",0,0\n"2",1,0\n"3",0,1\n')
    (tmp_path / "elements.csv").write_text('"","V1","V2","V3"\n"1",1,2,3\n')
    mesh = files.read_mesh(spark, str(tmp_path))
    assert mesh.geometry().select(mesh.simplex().measure()).first()[0] == 0.5
    assert [tuple(r) for r in files.rebased(spark.createDataFrame([(3, 0), (-1, 1)], "a long, b long"), "a", "b").collect()] == [(2, -1), (-1, 0)]


def record(number, body):
    return struct.pack(">2i", number, len(body) // 2) + body


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    flat = [v for p in ring for v in p]
    polygon = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + struct.pack("<8d", *flat)
    point_z = struct.pack("<i4d", 11, 1, 2, 3, 4)
    line_m = struct.pack("<i4d2ii", 23, 0, 0, 1, 1, 1, 2, 0) + struct.pack("<4d", 0, 0, 1, 1) + struct.pack("<4d", 5, 6, 5, 6)
    body = b"".join(record(i + 1, b) for i, b in enumerate((polygon, point_z, line_m, struct.pack("<i", 0))))
    (tmp_path / "a.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)
    fields = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in (("NAME", "C", 6), ("POP", "N", 5)))
    rows = b"".join(f" {n:<6}{p:>5}".encode() for n, p in (("one", 12), ("two", 7), ("three", 0), ("four", 1)))
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 4, 32 + len(fields) + 1, 12) + fields + b"\r" + rows)
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D"]]')
    found = {r.record: r for r in shapefile.read_folder(spark, str(tmp_path)).withColumn("pop", shapefile.attribute("POP")).collect()}
    assert [(p.x, p.y) for p in found[1].rings[0]] == ring and found[1].bbox == [0, 0, 1, 1]
    assert (found[2].rings[0][0].z, found[2].rings[0][0].m) == (3, 4) and [p.m for p in found[3].rings[0]] == [5, 6] and found[4].rings == []
    assert (found[1]["values"]["NAME"], found[2].pop, found[3].gcs) == ("one", 7.0, "GCS_WGS_1984")
    assert shapefile.points_of(shapefile.read_shapes(spark, str(tmp_path / "a.shp"))).count() == 7


def test_stream(spark, tmp_path):
    points = spark.range(50).selectExpr("id AS pid", "id / 50.0D AS x", "(id * 7 % 50) / 50.0D AS y")
    points.repartition(2).write.parquet(str(tmp_path / "in"))
    mesh = ms.square(spark, 4)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    locate_stream(stream, mesh, 0.25, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(r.pid, r.cell_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(r.pid, r.cell_id) for r in sp.locate(points, mesh, 0.25).collect()}


@pytest.mark.parametrize("wide", [64, 4])
def test_search_tree_against_insertion(spark, monkeypatch, wide):
    """Random, ascending, descending and equal values, and nulls, which aren't inserted."""
    monkeypatch.setattr(tr, "WIDE", wide)
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 60, 90).tolist(), list(range(40)), list(range(40, 0, -1)), [3] * 9, [5], [None, 2, None, 1]):
        expected, tree = {}, {}
        for i, v in enumerate(values):
            if v is None:
                continue
            parent, left, at = None, False, next(iter(tree), None)
            while at is not None:
                parent, left = at, v < tree[at][0]
                at = tree[at][1 if left else 2]
            tree[i] = [v, None, None]
            if parent is not None:
                tree[parent][1 if left else 2] = i
            expected[i] = (v, parent, left)
        df = spark.createDataFrame(list(enumerate(values)), "node_id long, value long").repartition(3)
        assert {r.node_id: (r.value, r.parent_id, r.is_left) for r in tr.search_tree(df).collect()} == expected
    assert tr.search_tree(df.limit(0)).collect() == []


def test_matrices_with_nulls(spark):
    rows = [(0, 0, 1.0), (0, 0, None), (0, 1, None), (1, 1, float("nan")), (None, 0, 5.0), (0, None, 5.0), (1, 0, 2.0)]
    a = cm.Coo(spark.createDataFrame(rows, "row long, col long, value double"), 2, 2)
    x = spark.createDataFrame([(0, 3.0), (1, 1.0), (None, 9.0)], "idx long, value double")
    found = {r.idx: r.value for r in a.times_vector(x).collect()}
    assert found[0] == 3.0 and np.isnan(found[1]) and found[None] == 15.0
    assert {(r.row, r.col): r.value for r in a.summed().df.where("row = 0").collect()} == {(0, 0): 1.0, (0, 1): None, (0, None): 5.0}
    empty = cm.Coo(a.df.limit(0), 2, 2)
    assert empty.times_vector(x).collect() == [] and empty.times(a).df.collect() == [] and empty.plus(empty).df.collect() == []


def test_meshes_with_nulls(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, None), (2, 0.0, 1.0), (3, float("nan"), 1.0)], "node_id long, x double, y double")
    cells = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2), (2, 2, 3, 9)], "cell_id long, v0 long, v1 long, v2 long")
    mesh = ms.Mesh(nodes, cells, 2)
    assert mesh.edges().count() == 7 and mesh.boundary_facets().count() == 5
    geometry = {r.cell_id: r for r in mesh.geometry().collect()}
    assert set(geometry) >= {0, 1} and geometry[0].y1 is None
    none = ms.Mesh(nodes.limit(0), cells.limit(0), 2)
    assert [df.count() for df in (none.edges(), none.neighbors(), none.boundary_nodes(), none.geometry(), none.facets(), none.cell_facets())] == [0] * 6


def test_traits_and_counts_of_meshes(spark):
    square, cube, line = ms.square(spark, 1), ms.cube(spark, 1), ms.interval(spark, 0, 1, 2)
    assert square.is_2d() and cube.is_3d() and not (square.is_manifold() or square.is_surface() or line.is_network() or cube.is_2d())
    assert cube.surface().is_surface() and cube.surface().is_manifold()
    assert square.per_cell() == {"vertices": 3, "edges": 3, "facets": 3, "neighbors": 3} and cube.per_cell() == {"vertices": 4, "edges": 6, "facets": 4, "neighbors": 4}


def test_files_by_their_header(spark, tmp_path):
    (tmp_path / "text.csv").write_text('"","a b","y"\n"r1"," 1.5","NA"\n"r2","2",""\n')
    rows = files.read_dense(spark, str(tmp_path / "text.csv")).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [0, 1] and rows[0]["a b"] == 1.5 and np.isnan(rows[0].y) and rows[1].y is None
    (tmp_path / "bad.csv").write_text('"","x"\n"1","one"\n')
    with pytest.raises(Exception, match="not a number: one"):
        files.read_dense(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError, match="three columns"):
        files.read_triplets(spark, str(tmp_path / "text.csv"))
    (tmp_path / "none.csv").write_text('"","x"\n')
    assert files.read_dense(spark, str(tmp_path / "none.csv")).collect() == []


def test_splines_by_spans_are_those_of_the_recursion(spark):
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate([*np.linspace(0, 2, 41), -1, 3])] + [(90, None), (91, float("nan"))], "pid long, x double")
    for order in (0, 1, 2, 3):
        s = ba.Splines([0, 0.3, 0.5, 1.4, 2], order)
        for derivative in range(order):
            found = {(r.pid, r.dof_id): r.value for r in s.evaluate(points, derivative).collect()}
            slow = points.where("x BETWEEN 0 AND 2").select("pid", F.posexplode(F.array(*[s.value(i, F.col("x"), derivative) for i in range(s.n)])).alias("i", "v")).where("v <> 0").collect()
            for r in slow:
                assert found.pop((r.pid, r.i)) == pytest.approx(r.v, abs=1e-9)
            assert all(abs(v) < 1e-9 for v in found.values())


def test_an_objective_ends_its_search(spark):
    f = op.Objective(spark.range(1), lambda a: (F.lit(0.0) + a) * a, stop=lambda x, g: abs(x[0]) < 1)
    assert 0.3 < abs(op.GradientDescent(step=0.1).minimise(f, [4.0]).optimum[0]) < 1


def test_opaque_fields_with_nulls(spark):
    f = fl.ScalarField(fl.opaque(lambda x: np.sqrt(x)), 1)
    rows = spark.createDataFrame([(4.0,), (None,), (float("nan"),)], "x double").select(f(F.col("x")).alias("v")).collect()
    assert rows[0].v == 2 and all(r.v is None or np.isnan(r.v) for r in rows[1:])
    assert [r.v for r in spark.range(3).select(fl.ScalarField(fl.opaque(lambda x: 7.0), 1)(F.col("id")).alias("v")).collect()] == [7.0] * 3


def test_hubs_are_paired_in_blocks(spark, monkeypatch):
    """The same neighbours as by all pairs: hubs, parallel cells, loops, repeated cells and null nodes."""
    monkeypatch.setattr(ms, "HUB", 7)
    rng = np.random.default_rng(9)
    cells = [(k, 0, int(rng.integers(1, 30))) for k in range(60)] + [(100 + k, int(rng.integers(0, 40)), int(rng.integers(0, 40))) for k in range(60)]
    cells += [(300, 5, 5), (301, 5, 5), (302, None, 3), (303, None, 4), (304, 8, None), cells[0], cells[3]]
    found = ms.network_adjacency(spark.createDataFrame(cells, "cell_id long, v0 long, v1 long")).collect()
    ends = {c: {v for v in vs if v is not None} for c, *vs in cells}
    want = sorted((a, b) for a in ends for b in ends if a != b and ends[a] & ends[b])
    assert sorted((r.cell_id, r.neighbor_id) for r in found) == want
    incidence = ms.network_incidence(spark.createDataFrame(list(dict.fromkeys(cells)), "cell_id long, v0 long, v1 long")).collect()
    assert sorted((r.cell_id, r.node_id) for r in incidence) == sorted((c, v) for c, vs in ends.items() for v in vs)


#: The first rows of the cubic spline mass and bilaplacian matrices on [0, 2] in ten cells, by three Gauss nodes each.
SPLINE_MASS = [
    [0.0285, 0.017625, 0.003625, 0.00025, 0, 0, 0, 0],
    [0.017625, 0.0440625, 0.031375, 0.006875, 0.0000625, 0, 0, 0],
    [0.003625, 0.031375, 0.065270833333, 0.044958333333, 0.004729166667, 0.000041666667, 0, 0],
    [0.00025, 0.006875, 0.044958333333, 0.095833333333, 0.047291666667, 0.00475, 0.000041666667, 0],
    [0, 0.0000625, 0.004729166667, 0.047291666667, 0.095833333333, 0.047291666667, 0.00475, 0.000041666667],
]
SPLINE_BILAPLACIAN = [
    [1500, -2062.5, 437.5, 125, 0, 0, 0, 0],
    [-2062.5, 3000, -843.75, -125, 31.25, 0, 0, 0],
    [437.5, -843.75, 562.5, -166.666666667, -10.416666667, 20.833333333, 0, 0],
    [125, -125, -166.666666667, 333.333333333, -187.5, 0, 20.833333333, 0],
    [0, 31.25, -10.416666667, -187.5, 333.333333333, -187.5, 0, 20.833333333],
]


def test_spline_matrices_have_the_known_values(spark):
    knots = [k / 5 for k in range(11)]
    splines = ba.Splines(knots, 3)
    spans = spark.createDataFrame(list(zip(knots[:-1], knots[1:], strict=True)), "a double, b double")
    for operator, known in ((asm.reaction(1.0), SPLINE_MASS), (-asm.bilaplacian(), SPLINE_BILAPLACIAN)):
        m = np.zeros((13, 13))
        for r in asm.assemble_splines(operator, splines, spans).df.collect():
            m[r.row, r.col] += r.value
        scale = np.abs(known).max()
        assert np.allclose(m[:5, :8], known, atol=1e-9 * scale) and np.allclose(m[::-1, ::-1][:5, :8], known, atol=1e-9 * scale)
        assert np.allclose(m, m.T)


def test_lattices_with_holes(spark):
    """Squares and cubes are cut where all corners are there."""
    flat = spark.range(20).where("id <> 6").selectExpr("id AS node_id", "id % 5 * 1D AS x", "floor(id / 5) * 1D AS y")
    cells = ms.lattice(flat, 5).cells.collect()
    squares = {(c.cell_id // 2) for c in cells}
    assert squares == {s for s in range(12) if not {s // 4 * 5 + s % 4 + d for d in (0, 1, 5, 6)} & {6}} and len(cells) == 2 * len(squares)
    solid = ms.lattice(spark.range(24).selectExpr("id AS node_id", "id % 3 * 1D AS x", "floor(id / 3) % 4 * 1D AS y", "floor(id / 12) * 1D AS z"), 3, 4)
    assert solid.order == 3 and solid.cells.count() == 6 * 2 * 3
    assert solid.cells.selectExpr("min(cell_id)", "max(cell_id)").first()[:] == (0, 35)
    volume = solid.geometry().select(solid.simplex().measure().alias("m")).agg({"m": "sum"}).first()[0]
    assert abs(volume - 6) < 1e-9


@pytest.mark.parametrize("n_cols", [1, 63, 64, 65, 200])
def test_packed_words(spark, n_cols):
    """Bits in words against arrays: ends of words, the sign bit, blocks at odd columns, empty matrices."""
    rng = np.random.default_rng(n_cols)
    a, b = rng.random((5, n_cols)) < 0.4, rng.random((5, n_cols)) < 0.6
    a[0], a[1], b[2] = True, False, True
    cells = lambda m: [(int(i), int(j)) for i, j in zip(*np.nonzero(m), strict=True)]
    of = lambda m: bt.packed(spark.createDataFrame([*cells(m), *cells(m)[:3], (9, 0), (0, n_cols), (None, 0)], "row long, col long"), 5, n_cols)
    x, y = of(a), of(b)
    found = lambda w: sorted((r.row, r.col) for r in w.cells().collect())
    for got, want in ((x, a), (x & y, a & b), (x | y, a | b), (x ^ y, a ^ b), (~x, ~a), (x.clear(y), a & ~b)):
        assert found(got) == cells(want)
    for row, col, h, w in ((1, 0, 3, n_cols), (0, n_cols // 3, 5, n_cols - n_cols // 3), (2, n_cols - 1, 2, 1)):
        assert found(x.block(row, col, h, w)) == cells(a[row : row + h, col : col + w])
    assert x.summary().first()[:] == (a.sum(), False, True) and (x | ~x).summary().first()[:] == (5 * n_cols, True, True)
    assert {r.row: r.n for r in x.row_counts().collect()} == {i: int(s) for i, s in enumerate(a.sum(1)) if s}
    assert (x & ~x).summary().first()[:] == (0, False, False)


def test_spline_queries_beyond_the_last_knot(spark, tmp_path):
    """Events beyond the knots, on either side, count as in the SQL of both queries."""
    import duckdb

    from fieldloom import queries as library

    rows = [(i, 250 * x) for i, x in enumerate([-0.75, -0.25, 0.0, 0.3, 1.0, 2.0, 2.24084, 2.5, 7.0])]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("spline_linear", "spline_expand"):
        found = sorted(map(tuple, library.QUERIES[name](spark, str(tmp_path)).collect()))
        assert found == sorted(con.execute(library.SQL[name]).fetchall()), name


def test_complements_of_packed_words_are_not_made(spark):
    """A matrix of 10 ** 12 cells and its complement: counts and operations take the words that are stored."""
    n = 1_000_000
    of = lambda cells: bt.packed(spark.createDataFrame(cells, "row long, col long"), n, n)
    a, b = of([(0, 0), (0, n - 1), (5, 70)]), of([(0, 0), (7, 7)])
    cells = lambda w: sorted(map(tuple, w.cells().collect()))
    one = lambda w: tuple(w.summary().first())
    assert one(~a) == (n * n - 3, False, True) and one(a | ~a) == (n * n, True, True) and one(a & ~a) == (0, False, False)
    assert one(~a & ~b) == (n * n - 4, False, True) and one(~a | b) == (n * n - 2, False, True) and one(~a ^ b) == (n * n - 3, False, True)
    assert cells(a & ~b) == cells(~b & a) == cells(a.clear(b)) == [(0, n - 1), (5, 70)] and cells(~a ^ ~b) == [(0, n - 1), (5, 70), (7, 7)]
    assert one((~a).block(0, 0, 6, 100)) == (598, False, True) and len(cells((~a).block(5, 64, 1, 20))) == 19
    counts = {r.row: r.n for r in (~a).row_counts().where("row IN (0, 1, 5)").collect()}
    assert counts == {0: n - 2, 1: n, 5: n - 1}
