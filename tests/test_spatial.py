"""Searches against all pairs: nulls, NaN, repeated ids, crowded and far points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import mesh as ms
from fieldloom.operators import spatial as sp

NAN = float("nan")


def points_of(spark, rows, key="pid"):
    return spark.createDataFrame([(int(i), None if x is None else float(x), None if y is None else float(y)) for i, x, y in rows], f"{key} long, x double, y double")


def crowd():
    """A dense cluster, a line, one place many times, and a few points far away."""
    rng = np.random.default_rng(0)
    xy = np.vstack([rng.normal(size=(400, 2)) * 1e-3, np.c_[np.linspace(0, 9, 60), np.zeros(60)], np.tile([[5.0, 5.0]], (90, 1)), [[1000.0, -1000.0], [-50.0, 3.0]]])
    return [(i, *p) for i, p in enumerate(xy.tolist())]


def plain_nearest(q, points):
    if q[1] is None or q[2] is None or math.isnan(q[1]) or math.isnan(q[2]):
        return None, None
    sound = [p for p in points if None not in p and not any(map(math.isnan, p[1:]))]
    return min((((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, p[0]) for p in sound), default=(None, None))[::-1]


@pytest.mark.parametrize("h", [None, 0.5])
def test_nearest_against_all_pairs(spark, h):
    rng = np.random.default_rng(1)
    points = [*crowd(), (900, None, 1.0), (901, NAN, 0.0), (902, 3.0, NAN)]
    queries = [(i, *p) for i, p in enumerate(rng.uniform(-2, 10, (40, 2)).tolist())] + [(50, 1e5, 1e5), (51, None, 0.0), (52, 0.0, NAN), (53, 5.0, 5.0), (54, 0.0, 0.0), (54, 9.0, 0.0), (None or 55, -1e4, 7.0)]
    found = sp.nearest(points_of(spark, queries, "qid"), points_of(spark, points), h).collect()
    plain = [(q[0], *plain_nearest(q, points)) for q in queries]
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    assert [(a[0], a[1]) for a in sorted(map(tuple, found), key=key)] == [(a[0], a[1]) for a in sorted(plain, key=key)]
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(plain, key=key), strict=True):
        assert a[2] is None if b[2] is None else math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-15)


def test_nearest_of_nothing(spark):
    q, p = points_of(spark, [(1, 0, 0), (2, None, 0)], "qid"), points_of(spark, [(1, 1, 1), (2, NAN, 0)])
    assert sorted((r.qid, r.pid) for r in sp.nearest(q, p.limit(0)).collect()) == [(1, None), (2, None)]
    assert sorted((r.qid, r.pid) for r in sp.nearest(q, p.where("pid = 2")).collect()) == [(1, None), (2, None)]
    assert sp.nearest(q.limit(0), p).collect() == []
    assert sp.nearest(q.where("x IS NULL"), p).first().pid is None


def test_bins_of_a_crowd_hold_few(spark):
    points = points_of(spark, [p for p in crowd() if p[0] < 460 or p[0] > 548])
    h = sp.bin_width(points, ("x", "y"))
    most = points.groupBy(sp.bin_of(points["x"], h), sp.bin_of(points["y"], h)).count().agg({"count": "max"}).first()[0]
    assert most <= sp.FULL


@pytest.mark.parametrize("search", [sp.nearest_vectors, sp.nearest_by_pivots])
@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_vectors_against_all_pairs(spark, monkeypatch, block, search):
    monkeypatch.setattr(sp, "BLOCK", block)
    v = np.random.default_rng(3).normal(size=(30, 4))
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(40, None)]
    df = spark.createDataFrame(rows, "a long, v array<double>")
    found = {r.a: (r.b, r.d2) for r in search(df.where("a % 5 = 0"), df.withColumnRenamed("a", "b"), "a", "b", "v").collect()}
    assert set(found) == {0, 5, 10, 15, 20, 25}
    for i, (j, d2) in found.items():
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        assert j == d.argmin() and np.isclose(d2, d.min())


def test_pairs_of_vectors_are_no_rows(spark):
    """Pairs are compared block by block in tasks, not joined and sorted; components that aren't there add nothing."""
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [9.0, 2.0]), (3, [1.0, 2.5, 7.0]), (4, []), (5, [NAN, 0.0]), (10, [float("inf"), 2.0])]
    df = spark.createDataFrame(rows, "a long, v array<float>")
    found = sp.nearest_vectors(df.where("a % 5 = 0"), df.withColumnRenamed("a", "b"), "a", "b", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Join" not in plan
    assert sorted((r.a, r.b, repr(r.d2)) for r in found.collect()) == [(0, 1, "0.0"), (5, 0, "nan"), (10, 0, "inf")]


def vectors_found(spark, rows, every=5):
    df = spark.createDataFrame(rows, "a long, v array<double>")
    return {r.a: r for r in sp.nearest_by_pivots(df.where(f"a % {every} = 0"), df.withColumnRenamed("a", "b"), "a", "b", "v").collect()}


def test_pivots_skip_and_stay_exact(spark, monkeypatch):
    """Vectors in groups: rings of other groups are skipped."""
    monkeypatch.setattr(sp, "BLOCK", 16)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(25, 8))[rng.integers(0, 25, 1500)] * 10 + rng.normal(size=(1500, 8)) * 0.1
    v[100:140] = v[100]
    found = vectors_found(spark, list(enumerate(v.tolist())))
    assert len(found) == 300
    for i, r in found.items():
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        assert r.b == d.argmin() and np.isclose(r.d2, d.min())
    assert sum(r.n_compared for r in found.values()) < 0.2 * 300 * 1500


def test_pivots_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 2)
    rows = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, None), (5, [NAN, 1.0]), (10, [1.0, None]), (15, [1e200, 0.0]), (16, [1e200, 1e200]), (20, [1.0]), (25, [1.0, 2.0, 3.0]), (26, [1.0, 2.0, 4.0]), (30, []), (35, [0.0, 0.0])]
    found = vectors_found(spark, rows)
    assert {i: (r.b, r.d2) for i, r in found.items()} == {0: (35, 0.0), 35: (0, 0.0), 15: (0, float("inf")), 25: (26, 1.0)}
    # ties go to the smallest id, and repeated queries are answered each
    df = spark.createDataFrame([(9, [1.0]), (7, [1.0]), (8, [1.0])], "b long, v array<double>")
    q = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "a long, v array<double>")
    assert sorted((r.a, r.b, r.d2) for r in sp.nearest_by_pivots(q, df, "a", "b", "v").collect()) == [(1, 7, 0.0), (1, 7, 1.0)]
    assert sp.nearest_by_pivots(q, df.limit(0), "a", "b", "v").count() == 0 and sp.nearest_by_pivots(q.limit(0), df, "a", "b", "v").count() == 0


def test_range_join_against_all_pairs(spark):
    points = [*crowd(), (900, None, 1.0), (901, NAN, 0.0)]
    boxes = [(1, -1.0, -1.0, 1.0, 1.0), (2, 4.9, 4.9, 5.0, 5.0), (3, 0.0, 0.0, 0.0, 0.0), (4, 2.0, 2.0, 1.0, 1.0), (5, NAN, 0.0, 1.0, 1.0), (6, None, 0.0, 1.0, 1.0), (7, -60.0, -10.0, 20.0, 10.0)]
    found = sorted(map(tuple, sp.range_join(points_of(spark, points), spark.createDataFrame(boxes, "box_id int, lx double, ly double, ux double, uy double")).collect()))
    sound = [p for p in points if None not in p and NAN not in p]
    plain = sorted((b[0], p[0]) for b in boxes if None not in b and not any(map(math.isnan, b)) for p in sound if b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4] and not math.isnan(p[1]))
    assert found == plain
    assert sp.range_join(points_of(spark, points), spark.createDataFrame([], "box_id int, lx double, ly double, ux double, uy double")).collect() == []


def test_projection_against_all_cells(spark):
    """A mesh of two squares apart: points inside, between, on the border and far away, null and repeated ones."""
    nodes = [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 10, 0), (5, 12, 0), (6, 12, 2), (7, 10, 2), (8, 5, 5)]  # node 8 is in no cell
    cells = [(0, 0, 1, 2), (1, 0, 2, 3), (2, 4, 5, 6), (3, 4, 6, 7)]
    mesh = ms.Mesh(spark.createDataFrame([(i, float(x), float(y)) for i, x, y in nodes], "node_id long, x double, y double"), spark.createDataFrame(cells, "cell_id long, v0 long, v1 long, v2 long"), 2)
    rng = np.random.default_rng(4)
    points = [(i, *p) for i, p in enumerate(rng.uniform(-3, 15, (60, 2)).tolist())] + [(70, 5.0, 5.0), (71, 1e4, -1e4), (72, None, 1.0), (73, 1.0, NAN), (74, 0.5, 0.5), (74, 20.0, 1.0)]
    found = sorted((r.pid, r.d2 if r.d2 is not None else -1.0) for r in sp.project(points_of(spark, points), mesh).collect())

    def plain(x, y):
        if x is None or math.isnan(x) or math.isnan(y):
            return -1.0
        box = lambda a, b, c, d: max(a - x, x - c, 0) ** 2 + max(b - y, y - d, 0) ** 2
        return min(box(0, 0, 1, 1), box(10, 0, 12, 2))

    assert np.allclose(np.array(found), np.array(sorted((i, plain(x, y)) for i, x, y in points)))
    assert {r.cell_id for r in sp.project(points_of(spark, points[:3]), ms.Mesh(mesh.nodes, mesh.cells.limit(0), 2)).collect()} == {None}


def test_no_plan_has_all_pairs(spark):
    p = points_of(spark, [(1, 0, 0)])
    for df in (sp.nearest(p.withColumnRenamed("pid", "qid"), p), sp.project(p, ms.square(spark, 2)), sp.range_join(p, spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "box_id int, lx double, ly double, ux double, uy double"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nearest_with_infinite_and_huge_coordinates(spark):
    inf = math.inf
    points = [*crowd()[:40], (900, inf, 0.0), (901, 0.0, -inf), (902, 1e300, 1e300), (903, -1e300, 2.0), (904, 1e200, -1e200)]
    queries = [(1, inf, 1.0), (2, 1.0, -inf), (3, 1e300, 0.9e300), (4, -0.9e300, 5.0), (5, 1e200, 0.0), (6, 0.0, 0.0), (7, 1e120, 0.0), (8, 3e-4, 1e-4)]
    found = {r.qid: r.pid for r in sp.nearest(points_of(spark, queries, "qid"), points_of(spark, points)).collect()}
    finite = [p for p in points if all(map(math.isfinite, p[1:]))]
    want = {q[0]: min((math.hypot(p[1] - q[1], p[2] - q[2]), p[0]) for p in finite)[1] if all(map(math.isfinite, q[1:])) else None for q in queries}
    assert found == want


def test_boxes_of_all_sizes(spark):
    """Each box on the grid of its own size: the same pairs as all with all, and cells in proportion to boxes."""
    rng = np.random.default_rng(8)
    points = [(i, *p) for i, p in enumerate(rng.uniform(0, 1, (300, 2)).tolist())] + [(400, None, 0.5), (401, math.inf, 0.5), (402, NAN, 0.5), (403, 0.25, 0.25)]
    corner = rng.uniform(0, 1, (500, 2))
    side = 10.0 ** rng.uniform(-7, 0.5, (500, 2))
    side[:20] = 0
    corner[:20] = [p[1:] for p in points[:20]]
    boxes = [(i, *c, *(c + s)) for i, (c, s) in enumerate(zip(corner, side, strict=True))] + [(600, 0.0, 0.0, math.inf, 1.0), (601, 0.9, 0.9, 0.1, 0.1), (602, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *[None if x is None else float(x) for x in b]) for i, *b in boxes], "box_id long, lx double, ly double, ux double, uy double")
    want = sorted((b[0], p[0]) for b in boxes[:500] for p in points if p[1] is not None and b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4])
    assert sorted((r.box_id, r.pid) for r in sp.range_join(points_of(spark, points), df).collect()) == want
    assert sorted((r.box_id, r.pid) for r in sp.range_join(points_of(spark, points), df.where("ux - lx > 0.05 AND uy - ly > 0.05"), 0.5).collect()) == [w for w in want if min(side[w[0]]) > 0.05]
    many = spark.range(100_000).selectExpr("id AS box_id", "id % 317 / 317D AS lx", "id % 311 / 311D AS ly").selectExpr("*", "lx + CASE WHEN box_id < 10 THEN 1D ELSE 1e-6 END AS ux", "ly + CASE WHEN box_id < 10 THEN 1D ELSE 1e-6 END AS uy")
    assert sp._met(many, ("x", "y"), None, "l", "u").count() < 500_000


def test_location_on_a_graded_mesh(spark):
    """Cells of widths from 1 to 2 ** -20: no width is given."""
    xs = [0.0, *[2.0 ** -k for k in range(20, -1, -1)]]
    nodes = [(i * 2 + j, x, 1.0 * j) for i, x in enumerate(xs) for j in (0, 1)]
    cells = [(2 * i + k, *v) for i in range(len(xs) - 1) for k, v in enumerate([(2 * i, 2 * i + 2, 2 * i + 3), (2 * i, 2 * i + 3, 2 * i + 1)])]
    mesh = ms.Mesh(spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame(cells, "cell_id long, v0 long, v1 long, v2 long"), 2)
    rng = np.random.default_rng(5)
    at = [(i, 2.0 ** -rng.uniform(0, 22), rng.uniform()) for i in range(200)] + [(300, 2.0, 0.5), (301, math.inf, 0.5), (302, None, 0.5)]
    found = {r.pid: r.cell_id for r in sp.locate(points_of(spark, at), mesh).collect()}
    for pid, x, y in at:
        if x is None or x > 1:
            assert found[pid] == -1
        else:
            i = max(k for k in range(len(xs) - 1) if xs[k] <= x)
            assert found[pid] in (2 * i, 2 * i + 1)
            assert found[pid] % 2 == int(y > (x - xs[i]) / (xs[i + 1] - xs[i]))


def test_knots_as_a_table(spark):
    """The same cells as between knots of a list; many points of one place, equal knots, and no knots."""
    rng = np.random.default_rng(2)
    knots = sorted([*rng.integers(0, 40, 60).tolist(), 3, 3])
    points = [(i, float(x), 0.0) for i, x in enumerate(rng.uniform(-3, 43, 200))] + [(500 + i, 3.0, 0.0) for i in range(300)] + [(900, None, 0.0), (901, NAN, 0.0), (902, float(knots[-1]), 0.0), (903, float(knots[0]), 0.0)]
    df = points_of(spark, points)
    table = spark.createDataFrame([(float(k),) for k in rng.permutation(knots)] + [(None,), (math.inf,)], "u double")
    found = {r.pid: r.cell_id for r in sp.locate_knots(df.repartition(5), table).collect()}
    want = {r.pid: r.cell_id for r in sp.locate_interval(df.where("pid < 900 OR pid > 901"), [float(k) for k in knots]).collect()}
    assert found == want | {900: None, 901: None}
    assert {r.cell_id for r in sp.locate_knots(df.where("pid < 10"), table.limit(0)).collect()} == {-1}


def test_location_on_shared_sides(spark):
    """Cells are half-open in the direction of x, then y; the last sides belong to the cell of smallest id."""
    mesh = ms.square(spark, 4)
    at = [(5 * i + j, i / 4, j / 4) for i in range(5) for j in range(5)] + [(100 + i, i / 4, 0.3) for i in range(4)] + [(200 + i, 0.3, i / 4) for i in range(4)]
    found = {r.pid: r.cell_id for r in sp.locate(points_of(spark, at), mesh, 0.25).collect()}
    for pid, x, y in at:
        i, j = int(x * 4), int(y * 4)
        if i < 4 and j < 4:
            assert found[pid] == 2 * (4 * j + i) + int(y * 4 - j > x * 4 - i)
    assert found[24] == 30 and found[4] == 25


def test_queries_of_customers_on_shared_sides(spark, tmp_path):
    """Balances that put customers on the sides between cells give what the SQL of these queries gives."""
    import duckdb

    from fieldloom import queries as library

    sf = "/root/testdata/sf0.001"
    balance = (687.5 * (F.col("c_custkey") % 16) - 1000).alias("c_acctbal")
    spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_acctbal", balance).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("flagship", "locate_cell", "psi_point_p1", "psi_point_p2"):
        found = sorted(map(tuple, library.QUERIES[name](spark, str(tmp_path)).collect()))
        assert found == sorted(con.execute(library.SQL[name]).fetchall()), name


def test_range_join_is_dealt_by_its_pairs(spark, monkeypatch):
    """Points and boxes of one place: few rows, but many pairs, are cut in blocks for as many tasks; each pair comes once."""
    monkeypatch.setattr(sp, "PAIRS", 1000)
    points = spark.createDataFrame([(i, 0.5, 0.5) for i in range(200)], "pid long, x double, y double")
    boxes = spark.createDataFrame([(i, 0.4, 0.4, 0.6, 0.6) for i in range(50)], "box_id long, lx double, ly double, ux double, uy double")
    found = sp.range_join(points, boxes)
    assert found.rdd.getNumPartitions() >= 10 and max(map(len, found.rdd.glom().collect())) <= 4000
    assert sorted(map(tuple, found.collect())) == [(b, p) for b in range(50) for p in range(200)]


def test_crowded_bins_are_cut(spark, monkeypatch):
    """Rows of one bin go to blocks of CROWD rows about, and each still meets all of the other side; projection and nearest neighbours are the same."""
    monkeypatch.setattr(sp, "CROWD", 100)
    left = spark.range(3000).select(F.col("id").alias("_q"), F.when(F.col("id") < 2950, 0).otherwise(F.col("id")).alias("_b"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2950, "c")], "_b long, name string")
    a, b, keys = sp._spread(left, right, "_q", ["_b"])
    assert a.groupBy(*keys).count().agg(F.max("count")).first()[0] < 200
    assert sorted(tuple(r) for r in a.join(b, keys).groupBy("name").count().collect()) == [("a", 2950), ("b", 2950), ("c", 1)]
    points = spark.range(400).select(F.col("id").alias("pid"), (0.3 + F.col("id") / 4000).alias("x"), (-0.5 - F.col("id") / 4000).alias("y"))
    found = sp.project(points, ms.square(spark, 2)).agg(F.count("*"), F.max(F.abs(F.col("px") - (0.3 + F.col("pid") / 4000))), F.max(F.abs(F.col("py"))), F.max(F.abs(F.sqrt("d2") - 0.5 - F.col("pid") / 4000))).first()
    assert found[0] == 400 and max(found[1:]) < 1e-9
