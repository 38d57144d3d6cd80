"""Meshes stored in parts, against the same meshes in relations."""

import io
import re
from contextlib import redirect_stdout

import pytest

from fieldloom.operators import mesh as ms
from fieldloom.plans import assembly as asm
from fieldloom.plans import basis as ba
from fieldloom.plans import parts as pa
from fieldloom.plans import quadrature as qu


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


@pytest.mark.parametrize("solid", [False, True])
def test_sides_of_parts(spark, solid):
    mesh = ms.cube(spark, 3) if solid else ms.square(spark, 8)
    parted = pa.in_parts(mesh, 20)
    assert parted.cells.select("part").distinct().count() == (9 if solid else 7)
    assert parted.cells.groupBy("part").count().agg({"count": "max"}).first()[0] == 20
    for columns in [("n0", "n1", "cell_a", "cell_b", "n_cells")]:
        assert rows(parted.edges(), *columns) == rows(mesh.edges(), *columns)
    assert rows(parted.neighbors(), "cell_id", "opposite", "neighbor_id") == rows(mesh.neighbors(), "cell_id", "opposite", "neighbor_id")
    keys = [f"s{i}" for i in range(mesh.order)]
    assert rows(parted.boundary_facets(), *keys, "cell_id") == rows(mesh.boundary_facets(), *keys, "cell_id")


@pytest.mark.parametrize("operator", [asm.reaction(1.0), -asm.laplacian() + asm.advection([1.0, 2.0]), asm.diffusion([[2.0, 0.5], [0.5, 1.0]])])
@pytest.mark.parametrize("size", [1, 17, 1000])
def test_matrices_of_parts(spark, operator, size):
    mesh = ms.square(spark, 6)
    found, known = ({(r.row, r.col): r.value for r in m.df.collect()} for m in (pa.assemble_in_parts(operator, pa.in_parts(mesh, size)), asm.assemble(operator, ba.Lagrange(mesh))))
    assert found.keys() == known.keys() and all(abs(found[k] - known[k]) < 1e-12 for k in known)


def test_exchanges_of_parts(spark):
    """Only entries between border nodes are exchanged."""
    parted = pa.in_parts(ms.square(spark, 32), 256)
    df = pa.assemble_in_parts(asm.reaction(1.0), parted).df
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    plan = out.getvalue()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "hashpartitioning(row" in plan
    shared = parted.sides(1).where("shared").count()
    assert shared < parted.sides(1).count() / 3


def test_small_parts_share_buckets(spark):
    """Files and tasks are as many as the cells need, however small parts are."""
    parted = pa.in_parts(ms.square(spark, 32), 16)
    assert parted.cells.select("part").distinct().count() == 128
    assert parted.cells.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_integrals_and_defined_cases(spark):
    mesh = ms.square(spark, 5)
    found = pa.integrate_in_parts(pa.in_parts(mesh, 7), lambda x, y: x * y, 2).collect()
    assert sum(r.n_cells for r in found) == 50 and abs(sum(r.integral for r in found) - qu.integrate(mesh, lambda x, y: x * y, 2).first()[0]) < 1e-12
    empty = pa.in_parts(ms.Mesh(mesh.nodes.limit(0), mesh.cells.limit(0), 2), 7)
    assert empty.edges().count() == 0 and pa.assemble_in_parts(asm.reaction(1.0), empty).df.count() == 0
    odd = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, float("nan"), 1.0), (3, None, 1.0), (4, float("inf"), 0.0), (5, 1.0, 1.0)], "node_id bigint, x double, y double")
    cells = spark.createDataFrame([(0, 0, 1, 5), (1, 0, 1, 2), (2, 0, 1, 3), (3, 0, 1, 4)], "cell_id bigint, v0 bigint, v1 bigint, v2 bigint")
    parted = pa.in_parts(ms.Mesh(odd, cells, 2), 1)
    assert rows(parted.edges().where("n0 = 0 AND n1 = 1"), "cell_a", "cell_b", "n_cells") == [(0, 3, 4)]


def test_large_relations_stay_off_the_driver(spark):
    """Meshes of tables are small to Spark by the size of their files; their joins don't broadcast them all the same."""
    from fieldloom.operators import mesh as ms
    from fieldloom.operators import voronoi as vo
    from fieldloom.plans import assembly as asm
    from fieldloom.plans import basis as ba

    nodes = spark.range(100).selectExpr("id AS node_id", "id % 10 / 9D AS x", "floor(id / 10) / 9D AS y")
    mesh = ms.lattice(nodes, 10)
    stiff = asm.assemble(-asm.laplacian(), ba.Lagrange(mesh))
    for df in (mesh.geometry(), stiff.df, stiff.times(stiff).df, stiff.replace_rows(mesh.boundary_nodes().selectExpr("node_id AS row")).df, mesh.neighbors(), vo.sites(mesh)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, plan
    # one row for each partition is what numbers need
    plan = mesh.cell_edges()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1
