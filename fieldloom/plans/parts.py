"""Meshes stored in parts: geometry, sides, integrals and local matrices are made where the cells lie, and only what parts have in common is shuffled.

Cells go to parts of equal size along a space-filling curve and are stored with the coordinates of their vertices (the halo: a vertex on a border is copied to every cell
around it), in buckets by part. So sums within a part need no exchange. ``border`` has a bit for each vertex of a cell that cells of other parts have, too: a side or a
matrix entry all of whose vertices are such may have to be summed over parts; these alone are, and they grow like the borders of the parts.

Defined cases: as of ``mesh.Mesh.geometry`` (cells of which no vertex has a node are left out, null coordinates give null geometry and add nothing); cells without a finite centre come first on the
curve; repeated cells count as often as they are there; an empty mesh has empty relations and matrices of zeros.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Simplex
from ..operators.coo import Coo
from ..operators.frame import ROW, number_rows
from ..operators.mesh import Mesh
from ..operators.spatial import box_of, usable
from ..sources.shared import new_path
from .assembly import Operator, entries, tabulated
from .basis import Lagrange
from .factor import curve_key
from .quadrature import quadrature_rows, rule

#: Cells of a part, cells of a bucket where parts are smaller (they share buckets), and buckets of a stored mesh at most.
PART, BUCKET, MOST_BUCKETS = 50_000, 50_000, 20_000


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


@dataclass(frozen=True)
class PartedMesh:
    """``cells`` (part, cell_id, v0, ..., x0, y0, ..., border) of local dimension ``order`` over ``axes``, and ``nodes`` as in a mesh."""

    nodes: DataFrame
    cells: DataFrame
    order: int
    axes: list[str]

    @property
    def vertices(self) -> list[str]:
        return [f"v{i}" for i in range(self.order + 1)]

    def geometry(self) -> DataFrame:
        """The cells with the coordinates of their vertices, as they are stored."""
        return self.cells

    def simplex(self) -> Simplex:
        return Simplex([[F.col(f"{a}{k}") for a in self.axes] for k in range(self.order + 1)])

    def sides(self, size: int) -> DataFrame:
        """part, cell_id, side, s0 < s1 < ... of all sub-simplices with ``size`` vertices, and whether other parts may have them (shared)."""
        combos = list(combinations(range(self.order + 1), size))
        shared = [F.col("border").bitwiseAND(F.lit(m)) == m for m in (sum(1 << k for k in c) for c in combos)]
        parts = [F.struct(F.lit(n).alias("side"), F.array_sort(F.array(*[f"v{k}" for k in c])).alias("s"), own.alias("shared")) for n, (c, own) in enumerate(zip(combos, shared, strict=True))]
        rows = self.cells.select("part", "cell_id", "border", F.explode(F.array(*parts)).alias("e"))
        return rows.select("part", "cell_id", "e.side", *[F.get("e.s", F.lit(i)).alias(f"s{i}") for i in range(size)], "e.shared", "border")

    def _by_side(self, size: int, *sums: Column) -> DataFrame:
        """``sums`` over the cells around each different side: within parts, and over parts for shared ones."""
        keys, sides = [f"s{i}" for i in range(size)], self.sides(size)
        inner = sides.where("NOT shared").groupBy("part", *keys).agg(*sums).drop("part")
        return inner.unionByName(sides.where((F.bit_count("border") >= size) & F.col("shared")).groupBy(*keys).agg(*sums))

    def edges(self) -> DataFrame:
        """n0 < n1, cell_a, cell_b (-1: none; the last of all cells around it) and n_cells, without numbers."""
        found = self._by_side(2, F.min("cell_id").alias("cell_a"), F.max("cell_id").alias("_last"), F.count("*").alias("n_cells"))
        return found.select(F.col("s0").alias("n0"), F.col("s1").alias("n1"), "cell_a", F.when(F.col("n_cells") > 1, F.col("_last")).otherwise(F.lit(-1)).alias("cell_b"), "n_cells")

    def boundary_facets(self) -> DataFrame:
        """s0 < s1 < ... and cell_id of the facets of one cell."""
        return self._by_side(self.order, F.count("*").alias("n"), F.min("cell_id").alias("cell_id")).where("n = 1").drop("n")

    def neighbors(self) -> DataFrame:
        """cell_id, opposite (the vertex that the shared facet leaves out), neighbor_id (-1: none)."""
        own = F.collect_list(F.struct("cell_id", (self.order - F.col("side")).alias("opposite"))).alias("own")  # at most two cells at a facet
        rows = self._by_side(self.order, F.min("cell_id").alias("a"), F.max("cell_id").alias("b"), own).select("a", "b", F.explode("own").alias("o"))
        other = F.when(F.col("a") == F.col("b"), F.lit(-1)).otherwise(F.col("a") + F.col("b") - F.col("o.cell_id"))
        return rows.select(F.col("o.cell_id").alias("cell_id"), F.col("o.opposite").alias("opposite"), other.alias("neighbor_id"))


def in_parts(mesh: Mesh, size: int = PART) -> PartedMesh:
    """``mesh`` stored in parts of ``size`` cells, as a bucketed table of the session's catalog over the shared folder."""
    axes, order, spark = mesh.axes, mesh.order, mesh.nodes.sparkSession
    _, box = box_of(mesh.nodes.where(usable(axes)), axes)
    middle = {f"_m{a}": reduce(lambda x, y: x + y, [F.col(f"{a}{k}") for k in range(order + 1)]) / (order + 1) for a in axes}
    key = F.when(usable(list(middle)), curve_key(dict(zip(middle, box, strict=True)))).otherwise(F.lit(-1))
    numbered = number_rows(mesh.geometry().withColumns(middle).withColumn("_key", key), "_key", "cell_id")
    cells = numbered.withColumn("part", F.floor(F.col(ROW) / size).cast("bigint"))
    long = cells.select("part", F.col(ROW).alias("_at"), F.posexplode(F.array(*mesh.vertices)).alias("k", "node_id"))
    border = long.groupBy("node_id").agg((F.min("part") < F.max("part")).alias("b")).where("b").select("node_id")
    bits = long.join(border, "node_id").groupBy(F.col("_at").alias(ROW)).agg(F.bit_or(_bit(F.col("k"))).alias("border"))
    fat = cells.join(bits, ROW, "left").select(
        "part", "cell_id", *mesh.vertices, *[f"{a}{k}" for k in range(order + 1) for a in axes], F.coalesce("border", F.lit(0)).alias("border")
    )
    n = numbered.count()
    # each is a file and a task of every query, so their number is that of the cells, not of small parts
    buckets = max(1, min(MOST_BUCKETS, -(-n // size), max(spark.sparkContext.defaultParallelism, -(-n // BUCKET))))
    name = f"parts_{uuid.uuid4().hex}"
    # each bucket is written by one task, as one file
    fat.repartition(buckets, "part").write.bucketBy(buckets, "part").sortBy("part").option("path", new_path(spark, "parts")).saveAsTable(name)
    return PartedMesh(mesh.nodes, spark.table(name), order, axes)


def assemble_in_parts(operator: Operator, mesh: PartedMesh) -> Coo:
    """As ``assembly.assemble`` with elements of order 1: entries within a part are summed there, those between border nodes over parts; of symmetric operators a triangle is, and mirrored."""
    rows, phi, grad, x = tabulated(Lagrange(mesh), ("part", "border", *mesh.vertices))
    local = rows.select("part", "border", *mesh.vertices, F.explode(F.array(*entries(operator, mesh.order + 1, phi, grad, x))).alias("e"))
    vertex = lambda k: F.get(F.array(*mesh.vertices), F.col(f"e.{k}"))
    a, b = vertex("i"), vertex("j")
    if operator.is_symmetric:
        a, b = F.greatest(a, b), F.least(a, b)
    mask = _bit(F.col("e.i")).bitwiseOR(_bit(F.col("e.j")))
    shared = F.col("border").bitwiseAND(mask) == mask
    add = F.sum("v").alias("value")
    pick = lambda df: df.select("part", a.alias("row"), b.alias("col"), F.col("e.v").alias("v"))
    inner = pick(local.where(~shared)).groupBy("part", "row", "col").agg(add).drop("part")
    summed = inner.unionByName(pick(local.where((F.col("border") > 0) & shared)).groupBy("row", "col").agg(add))
    if operator.is_symmetric:
        both = F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col")))
        summed = summed.select(F.explode(F.when(F.col("row") == F.col("col"), F.slice(both, 1, 1)).otherwise(both)).alias("p"), "value").select("p.*", "value")
    n = mesh.nodes.count()
    return Coo(summed, n, n)


def integrate_in_parts(mesh: PartedMesh, f: Callable[..., Column], order: int = 1, nodes: int | None = None) -> DataFrame:
    """part, n_cells and the integral of a field over each part."""
    rows = quadrature_rows(mesh.geometry(), mesh, rule(mesh.order, order, nodes))
    value = F.col("w") * F.col("measure") * f(*[F.col(a) for a in mesh.axes])
    return rows.groupBy("part").agg(F.count_if(F.col("iq") == 0).alias("n_cells"), F.sum(value).alias("integral"))
