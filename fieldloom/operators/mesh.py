"""Mesh topology as relations: nodes, cells, and the edges, faces and neighbours that follow from them.

Defined cases: topology reads vertex ids alone, so null and NaN coordinates change none of it; ``geometry`` leaves out cells with a vertex that has no
node, and cells with a null coordinate have null geometry; cells with a null vertex have no sides there; repeated cell ids count as one cell with all
sides; an empty mesh has empty relations.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Simplex
from ..sources.shared import large
from .frame import ROW, number_rows

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Mesh:
    """``nodes`` (node_id, x[, y[, z]]) and ``cells`` (cell_id, v0, ..., vd) of local dimension d."""

    nodes: DataFrame
    cells: DataFrame
    order: int
    #: Whether the mesh grows with the input, so that its relations are ``large``.
    grows: bool = False

    @property
    def axes(self) -> list[str]:
        return [a for a in AXES if a in self.nodes.columns]

    @property
    def vertices(self) -> list[str]:
        return [f"v{i}" for i in range(self.order + 1)]

    def is_manifold(self) -> bool:
        return self.order < len(self.axes)

    def is_network(self) -> bool:
        return (self.order, len(self.axes)) == (1, 2)

    def is_2d(self) -> bool:
        return (self.order, len(self.axes)) == (2, 2)

    def is_surface(self) -> bool:
        return (self.order, len(self.axes)) == (2, 3)

    def is_3d(self) -> bool:
        return (self.order, len(self.axes)) == (3, 3)

    def per_cell(self) -> dict[str, int]:
        """Vertices, edges, facets and (but for networks, where they vary) neighbours of a cell."""
        d = self.order
        counts = {"vertices": d + 1, "edges": (d + 1) * d // 2, "facets": d + 1}
        return counts if self.is_network() else counts | {"neighbors": d + 1}

    def range(self) -> DataFrame:
        """Counts and the bounding box of the nodes."""
        box = [f(a).alias(f"{n}_{a}") for a in self.axes for n, f in (("min", F.min), ("max", F.max))]
        return self.nodes.agg(F.count("*").alias("n_nodes"), *box)

    def geometry(self) -> DataFrame:
        """cells with the coordinates of their vertices (x0, y0, ..., x1, ...)."""
        long = self.cells.select("cell_id", F.posexplode(F.array(*self.vertices)).alias("k", "node_id"))
        point = F.struct(*self.axes)
        by_cell = long.join(self.nodes, "node_id").groupBy("cell_id").agg(*[F.min(F.when(F.col("k") == k, point)).alias(f"p{k}") for k in range(self.order + 1)])
        coordinates = [F.col(f"p{k}.{a}").alias(f"{a}{k}") for k in range(self.order + 1) for a in self.axes]
        found = self.cells.join(by_cell.select("cell_id", *coordinates), "cell_id")
        return large(found) if self.grows else found

    def simplex(self) -> Simplex:
        """The cell of a row of ``geometry``."""
        return Simplex([[F.col(f"{a}{k}") for a in self.axes] for k in range(self.order + 1)])

    def sides(self, size: int) -> DataFrame:
        """cell_id, side (its place in the cell) and s0 < s1 < ... of all sub-simplices with ``size`` vertices."""
        parts = [F.array_sort(F.array(*c)) for c in combinations(self.vertices, size)]
        rows = self.cells.select("cell_id", F.posexplode(F.array(*parts)).alias("side", "s"))
        return rows.select("cell_id", "side", *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(size)])

    def _numbered(self, size: int) -> DataFrame:
        """The different sides, numbered in the order in which cells first meet them, with their first and last cell."""
        keys = [f"s{i}" for i in range(size)]
        met = self.sides(size).groupBy(*keys).agg(F.min(F.struct("cell_id", "side")).alias("first"), F.min("cell_id").alias("cell_a"), F.max("cell_id").alias("cell_b"), F.count("*").alias("n_cells"))
        flat = met.select(*keys, F.col("first.cell_id").alias("_c"), F.col("first.side").alias("_s"), "cell_a", F.when(F.col("n_cells") > 1, F.col("cell_b")).otherwise(F.lit(-1)).alias("cell_b"), "n_cells")
        return number_rows(flat, "_c", "_s").drop("_c", "_s")

    def facets(self) -> DataFrame:
        """facet_id, s0.., cell_a, cell_b (-1 on the boundary), on_boundary: sides of one dimension less than the cells."""
        return self._numbered(self.order).select(F.col(ROW).alias("facet_id"), *[f"s{i}" for i in range(self.order)], "cell_a", "cell_b", (F.col("n_cells") == 1).alias("on_boundary"))

    def edges(self) -> DataFrame:
        """edge_id, n0 < n1, cell_a, cell_b, n_cells, on_boundary (of solids: both end nodes are on the boundary)."""
        found = self._numbered(2).select(F.col(ROW).alias("edge_id"), F.col("s0").alias("n0"), F.col("s1").alias("n1"), "cell_a", "cell_b", "n_cells")
        if self.order < 3:
            return found.withColumn("on_boundary", F.col("n_cells") == 1)
        flags = self.boundary_nodes().withColumn("hit", F.lit(True))
        for n in ("n0", "n1"):
            found = found.join(flags.select(F.col("node_id").alias(n), F.col("hit").alias(f"{n}_hit")), n, "left")
        return found.withColumn("on_boundary", F.coalesce(F.col("n0_hit") & F.col("n1_hit"), F.lit(False))).drop("n0_hit", "n1_hit")

    def cell_edges(self, edges: DataFrame | None = None) -> DataFrame:
        """cell_id, side, edge_id; ``edges``: those of ``edges``, where they are there already."""
        edges = (self.edges() if edges is None else edges).select("edge_id", F.col("n0").alias("s0"), F.col("n1").alias("s1"))
        return self.sides(2).join(edges, ["s0", "s1"]).select("cell_id", "side", "edge_id")

    def cell_facets(self) -> DataFrame:
        """cell_id, side, facet_id: of solids the faces of each cell."""
        keys = [f"s{i}" for i in range(self.order)]
        return self.sides(self.order).join(self.facets().select("facet_id", *keys), keys).select("cell_id", "side", "facet_id")

    def facet_cells(self) -> DataFrame:
        """facet_id, cell_id: the one or two cells of each facet."""
        ends = F.filter(F.array("cell_a", "cell_b"), lambda c: c >= 0)
        return self.facets().select("facet_id", F.explode(F.array_distinct(ends)).alias("cell_id"))

    def facet_edges(self) -> DataFrame:
        """facet_id, side, edge_id: of solids the three edges of each face."""
        pairs = [F.array(f"s{i}", f"s{j}") for i, j in combinations(range(self.order), 2)]
        rows = self.facets().select("facet_id", F.posexplode(F.array(*pairs)).alias("side", "s")).select("facet_id", "side", F.get("s", F.lit(0)).alias("n0"), F.get("s", F.lit(1)).alias("n1"))
        return rows.join(self.edges().select("edge_id", "n0", "n1"), ["n0", "n1"]).select("facet_id", "side", "edge_id")

    def edge_cells(self) -> DataFrame:
        """edge_id, cell_id: all cells around each edge."""
        return self.cell_edges().select("edge_id", "cell_id")

    def neighbors(self) -> DataFrame:
        """cell_id, opposite (the vertex that the shared facet leaves out), neighbor_id (-1: none)."""
        keys = [f"s{i}" for i in range(self.order)]
        sides = self.sides(self.order).withColumn("opposite", self.order - F.col("side"))
        both = sides.groupBy(*keys).agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b"), F.collect_list(F.struct("cell_id", "opposite")).alias("own"))
        rows = both.select("a", "b", F.explode("own").alias("o"))
        other = F.when(F.col("a") == F.col("b"), F.lit(-1)).otherwise(F.col("a") + F.col("b") - F.col("o.cell_id"))
        return rows.select(F.col("o.cell_id").alias("cell_id"), F.col("o.opposite").alias("opposite"), other.alias("neighbor_id"))

    def boundary_facets(self) -> DataFrame:
        keys = [f"s{i}" for i in range(self.order)]
        return self.sides(self.order).groupBy(*keys).agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id")).where("n = 1").drop("n")

    def boundary_nodes(self) -> DataFrame:
        keys = F.array(*[f"s{i}" for i in range(self.order)])
        return self.boundary_facets().select(F.explode(keys).alias("node_id")).distinct()

    def boundary_cells(self) -> DataFrame:
        """Cells of which at least d vertices are on the boundary."""
        long = self.cells.select("cell_id", F.explode(F.array(*self.vertices)).alias("node_id"))
        return long.join(self.boundary_nodes(), "node_id").groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= self.order).select("cell_id")

    def node_patch(self) -> DataFrame:
        """node_id, cell_id: the cells around each node."""
        return self.cells.select(F.explode(F.array(*self.vertices)).alias("node_id"), "cell_id")

    def surface(self) -> Mesh:
        """The boundary facets of a solid as a mesh of their own; nodes are numbered anew, in the order in which facets first meet them."""
        facets = number_rows(self.facets().where("on_boundary"), "facet_id").withColumnRenamed(ROW, "new_cell")
        keys = [f"s{i}" for i in range(self.order)]
        long = facets.select("new_cell", F.posexplode(F.array(*keys)).alias("k", "node_id"))
        first = number_rows(long.groupBy("node_id").agg(F.min(F.struct("new_cell", "k")).alias("first")).select("node_id", "first.new_cell", "first.k"), "new_cell", "k")
        ids = first.select("node_id", F.col(ROW).alias("new_node"))
        cells = long.join(ids, "node_id").groupBy(F.col("new_cell").alias("cell_id")).agg(*[F.min(F.when(F.col("k") == k, F.col("new_node"))).alias(f"v{k}") for k in range(self.order)])
        nodes = self.nodes.join(ids, "node_id").select(F.col("new_node").alias("node_id"), *self.axes)
        return Mesh(nodes, cells, self.order - 1, self.grows)


def square(spark: SparkSession, n: int) -> Mesh:
    """The unit square in n x n squares of two triangles each."""
    i, m = F.col("id"), n + 1
    nodes = spark.range(m * m).select(i.alias("node_id"), ((i % m) / float(n)).alias("x"), (F.floor(i / m) / float(n)).alias("y"))
    k = F.floor(i / 2).cast("bigint")
    a = F.floor(k / n).cast("bigint") * m + k % n
    low = i % 2 == 0
    cells = spark.range(2 * n * n).select(i.alias("cell_id"), a.alias("v0"), F.when(low, a + 1).otherwise(a + n + 2).alias("v1"), F.when(low, a + n + 2).otherwise(a + n + 1).alias("v2"))
    return Mesh(nodes, cells, 2)


#: Six tetrahedra of a unit cube, as corners x + 2 y + 4 z: one for each order of the axes.
CUBE = [(0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7)]


def cube(spark: SparkSession, n: int) -> Mesh:
    """The unit cube in n x n x n cubes of six tetrahedra each."""
    i, m = F.col("id"), n + 1
    nodes = spark.range(m**3).select(i.alias("node_id"), ((i % m) / float(n)).alias("x"), ((F.floor(i / m) % m) / float(n)).alias("y"), (F.floor(i / (m * m)) / float(n)).alias("z"))
    corner = (i % n) + (F.floor(i / n) % n) * m + F.floor(i / (n * n)) * m * m
    ids = [[(corner + (c & 1) + (c >> 1 & 1) * m + (c >> 2) * m * m).cast("bigint") for c in t] for t in CUBE]
    tets = F.array(*[F.struct(*[v.alias(f"v{k}") for k, v in enumerate(t)]) for t in ids])
    cells = spark.range(n**3).select(i, F.posexplode(tets).alias("t", "c")).select((i * 6 + F.col("t")).alias("cell_id"), "c.*")
    return Mesh(nodes, cells, 3)


def lattice(nodes: DataFrame, *widths: int) -> Mesh:
    """Triangles, or with two widths tetrahedra, of ``nodes`` (node_id, x, y[, z]) whose ids count along rows of ``widths[0]`` nodes (and layers of ``widths[1]`` rows).

    A square or cube is cut where all its corners are there, so missing nodes leave holes and the last row may be short. Nodes with a null id have no cells.
    """
    nodes = large(nodes)
    w, *more = widths
    i, d = F.col("base"), len(widths) + 1
    steps = [1, w, *([w * more[0]] if more else [])]
    offset = lambda c: sum(steps[k] for k in range(d) if c >> k & 1)
    bases = nodes.select(F.explode(F.array(*[(F.col("node_id") - offset(c)).cast("bigint") for c in range(1 << d)])).alias("base"))
    inner = (i >= 0) & (i % w < w - 1)
    place = F.floor(i / w).cast("bigint") * (w - 1) + i % w
    if more:
        row = F.floor(i / w).cast("bigint") % more[0]
        inner = inner & (row < more[0] - 1)
        place = (F.floor(i / (w * more[0])).cast("bigint") * (more[0] - 1) + row) * (w - 1) + i % w
    whole = bases.where(inner).groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") == 1 << d)
    shapes = CUBE if more else [(0, 1, 3), (0, 3, 2)]
    cut = F.array(*[F.struct(*[(i + offset(c)).alias(f"v{k}") for k, c in enumerate(shape)]) for shape in shapes])
    cells = whole.select(place.alias("place"), F.posexplode(cut).alias("t", "c")).select((F.col("place") * len(shapes) + F.col("t")).alias("cell_id"), "c.*")
    return Mesh(nodes, large(cells), d, grows=True)


def interval(spark: SparkSession, a: float, b: float, n: int) -> Mesh:
    """[a, b] in n cells of the same length."""
    i = F.col("id")
    nodes = spark.range(n + 1).select(i.alias("node_id"), (F.lit(float(a)) + i * ((b - a) / n)).alias("x"))
    return Mesh(nodes, spark.range(n).select(i.alias("cell_id"), i.alias("v0"), (i + 1).alias("v1")), 1)


def interval_of(nodes: DataFrame) -> Mesh:
    """Cells between consecutive nodes (node_id from 0 in the order of x)."""
    nodes = large(nodes)
    after = nodes.select((F.col("node_id") - 1).alias("node_id")).where("node_id >= 0")
    return Mesh(nodes, after.select(F.col("node_id").alias("cell_id"), F.col("node_id").alias("v0"), (F.col("node_id") + 1).alias("v1")), 1, grows=True)


#: Cells of a block at a node of a network.
HUB = 256


def network_incidence(cells: DataFrame) -> DataFrame:
    """node_id, cell_id of a network (cell_id, v0, v1): the relation from which adjacency follows, two rows for each cell, whatever the hubs."""
    return cells.select(F.explode(F.array_distinct(F.array("v0", "v1"))).alias("node_id"), "cell_id").where("node_id IS NOT NULL")


def network_adjacency(cells: DataFrame) -> DataFrame:
    """cell_id, neighbor_id of a network (cell_id, v0, v1): cells that share a node, both ways, each once.

    The pairs of a hub are made in a triangle of blocks of HUB cells, so no task has all of them. Two cells with both nodes in common are a pair at the smaller
    one only; so no pair is made twice, and pairs aren't shuffled to tell them apart. Repeated cells count once; null nodes are shared with nobody.
    """
    kept = cells.select("cell_id", "v0", "v1").distinct()
    ends = kept.select("cell_id", F.explode(F.array_distinct(F.array("v0", "v1"))).alias("node_id"), "v0", "v1").where("node_id IS NOT NULL")
    # a cell with both its ends at one node has no other
    ends = ends.select("cell_id", "node_id", F.when(F.col("v0") == F.col("node_id"), F.col("v1")).otherwise(F.col("v0")).alias("far"))
    degree = ends.groupBy("node_id").agg(F.ceil(F.count("*") / F.lit(HUB)).cast("int").alias("blocks"))
    # hubs alone are copied to all salts, so that the ends of one are spread
    hubs = degree.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    placed = ends.withColumn("salt", F.pmod(F.xxhash64("cell_id"), F.lit(32)).cast("int")).join(hubs, ["node_id", "salt"], "left")
    placed = placed.select("cell_id", "node_id", "far", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("cell_id", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    dealt = placed.withColumn("at", other).select("cell_id", "node_id", "far", "block", "at.i", "at.j")
    right = dealt.select(F.col("cell_id").alias("neighbor_id"), "node_id", F.col("far").alias("far_b"), F.col("block").alias("block_b"), "i", "j")
    once = ((F.col("i") == F.col("j")) | (F.col("block") != F.col("block_b"))) & (F.col("cell_id") != F.col("neighbor_id"))
    both = F.col("far").eqNullSafe(F.col("far_b")) & F.col("far").isNotNull()
    pairs = dealt.join(right, ["node_id", "i", "j"]).where(once & (~both | (F.col("node_id") <= F.col("far"))))
    return pairs.select("cell_id", "neighbor_id")


def clockwise(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """A key whose ascending order runs clockwise around a centre, from the direction of negative x."""
    return -F.atan2(y - cy, x - cx)
