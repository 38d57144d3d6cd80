"""Voronoi diagrams that are dual to triangulations of the plane, and to intervals.

Defined cases: nodes without a cell of the mesh have no ring; cells with a null coordinate add no vertex; points with a null, NaN or infinite coordinate are in no cell; an empty mesh has no rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Simplex
from ..sources.shared import large
from .frame import ROW, number_rows
from .mesh import Mesh, clockwise
from .spatial import located, nearest, range_join, squared_distance


def vertices(mesh: Mesh) -> DataFrame:
    """kind (cell, edge or node), source_id, x, y, and the sites (node ids) whose cells the vertex bounds.

    Circumcenters of the cells; of boundary edges the projection of their cell's circumcenter; boundary nodes.
    """
    geometry = mesh.geometry()
    c = mesh.simplex().circumcenter()
    centres = geometry.select("cell_id", c[0].alias("x"), c[1].alias("y"), F.array(*mesh.vertices).alias("sites"))
    edges = mesh.edges().where("on_boundary").select("edge_id", "n0", "n1", F.col("cell_a").alias("cell_id"))
    for n in ("n0", "n1"):
        edges = edges.join(mesh.nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}")), n)
    segment = Simplex([[F.col("x_n0"), F.col("y_n0")], [F.col("x_n1"), F.col("y_n1")]])
    on = segment.nearest([F.col("x"), F.col("y")])
    feet = edges.join(centres.select("cell_id", "x", "y"), "cell_id").select(F.lit("edge").alias("kind"), F.col("edge_id").alias("source_id"), on[0].alias("x"), on[1].alias("y"), F.array("n0", "n1").alias("sites"))
    corners = mesh.nodes.join(mesh.boundary_nodes(), "node_id").select(F.lit("node").alias("kind"), F.col("node_id").alias("source_id"), "x", "y", F.array("node_id").alias("sites"))
    return centres.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("source_id"), "x", "y", "sites").unionByName(feet).unionByName(corners)


def cells(mesh: Mesh) -> DataFrame:
    """site, ring: the vertices (x, y) of each site's cell in clockwise order, equal ones once, around their mean."""
    long = vertices(mesh).select(F.explode("sites").alias("site"), "x", "y")
    middle = long.groupBy("site").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.collect_set(F.struct(F.round("x", 12).alias("x"), F.round("y", 12).alias("y"))).alias("points"))
    keyed = F.transform("points", lambda p: F.struct(clockwise(p["x"], p["y"], F.col("cx"), F.col("cy")).alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    return large(middle).select("site", F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def measures(rings: DataFrame) -> DataFrame:
    """site, measure: the area inside each ring."""
    r, n = F.col("ring"), F.size("ring")
    after = lambda i: F.get(r, (i + 1) % n)
    twice = F.aggregate(F.transform(r, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)
    return rings.select("site", (F.abs(twice) / 2).alias("measure"))


def edges(rings: DataFrame) -> DataFrame:
    """Different edges of all rings: their two ends in order."""
    r, n = F.col("ring"), F.size("ring")
    pair = F.transform(r, lambda p, i: F.array_sort(F.array(p, F.get(r, (i + 1) % n))))
    return rings.select(F.explode(pair).alias("e")).distinct().select(F.get("e", F.lit(0)).alias("a"), F.get("e", F.lit(1)).alias("b"))


def cell_edges(rings: DataFrame) -> DataFrame:
    """site, i, a, b: the i-th edge of each cell, from a vertex to the next one of its ring."""
    r, n = F.col("ring"), F.size("ring")
    pair = F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, (i + 1) % n).alias("b")))
    return rings.select("site", F.posexplode(pair).alias("i", "e")).select("site", "i", "e.a", "e.b")


def contains(rings: DataFrame, x: Column, y: Column, slack: float = 1e-9) -> DataFrame:
    """``rings`` with inside: whether each cell, its edges among it, holds the point (x, y): it is on the right of all edges, as rings run clockwise."""
    r, n = F.col("ring"), F.size("ring")
    after = lambda i: F.get(r, (i + 1) % n)
    turn = F.transform(r, lambda p, i: (after(i)["x"] - p["x"]) * (y - p["y"]) - (after(i)["y"] - p["y"]) * (x - p["x"]))
    return rings.withColumn("inside", F.coalesce(F.forall(turn, lambda t: t <= slack) & (n > 2), F.lit(False)))


def containing(points: DataFrame, rings: DataFrame, slack: float = 1e-9) -> DataFrame:
    """pid, site: the cells of ``rings`` that hold each of ``points`` (pid, x, y), their edges among them.

    Points meet the boxes around cells first, by grid cells, so work is in proportion to points and cells that are near each other. Points with a null or NaN are in none.
    """
    far = lambda pick, c: pick(F.transform("ring", lambda p: p[c]))
    boxes = rings.select("*", *[(far(F.array_min, c) - slack).alias(f"l{c}") for c in "xy"], *[(far(F.array_max, c) + slack).alias(f"u{c}") for c in "xy"])
    near = range_join(points, boxes.withColumnRenamed("site", "box_id"))
    pairs = near.join(large(points).select("pid", "x", "y").distinct(), "pid").join(rings.withColumnRenamed("site", "box_id"), "box_id")
    return contains(pairs, F.col("x"), F.col("y"), slack).where("inside").select("pid", F.col("box_id").alias("site"))


def sites(mesh: Mesh) -> DataFrame:
    """site, x, y, on_boundary: the nodes, and whether their cells reach the border of the mesh."""
    flags = mesh.boundary_nodes().withColumn("hit", F.lit(True))
    return mesh.nodes.join(flags, "node_id", "left").select(F.col("node_id").alias("site"), "x", "y", F.coalesce("hit", F.lit(False)).alias("on_boundary"))


def dual(mesh: Mesh) -> DataFrame:
    """site, neighbor: pairs of sites whose cells share an edge, both ways; these are the edges of the triangulation."""
    ends = mesh.edges().select("n0", "n1")
    return ends.select(F.col("n0").alias("site"), F.col("n1").alias("neighbor")).unionByName(ends.select(F.col("n1").alias("site"), F.col("n0").alias("neighbor")))


def locate(points: DataFrame, mesh: Mesh, h: float) -> DataFrame:
    """pid, node_id: the nearest vertex of the Delaunay cell that contains a point; of equal distances the first in the cell."""
    geometry = mesh.geometry()
    hits = located(points, mesh, h, geometry).select("pid", "cell_id")
    rows = large(points).join(hits, "pid").join(geometry, "cell_id")
    p = [F.col("x"), F.col("y")]
    options = [F.struct(squared_distance(p, [F.col(f"x{k}"), F.col(f"y{k}")]).alias("d2"), F.lit(k).alias("k"), F.col(f"v{k}").alias("node_id")) for k in range(mesh.order + 1)]
    return rows.select("pid", F.least(*options)["node_id"].alias("node_id"))


def intervals(sites: DataFrame, low: float, high: float) -> DataFrame:
    """site_id, x, a, b, measure: cells of sites (site_id, x) of an interval, between the midpoints.

    Neighbours are found by joins of dense row ids, so no task sees the whole line.
    """
    line = number_rows(sites.select("site_id", "x"), "x", "site_id")
    shifted = lambda d, name: line.select((F.col(ROW) + d).alias(ROW), F.col("x").alias(name))
    rows = line.join(shifted(1, "before"), ROW, "left").join(shifted(-1, "after"), ROW, "left")
    mid = lambda other: (F.col("x") + F.col(other)) / 2
    return rows.select("site_id", "x", F.coalesce(mid("before"), F.lit(float(low))).alias("a"), F.coalesce(mid("after"), F.lit(float(high))).alias("b")).withColumn("measure", F.col("b") - F.col("a"))


def locate_interval(points: DataFrame, sites: DataFrame) -> DataFrame:
    """pid, site_id, x: the site (site_id, x) of an interval whose cell holds each point (pid, x); on a midpoint that of the smaller id."""
    return nearest(points, sites, q_id="pid", p_id="site_id", axes=("x",)).select("pid", "site_id")
