"""Quadrature over simplices and intervals: cells joined to a literal table of nodes and weights.

Defined cases: cells with a null coordinate add nothing to an integral and have a null one of their own, NaN stays NaN; given values without a node of the mesh, or nodes without a value, are left out; an empty mesh has a null integral.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import apply, plus
from ..operators.mesh import Mesh

# Nodes (reference coordinates) and weights (of sum one) of the rules, by dimension and number of nodes.
SIMPLEX: dict[tuple[int, int], list[tuple[tuple[float, ...], float]]] = {
    (1, 2): [((0.211324865405187,), 0.5), ((0.788675134594812,), 0.5)],
    (1, 3): [((0.112701665379258,), 0.277777777777778), ((0.5,), 0.444444444444444), ((0.887298334620741,), 0.277777777777778)],
    (2, 1): [((0.333333333333333, 0.333333333333333), 1.0)],
    (2, 3): [((0.166666666666667, 0.166666666666667), 0.333333333333333), ((0.666666666666667, 0.166666666666667), 0.333333333333333), ((0.166666666666667, 0.666666666666667), 0.333333333333333)],
    (2, 6): [
        ((0.445948490915965, 0.445948490915965), 0.223381589678011), ((0.445948490915965, 0.108103018168070), 0.223381589678011), ((0.108103018168070, 0.445948490915965), 0.223381589678011),
        ((0.091576213509771, 0.091576213509771), 0.109951743655322), ((0.091576213509771, 0.816847572980459), 0.109951743655322), ((0.816847572980459, 0.091576213509771), 0.109951743655322),
    ],
    (2, 7): [
        ((0.333333333333333, 0.333333333333333), 0.225), ((0.101286507323456, 0.101286507323456), 0.125939180544827), ((0.101286507323456, 0.797426985353087), 0.125939180544827),
        ((0.797426985353087, 0.101286507323456), 0.125939180544827), ((0.470142064105115, 0.470142064105115), 0.132394152788506), ((0.470142064105115, 0.059715871789770), 0.132394152788506),
        ((0.059715871789770, 0.470142064105115), 0.132394152788506),
    ],
    (2, 12): [
        ((0.873821971016996, 0.063089014491502), 0.050844906370207), ((0.063089014491502, 0.873821971016996), 0.050844906370207), ((0.063089014491502, 0.063089014491502), 0.050844906370207),
        ((0.501426509658179, 0.249286745170910), 0.116786275726379), ((0.249286745170910, 0.501426509658179), 0.116786275726379), ((0.249286745170910, 0.249286745170910), 0.116786275726379),
        ((0.636502499121399, 0.310352451033785), 0.082851075618374), ((0.636502499121399, 0.053145049844816), 0.082851075618374), ((0.310352451033785, 0.636502499121399), 0.082851075618374),
        ((0.310352451033785, 0.053145049844816), 0.082851075618374), ((0.053145049844816, 0.636502499121399), 0.082851075618374), ((0.053145049844816, 0.310352451033785), 0.082851075618374),
    ],
    (3, 1): [((0.25, 0.25, 0.25), 1.0)],
    (3, 4): [
        ((0.585410196624969, 0.138196601125011, 0.138196601125011), 0.25), ((0.138196601125011, 0.138196601125011, 0.138196601125011), 0.25),
        ((0.138196601125011, 0.138196601125011, 0.585410196624969), 0.25), ((0.138196601125011, 0.585410196624969, 0.138196601125011), 0.25),
    ],
    (3, 5): [
        ((0.25, 0.25, 0.25), -0.8), ((0.5, 0.166666666666667, 0.166666666666667), 0.45), ((0.166666666666667, 0.5, 0.166666666666667), 0.45),
        ((0.166666666666667, 0.166666666666667, 0.5), 0.45), ((0.166666666666667, 0.166666666666667, 0.166666666666667), 0.45),
    ],
    (3, 11): [
        ((0.25, 0.25, 0.25), -0.0789333333333333), ((0.7857142857142857, 0.0714285714285714, 0.0714285714285714), 0.0457333333333333),
        ((0.0714285714285714, 0.0714285714285714, 0.0714285714285714), 0.0457333333333333), ((0.0714285714285714, 0.0714285714285714, 0.7857142857142857), 0.0457333333333333),
        ((0.0714285714285714, 0.7857142857142857, 0.0714285714285714), 0.0457333333333333), ((0.1005964238332008, 0.3994035761667992, 0.3994035761667992), 0.1493333333333333),
        ((0.3994035761667992, 0.1005964238332008, 0.3994035761667992), 0.1493333333333333), ((0.3994035761667992, 0.3994035761667992, 0.1005964238332008), 0.1493333333333333),
        ((0.3994035761667992, 0.1005964238332008, 0.1005964238332008), 0.1493333333333333), ((0.1005964238332008, 0.3994035761667992, 0.1005964238332008), 0.1493333333333333),
        ((0.1005964238332008, 0.1005964238332008, 0.3994035761667992), 0.1493333333333333),
    ],
}
#: Gauss-Legendre rules on [-1, 1].
LEGENDRE: dict[int, list[tuple[float, float]]] = {
    3: [(-0.774596669241483, 0.555555555555555), (0.0, 0.888888888888888), (0.774596669241483, 0.555555555555555)],
    5: [(-0.906179845938664, 0.236926885056189), (-0.538469310105683, 0.478628670499366), (0.0, 0.568888888888889), (0.538469310105683, 0.478628670499366), (0.906179845938664, 0.236926885056189)],
}
#: Nodes of the rule that elements of an order (1, 2, else) take, by dimension.
BY_ORDER = {1: (2, 3, 3), 2: (3, 6, 12), 3: (4, 5, 5)}


def rule(dimension: int, order: int = 1, nodes: int | None = None) -> list[tuple[tuple[float, ...], float]]:
    return SIMPLEX[dimension, nodes or BY_ORDER[dimension][min(order, 3) - 1]]


def quadrature_rows(cells: DataFrame, mesh: Mesh, nodes: list[tuple[tuple[float, ...], float]]) -> DataFrame:
    """``cells`` (rows of mesh.geometry()) once for each node: iq, qnode_id, q0.. (reference), x.. (physical), w and measure."""
    table = F.array(*[F.struct(F.lit(i).alias("iq"), *[F.lit(v).alias(f"q{k}") for k, v in enumerate(q)], F.lit(w).alias("w")) for i, (q, w) in enumerate(nodes)])
    simplex = mesh.simplex()
    rows = cells.withColumn("measure", simplex.measure()).withColumn("_q", F.explode(table)).select("*", "_q.*").drop("_q")
    x = plus(simplex.vertices[0], apply(simplex.jacobian(), [F.col(f"q{k}") for k in range(mesh.order)]))
    return rows.withColumn("qnode_id", F.col("cell_id") * len(nodes) + F.col("iq")).withColumns({a: c for a, c in zip(mesh.axes, x, strict=True)})


def quadrature_nodes(mesh: Mesh, nodes: list[tuple[tuple[float, ...], float]]) -> DataFrame:
    """qnode_id and its coordinates."""
    return quadrature_rows(mesh.geometry(), mesh, nodes).select("qnode_id", *mesh.axes)


def integrate_cells(mesh: Mesh, f: Callable[..., Column] | str, order: int = 1, nodes: int | None = None, data: DataFrame | None = None) -> DataFrame:
    """cell_id, integral of a field, or of the column ``f`` of ``data`` (qnode_id, ...)."""
    rows = quadrature_rows(mesh.geometry(), mesh, rule(mesh.order, order, nodes))
    if data is not None:
        rows = rows.join(data, "qnode_id")
    value = F.col(f) if isinstance(f, str) else f(*[F.col(a) for a in mesh.axes])
    return rows.groupBy("cell_id").agg(F.sum(F.col("w") * F.col("measure") * value).alias("integral"))


def integrate(mesh: Mesh, f: Callable[..., Column] | str, order: int = 1, nodes: int | None = None, data: DataFrame | None = None) -> DataFrame:
    """One row: the integral over the mesh."""
    return integrate_cells(mesh, f, order, nodes, data).agg(F.sum("integral").alias("integral"))


def interval_rows(intervals: DataFrame, nodes: Sequence[tuple[float, float]] = tuple(LEGENDRE[3]), a: str = "a", b: str = "b") -> DataFrame:
    """``intervals`` once for each node of a rule on [-1, 1]: iq, x and w (with half the length in it)."""
    table = F.array(*[F.struct(F.lit(i).alias("iq"), F.lit(q).alias("q"), F.lit(w).alias("gw")) for i, (q, w) in enumerate(nodes)])
    half = (F.col(b) - F.col(a)) / 2
    rows = intervals.withColumn("_q", F.explode(table))
    return rows.withColumns({"iq": F.col("_q.iq"), "x": half * F.col("_q.q") + (F.col(a) + F.col(b)) / 2, "w": half * F.col("_q.gw")}).drop("_q")


