"""Sparse factors by nested dissection: a system is factorised once, part by part, and solved for many right sides.

Unknowns are dealt to parts along a space-filling curve, and parts are the leaves of a tree in which FAN nodes meet at each step up. An
unknown with a neighbour in another part is kept until the node where both parts meet. A node eliminates the unknowns that nobody above
it needs, by a small dense inverse, and hands what is left of its rows and columns (its boundary) to the node above. So all nodes
of a level are worked on at the same time, each by one task; a level is one shuffle and one written table, and levels grow with the logarithm of the
unknowns. Leaves are most of the unknowns, and their inverses would be many times the matrix: they keep their few entries and solve with them anew. Of symmetric
matrices the tables hold lower triangles. A solution goes up and down these tables with the right sides, all of them at once, and is held against the matrix.

A front (the unknowns of a node and its boundary) grows like the border of a part: on meshes of the plane with the root of the unknowns. Where one is
larger than ``MOST_FRONT``, ``FrontTooLarge`` is raised, and an iteration is the way (``solve.solve``).

Defined cases: entries of one place add up, null values are zeros, entries with an index outside of the matrix are left out; right sides without an entry are
zero; unknowns without a place come first on the curve; a singular matrix raises ``Singular``; an empty system has an empty solution.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.coo import Coo
from ..operators.frame import ROW, number_rows
from ..sources.shared import scratch, written

#: Unknowns of a part, nodes that meet in one above (a power of two), the largest front (8 bytes for each pair of its unknowns).
LEAF, BITS, MOST_FRONT = 800, 2, 6000
FAN = 1 << BITS
#: Largest residual of a solution, relative to its right side, before and after one correction.
CLOSE, WRONG = 1e-10, 1e-6

NODE = "node bigint, own binary, bound binary, heights binary, front binary, inverse binary, right binary, left binary, rest binary"
#: An entry of a leaf's front.
ENTRY = np.dtype([("i", "<i4"), ("j", "<i4"), ("v", "<f8")])
VALUES = "node bigint, idx bigint, own boolean, v array<double>"


class FrontTooLarge(RuntimeError):
    """A front of the factors doesn't fit a task."""


class Singular(RuntimeError):
    """A matrix without an inverse, or too near to one."""


def curve_key(axes: dict[str, tuple[float, float]], bits: int = 20) -> Column:
    """Place on a Z-order curve over the box of ``axes`` (low, high), the bits of the axes in turn.

    The longest side scales all axes, so a strip is first cut across, and the borders of its parts are as short as it is narrow.
    """
    out = F.lit(0).cast("bigint")
    side = max([high - low for low, high in axes.values()], default=0.0) or 1.0
    for k, (name, (low, _)) in enumerate(axes.items()):
        q = F.floor((F.col(name) - low) / side * ((1 << bits) - 1)).cast("bigint")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1).cast("bigint")), b * len(axes) + k))
    return F.coalesce(out, F.lit(0).cast("bigint"))


def _parts(a: Coo, places: DataFrame | None, levels: int) -> DataFrame:
    """idx, leaf: every unknown's part, of which there are FAN ** levels with as many unknowns each."""
    every = a.df.sparkSession.range(a.n_rows).withColumnRenamed("id", "idx")
    leaf = lambda at: F.floor(at * float(FAN**levels) / a.n_rows).cast("bigint").alias("leaf")
    if places is None:
        return every.select("idx", leaf(F.col("idx")))
    axes = [c for c in places.columns if c != "idx"]
    box = places.agg(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))]).first()
    key = curve_key({c: (box[f"min_{c}"] or 0.0, box[f"max_{c}"] or 0.0) for c in axes})
    keyed = every.join(places.groupBy("idx").agg(F.min(key).alias("key")), "idx", "left").select("idx", F.coalesce("key", F.lit(-1)).alias("key"))
    return number_rows(keyed, "key", "idx").select("idx", leaf(F.col(ROW)))


def _heights(a: Coo, parts: DataFrame, levels: int) -> DataFrame:
    """idx, h, node: the level at which each unknown is eliminated, and the node there; of two neighbours in different parts the first waits for the node where these meet."""
    of = lambda name: parts.select(F.col("idx").alias(name), F.col("leaf").alias(f"{name}_leaf"))
    edges = a.df.select("row", "col").where("row <> col").join(of("row"), "row").join(of("col"), "col").where("row_leaf <> col_leaf")
    apart = F.col("row_leaf").bitwiseXOR(F.col("col_leaf"))
    meet = reduce(lambda x, y: x + y, [(apart >= FAN**k).cast("int") for k in range(max(levels, 1))])
    waits = edges.select(F.when(F.col("row_leaf") < F.col("col_leaf"), F.col("row")).otherwise(F.col("col")).alias("idx"), meet.alias("h")).groupBy("idx").agg(F.max("h").alias("h"))
    found = parts.join(waits, "idx", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    return found.select("idx", "h", F.expr(f"shiftright(leaf, {BITS} * h)").alias("node"))


def _numbers(raw: bytes, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(raw, kind)


def _packed(x: np.ndarray, symmetric: bool) -> np.ndarray:
    """A square matrix, or the lower triangle of a symmetric one."""
    return x[np.tri(len(x), dtype=bool)] if symmetric else x


def _square(v: np.ndarray, n: int, symmetric: bool) -> np.ndarray:
    if not symmetric:
        return v.reshape(n, n)
    x = np.zeros((n, n))
    x[np.tri(n, dtype=bool)] = v
    return x + np.tril(x, -1).T


def _eliminate(level: int, symmetric: bool):
    """The work of a node: its entries and what its nodes below hand up, in one dense front."""

    def run(entries: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        node = int((entries if len(entries) else below)["node"].iloc[0])
        fronts = [(_numbers(b, "<i8"), _numbers(h, "<i8"), _numbers(s)) for b, h, s in zip(below["bound"], below["heights"], below["rest"], strict=True)]
        ids = np.concatenate([entries["row"], entries["col"], *[b for b, _, _ in fronts]]).astype(np.int64)
        heights = np.concatenate([entries["h_row"], entries["h_col"], *[h for _, h, _ in fronts]]).astype(np.int64)
        ids, first = np.unique(ids, return_index=True)
        heights = heights[first]
        if len(ids) > MOST_FRONT:
            raise FrontTooLarge(f"a front of {len(ids)} unknowns")
        order = np.r_[np.flatnonzero(heights == level), np.flatnonzero(heights != level)]
        n, place = int((heights == level).sum()), np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at = lambda x: place[np.searchsorted(ids, x)]
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (at(entries["row"].to_numpy()), at(entries["col"].to_numpy())), entries["value"].to_numpy())
        for b, _, s in fronts:
            p = at(b)
            m[np.ix_(p, p)] += _square(s, len(b), symmetric)
        front, none = np.zeros(0, ENTRY), np.zeros((0, 0))
        inverse, left = none, none
        try:
            if level:
                inverse = np.linalg.inv(m[:n, :n])
                right = inverse @ m[:n, n:]
            else:
                # with one column at least, so that a singular matrix is seen
                right = np.linalg.solve(m[:n, :n], np.c_[m[:n, n:], np.zeros(n)])[:, :-1]
        except np.linalg.LinAlgError:
            raise Singular(f"no inverse at level {level}") from None
        rest = m[n:, n:] - m[n:, :n] @ right
        if level:
            left = none if symmetric else m[n:, :n] @ inverse
            inverse = _packed(inverse, symmetric)
        else:
            i, j = np.nonzero(np.tril(m) if symmetric else m)
            front, right = np.empty(len(i), ENTRY), none
            front["i"], front["j"], front["v"] = i, j, m[i, j]
        pack = lambda x, kind="<f8": np.ascontiguousarray(x).astype(kind).tobytes()
        ids, heights = ids[order], heights[order]
        row = (node, pack(ids[:n], "<i8"), pack(ids[n:], "<i8"), pack(heights[n:], "<i8"), front.tobytes(), pack(inverse), pack(right), pack(left), pack(_packed(rest, symmetric)))
        return pd.DataFrame([row], columns=[c.split()[0] for c in NODE.split(", ")])

    return run


def _shape(f: pd.DataFrame, symmetric: bool) -> tuple:
    """A node's own unknowns and its boundary; what right sides of its own add to the boundary, and its own solution from right sides and boundary."""
    r = f.iloc[0]
    own, bound = _numbers(r["own"], "<i8"), _numbers(r["bound"], "<i8")
    n, k = len(own), len(bound)
    if front := r["front"]:
        m, e = np.zeros((n + k, n + k)), np.frombuffer(front, ENTRY)
        m[e["i"], e["j"]] = e["v"]
        if symmetric:
            m[e["j"], e["i"]] = e["v"]
        inner, to, of = m[:n, :n], m[n:, :n], m[:n, n:]
        return own, bound, lambda t: to @ np.linalg.solve(inner, t), lambda t, x: np.linalg.solve(inner, t - of @ x)
    right = _numbers(r["right"]).reshape(n, k)
    left = right.T if symmetric else _numbers(r["left"]).reshape(k, n)
    return own, bound, lambda t: left @ t, lambda t, x: _square(_numbers(r["inverse"]), n, symmetric) @ t - right @ x


def _values(node: int, ids: np.ndarray, own: int, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"node": node, "idx": ids, "own": np.arange(len(ids)) < own, "v": pd.Series(list(v), dtype=object)})


def _up(symmetric: bool):
    """Right sides of a node's own unknowns with what the nodes below add; what it adds to its boundary."""

    def run(factor: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        own, bound, added, _ = _shape(factor, symmetric)
        v = np.stack(values["v"].to_numpy()) if len(values) else np.zeros((0, 1))
        ids = np.r_[own, bound]
        order = np.argsort(ids)
        t = np.zeros((len(ids), v.shape[1]))
        if len(v):
            np.add.at(t, order[np.searchsorted(ids[order], values["idx"].to_numpy())], v)
        n = len(own)
        t[n:] -= added(t[:n])
        return _values(int(factor["node"].iloc[0]), ids, n, t)

    return run


def _down(symmetric: bool):
    """A node's own unknowns, from its right sides and the solution on its boundary."""

    def run(factor: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        own, bound, _, solution = _shape(factor, symmetric)
        n, ids = len(own), np.r_[own, bound]
        order = np.argsort(ids)
        known = ids[order]
        idx = values["idx"].to_numpy()
        at = np.minimum(np.searchsorted(known, idx), len(known) - 1)
        # the node above sends all it knows, right sides are of the node's own
        hit = (known[at] == idx) & ((order[at] < n) == values["own"].to_numpy())
        v = np.stack(values["v"].to_numpy())
        t = np.zeros((len(ids), v.shape[1]))
        t[order[at[hit]]] = v[hit]
        t[:n] = solution(t[:n], t[n:])
        return _values(int(factor["node"].iloc[0]), ids, n, t)

    return run


def _raised(e: PythonException) -> Exception:
    for kind in (FrontTooLarge, Singular):
        if kind.__name__ in str(e):
            return kind(next((line.split(": ", 1)[-1] for line in str(e).splitlines() if kind.__name__ in line), ""))
    return e


@dataclass(frozen=True)
class Factors:
    """Written tables of a factorised matrix: where unknowns are eliminated, and the nodes of each level, the leaves first."""

    a: Coo
    symmetric: bool
    unknowns: DataFrame
    levels: list[DataFrame]

    def solve(self, b: DataFrame) -> DataFrame:
        """(idx, value), or of right sides with a column ``col`` (idx, col, value), of a x = b; all right sides go through together.

        The residual is tested; if it is over CLOSE of the right side, one correction follows, and if it is over WRONG then, ``Singular`` is raised.
        """
        many = "col" in b.columns
        b = b if many else b.withColumn("col", F.lit(0))
        keys = ["idx", "col", "value"] if many else ["idx", "value"]
        if not self.a.n_rows:
            return b.select(*keys).limit(0)
        with scratch(b.sparkSession, keep=1):
            b = written(b.where(F.col("idx").between(0, self.a.n_rows - 1)).groupBy("idx", "col").agg(F.sum("value").alias("value")), "right")
            x = self._through(b)
            off, size = self._residual(x, b)
            if off > CLOSE * size:
                x = written(x.unionByName(self._through(self._off(x, b))).groupBy("idx", "col").agg(F.sum("value").alias("value")), "corrected")
                if not self._residual(x, b)[0] <= WRONG * size:
                    raise Singular("the solution doesn't solve the system")
            return written(x.select(*keys), "solution")

    def _off(self, x: DataFrame, b: DataFrame) -> DataFrame:
        """idx, col, value of b - a x."""
        products = self.a.df.join(x.select(F.col("idx").alias("col"), F.col("col").alias("side"), F.col("value").alias("x")), "col").select(F.col("row").alias("idx"), F.col("side").alias("col"), (-F.col("value") * F.col("x")).alias("value"))
        return products.unionByName(b.select("idx", "col", "value")).groupBy("idx", "col").agg(F.sum("value").alias("value"))

    def _residual(self, x: DataFrame, b: DataFrame) -> tuple[float, float]:
        norm = lambda d: (d.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 0.0)
        return norm(self._off(x, b)), norm(b)

    def _through(self, b: DataFrame) -> DataFrame:
        """One way up and down with all right sides (idx, col, value) as arrays of one value for each."""
        sides = [r[0] for r in b.select("col").distinct().orderBy("col").collect()] or [0]
        of = F.map_from_entries(F.collect_list(F.struct("col", "value")))
        array = F.transform(F.array(*[F.lit(c) for c in sides]), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(0.0)))
        right = self.unknowns.join(b.groupBy("idx").agg(of.alias("m")).select("idx", array.alias("v")), "idx")
        right = written(right.select("h", "node", "idx", "v"), "sides")
        ups: list[DataFrame] = []
        # what went up to the level above stays where it is
        levels = [t.drop("heights", "rest") for t in self.levels]
        for h, factors in enumerate(levels):
            values = right.where(F.col("h") == h).select("node", "idx", "v")
            if ups:
                values = values.unionByName(ups[-1].where("NOT own").select(F.shiftright("node", BITS).alias("node"), "idx", "v"))
            ups.append(written(factors.groupBy("node").cogroup(values.groupBy("node")).applyInPandas(_up(self.symmetric), VALUES), "up"))
        found, out = None, []
        for h in range(len(levels) - 1, -1, -1):
            values = ups[h].where("own").select("node", "idx", "own", "v")
            if found is not None:
                children = F.explode(F.array(*[F.lit(c) for c in range(FAN)]))
                sent = found.select("node", "idx", F.lit(False).alias("own"), "v").withColumn("child", children)
                sent = sent.select((F.col("node") * FAN + F.col("child")).alias("node"), "idx", "own", "v").join(levels[h].select("node"), "node", "left_semi")
                values = values.unionByName(sent)
            found = written(levels[h].groupBy("node").cogroup(values.groupBy("node")).applyInPandas(_down(self.symmetric), VALUES), "down")
            out.append(found.where("own").select("idx", "v"))
        long = reduce(DataFrame.unionByName, out).select("idx", F.posexplode("v").alias("k", "value"))
        names = F.array(*[F.lit(c) for c in sides])
        return written(long.select("idx", F.get(names, F.col("k")).alias("col"), "value"), "values")


def factorise(a: Coo, places: DataFrame | None = None, symmetric: bool = True, leaf: int = LEAF) -> Factors:
    """Factors of a square matrix. ``places`` (idx, x[, y[, z]]) puts unknowns on the curve; without them their order is that of their numbers, which suits banded matrices."""
    if a.n_rows != a.n_cols:
        raise ValueError("a square matrix is needed")
    n, levels = a.n_rows, 0
    while leaf * FAN**levels < n:
        levels += 1
    inside = F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)
    if not n:
        empty = a.df.sparkSession.createDataFrame([], "row bigint, col bigint, value double")
        return Factors(Coo(empty, n, n), symmetric, empty, [])
    with scratch(a.df.sparkSession, keep=2):
        whole = Coo(written(a.df.where(inside).select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")), "system"), n, n)
        unknowns = written(_heights(whole, written(_parts(whole, places, levels), "parts"), levels), "unknowns")
        of = lambda name: unknowns.select(F.col("idx").alias(name), F.col("h").alias(f"h_{name}"), F.col("node").alias(f"node_{name}"))
        # each unknown is in its node, even where its row is empty
        zeros = unknowns.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(0.0).alias("value"))
        both = whole.df.unionByName(zeros).join(of("row"), "row").join(of("col"), "col")
        first = F.col("h_row") <= F.col("h_col")
        # from here on these are the matrix
        entries = written(both.select(F.least("h_row", "h_col").alias("h"), F.when(first, F.col("node_row")).otherwise(F.col("node_col")).alias("node"), "row", "col", "value", "h_row", "h_col"), "entries")
    tables: list[DataFrame] = []
    try:
        for h in range(levels + 1):
            own = entries.where(F.col("h") == h).drop("h")
            if tables:
                below = tables[-1].where(F.octet_length("bound") > 0).select(F.shiftright("node", BITS).alias("node"), "bound", "heights", "rest")
            else:
                below = own.sparkSession.createDataFrame([], "node bigint, bound binary, heights binary, rest binary")
            tables.append(written(own.groupBy("node").cogroup(below.groupBy("node")).applyInPandas(_eliminate(h, symmetric), NODE), "factors", "zstd"))
    except PythonException as e:
        raise _raised(e) from None
    return Factors(Coo(entries.select("row", "col", "value"), n, n), symmetric, unknowns, tables)
