"""Nearest neighbours, range queries, point location and projection: grid cells turn spatial joins into equi-joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Simplex
from ..functions.vectors import EPSILON, Vec
from ..sources.shared import large, scratch, written
from .frame import ROW, number_rows
from .mesh import Mesh

#: Points of a grid cell from which the width is cut, how often at most, and how many widths are counted in one pass; rows of a block where every query meets every point, points of a ring around a pivot.
FULL, CUTS, AT_ONCE, BLOCK = 64, 12, 4, 4096
#: Pairs of points and boxes that a task compares, about; rows of one bin that a task sorts.
PAIRS, CROWD = 10_000_000, 1 << 16
#: Pairs of vectors that are compared at once, whose distances stay in a core's cache.
AT_HAND = 1 << 16
#: Vectors of one length that others are ordered around; copies of what all queries read.
PIVOTS, SALTS = 32, 32
#: Bins beyond it are one bin.
LAST_BIN = 1 << 60
#: Extents from which squares of distances may be too large for doubles.
HUGE = 1e150


def bin_of(x: Column, h: float | Column) -> Column:
    """The bin of width ``h`` that holds ``x``; all that is farther than LAST_BIN bins from zero shares the last one."""
    return F.floor(F.greatest(F.least(x / h, F.lit(float(LAST_BIN))), F.lit(-float(LAST_BIN)))).cast("bigint")


def squared_distance(a: Vec, b: Vec) -> Column:
    out = (a[0] - b[0]) * (a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + (x - y) * (x - y)
    return out


def usable(names: Sequence[str]) -> Column:
    """Whether all coordinates are finite numbers."""
    out = F.lit(True)
    for n in names:
        # NaN is larger than infinity here
        out = out & F.coalesce(F.abs(F.col(n).cast("double")) < F.lit(float("inf")), F.lit(False))
    return out


def distance(a: Vec, b: Vec) -> Column:
    """As the root of ``squared_distance``, where squares may be too large for doubles."""
    sides = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    most = F.greatest(*sides) if len(sides) > 1 else sides[0]
    return F.when(most == 0, 0.0).otherwise(most * F.sqrt(reduce(lambda x, y: x + y, [(s / most) * (s / most) for s in sides])))


def box_of(points: DataFrame, axes: Sequence[str]) -> tuple[int, list[tuple[float, float]]]:
    """Number of ``points`` and their low and high coordinates."""
    row = points.agg(F.count("*").alias("n"), *[f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    return row["n"], [(row[f"low_{a}"] or 0.0, row[f"high_{a}"] or 0.0) for a in axes]


def extent(points: DataFrame, axes: Sequence[str]) -> tuple[int, float]:
    """Number of ``points`` and the largest side of the box around them."""
    n, box = box_of(points, axes)
    return n, max(high / 2 - low / 2 for low, high in box) * 2


def bin_width(points: DataFrame, axes: Sequence[str]) -> float:
    """A width of bins that hold few of ``points`` (all different): a point each if they lie evenly, less until the fullest has FULL at most. AT_ONCE widths are counted in one pass."""
    n, side = extent(points, axes)
    h = min(side, 1e300) / max(n, 1) ** (1 / len(axes)) or 1.0
    for _ in range(0, CUTS, AT_ONCE):
        widths = [h / 8.0**k for k in range(AT_ONCE)]
        level = points.select(*axes, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(widths)])).alias("l"))
        counts = level.groupBy("l.k", *[bin_of(F.col(a), F.col("l.w")).alias(a) for a in axes]).agg(F.count("*").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
        fullest = {r["k"]: r["n"] for r in counts.collect()}
        for k, w in enumerate(widths):
            if fullest.get(k, 0) <= FULL:
                return w
        h = widths[-1] / 8
    return h


def nearest(queries: DataFrame, points: DataFrame, h: float | None = None, q_id: str = "qid", p_id: str = "pid", axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """q_id, p_id, d2: the nearest point of every query, of equal distances the smallest id; one row for each row of ``queries``.

    Each round looks into the grid cells around a query; who finds a point nearer than the grid's width has the answer, the
    others go on with a grid of four times the width, until one that holds everything. The first width ``h`` comes from the number of points and their
    extent, less where they are crowded. Queries that are farther than a width from the box around all points wait for a wider grid, and grids that none waits for are passed
    over, so rounds grow with the logarithm of the box, not of the farthest query.

    Queries with a null, NaN or infinite coordinate, and all queries if there is no point, have a null answer; points with such a coordinate are
    ignored; finite ones may be of any size (d2 is infinite where a double can't hold it); of points of one place that of the smallest id counts; equal query ids are answered each by themselves.
    """
    spark, bins = queries.sparkSession, [f"_b{a}" for a in axes]
    with scratch(spark, keep=1):
        asked = written(queries.select(q_id, *axes).withColumn("_q", F.monotonically_increasing_id()), "queries")
        targets = points.where(usable(axes)).groupBy(*[F.col(a).alias(f"_{a}") for a in axes]).agg(F.min(p_id).alias(p_id))
        targets = written(targets, "targets")
        named = [f"_{a}" for a in axes]
        box = box_of(targets, named)[1]
        gap = F.greatest(F.lit(0.0), *[F.greatest(F.lit(low) - F.col(a), F.col(a) - F.lit(high)) for a, (low, high) in zip(axes, box, strict=True)])
        wide = max(high / 2 - low / 2 for low, high in box) * 2
        far = max([wide, *(abs(x) for side in box for x in side)])
        h, out, here = h or bin_width(targets, named), [], [F.col(a) for a in axes]
        left = written(asked.where(usable(axes)).withColumn("_gap", gap), "asked")
        while not targets.isEmpty():
            seen = left.agg(F.min("_gap").alias("least"), F.max(F.greatest(*[F.abs(a) for a in axes], F.lit(0.0))).alias("far")).first()
            if seen["least"] is None:
                break
            # no bins where nobody can find anything
            h = max(h, min(seen["least"], 1e300) * (1 + 1e-9))
            ready = left.where(F.col("_gap") <= h) if seen["least"] <= h else left
            around = ready
            for a, b in zip(axes, bins, strict=True):
                around = around.withColumn(b, F.explode(F.array(*[bin_of(F.col(a), h) + d for d in (-1, 0, 1)])))
            binned = targets.select("*", *[bin_of(F.col(n), h).alias(b) for n, b in zip(named, bins, strict=True)])
            there = [F.col(n) for n in named]
            # where squares overflow, distances are compared
            plain = max(far, seen["far"]) < HUGE
            d = squared_distance(here, there) if plain else distance(here, there)
            around, binned, keys = _spread(around, binned, "_q", bins)
            best = around.join(binned, keys).groupBy("_q").agg(F.min(F.struct(d.alias("d2"), F.col(p_id))).alias("best"))
            tried = written(left.join(best, "_q", "left"), "nearest")
            near = F.coalesce(F.col("best.d2") < (h * h if plain else h), F.lit(False))
            # from this width on the bins around a query hold every point
            done = (F.col("_gap") + wide < h) | near if h < 1e300 else F.lit(True)
            d2 = F.col("best.d2") if plain else F.col("best.d2") * F.col("best.d2")
            out.append(tried.where(done).select("_q", F.col(f"best.{p_id}").alias(p_id), d2.alias("d2")))
            left = tried.where(~done).select(q_id, *axes, "_q", "_gap")
            h = min(h * 4, 1e300)
        if not out:
            return written(asked.select(q_id, F.lit(None).cast(points.schema[p_id].dataType).alias(p_id), F.lit(None).cast("double").alias("d2")), "answers")
        return written(asked.select("_q", q_id).join(reduce(DataFrame.unionByName, out), "_q", "left").select(q_id, p_id, "d2"), "answers")


def nearest_vectors(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vector: str) -> DataFrame:
    """The exact nearest other vector for a stated set of queries against all rows.

    Both sides are vectors of many dimensions, where grids don't prune: queries meet every point by definition of the search. Queries
    and points are dealt to blocks of some BLOCK rows each, so a task holds a block of queries and reads a block of points,
    whatever their numbers. The partial minimum stays with the pair of blocks, so one row per query and block of points is shuffled.
    Null vectors have no neighbour; queries without another vector are left out. Null components, and those that one of two vectors hasn't, add nothing to their distance; vectors
    without a component in common don't meet. NaN distances are the largest.
    """
    n_q, n_p = (max(1, math.ceil(df.count() / BLOCK)) for df in (queries, points))
    own = queries.select(F.col(q_id).alias("_q_row"), F.col(q_id).alias("_q_id"), F.col(vector).alias("_q"), F.pmod(F.xxhash64(q_id), F.lit(n_q)).alias("_bq"))
    others = points.select(F.col(p_id).alias("_p_id"), F.col(vector).alias("_p"), F.pmod(F.xxhash64(p_id), F.lit(n_p)).alias("_bp"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    found = _compared(own.withColumn("_bp", every(n_p)), others.withColumn("_bq", every(n_q)), ["_bq", "_bp"], n_q * n_p)
    best = found.groupBy(F.col("_q_row").alias(q_id)).agg(F.min(F.struct("d2", "_p_id")).alias("best"))
    return best.select(q_id, F.col("best._p_id").alias(p_id), F.col("best.d2").alias("d2"))


def _compared(own: DataFrame, others: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """_q_row, d2, _p_id, n_compared: for each query (_q_row, _q_id, _q) of a block (``keys``) the nearest other point (_p_id, _p) of the block, of equal distances the smallest id.

    A block is one piece of work in numpy: pairs are neither rows nor sorted, one row per query comes out.
    """

    def side(df: DataFrame, v: str, *ids: str) -> DataFrame:
        gaps = F.filter(F.transform(v, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())
        number = F.lit(float("nan")).cast(df.schema[v].dataType.elementType)
        held = df.where(F.col(v).isNotNull() & F.col(f"{v}_id").isNotNull()).select(*keys, *ids, F.transform(v, lambda x: F.coalesce(x, number)).alias(v), gaps.alias(f"{v}_gaps"))
        return held.repartition(tasks, *keys)

    types = [own.schema["_q_row"].dataType.simpleString(), others.schema["_p_id"].dataType.simpleString()]
    both = side(own, "_q", "_q_row", "_q_id").groupBy(*keys).cogroup(side(others, "_p", "_p_id").groupBy(*keys))
    found = both.applyInPandas(_nearest_in_block, f"_q_row {types[0]}, d2 double, _p_id {types[1]}, n_compared bigint")
    # pandas has nulls for NaN
    return found.withColumn("d2", F.coalesce("d2", F.lit(float("nan"))))


def _dense(vectors: pd.Series, gaps: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers, and whether each is there: a vector's nulls and what it is shorter by aren't."""
    out, there = np.zeros((len(vectors), width)), np.zeros((len(vectors), width), bool)
    for i, (v, g) in enumerate(zip(vectors, gaps, strict=True)):
        out[i, : len(v)], there[i, : len(v)] = v, True
        if len(g):
            there[i, g] = False
    return out, there


def _nearest_in_block(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The work of ``_compared``: squares are summed in the order of the components, as a sum of columns would be."""
    others = others.sort_values("_p_id")
    width = max([len(v) for side in (own["_q"], others["_p"]) for v in side], default=0)
    (q, q_there), (p, p_there) = _dense(own["_q"], own["_q_gaps"], width), _dense(others["_p"], others["_p_gaps"], width)
    p, p_there, whole = np.ascontiguousarray(p.T), np.ascontiguousarray(p_there.T), bool(width) and q_there.all() and p_there.all()
    ids, q_ids, at, d2 = others["_p_id"].to_numpy(), own["_q_id"].to_numpy(), np.full(len(own), -1), np.zeros(len(own))
    step = max(1, AT_HAND // max(1, len(ids)))
    for s in range(0, len(own) if len(ids) else 0, step):
        some = slice(s, s + step)
        d, met = np.zeros((len(q_ids[some]), len(ids))), np.full((1, 1), whole)
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(width):
                x = q[some, k, None] - p[k]
                x *= x
                if not whole:
                    both = q_there[some, k, None] & p_there[k]
                    x[~both], met = 0.0, met | both
                d += x
        fit = (q_ids[some, None] != ids) & met
        rank = np.where(fit & ~np.isnan(d), d, np.inf)
        near = rank.argmin(1)
        # where no distance is finite, infinite ones go before those that are no numbers
        for i in np.flatnonzero(np.isinf(rank.min(1))):
            left = next((m for m in (fit[i] & np.isinf(d[i]), fit[i]) if m.any()), None)
            near[i] = -1 if left is None else left.argmax()
        at[some], d2[some] = near, d[np.arange(len(d)), near]
    hit = at >= 0
    return pd.DataFrame({"_q_row": own["_q_row"].to_numpy()[hit], "d2": d2[hit], "_p_id": ids[at[hit]], "n_compared": len(ids)})


def _squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _finite(vector: str) -> Column:
    """Whether an array has finite numbers only."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def pivots_of(points: DataFrame, vector: str) -> DataFrame:
    """pivot, _at: for each length of vectors PIVOTS different ones at most, each the least of a range of hashes. The choice tells how much is skipped, not what is found."""
    hashed, size = F.xxhash64(vector), F.size(vector)
    pick = F.pmod(hashed, F.lit(PIVOTS))
    return points.groupBy((size.cast("bigint") * PIVOTS + pick).alias("pivot")).agg(F.min_by(vector, hashed).alias("_at"))


def nearest_by_pivots(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vector: str) -> DataFrame:
    """The exact nearest other vector of the same length (of equal distances the smallest id) for a stated set of queries against all rows: q_id, p_id, d2, and n_compared, the number of points looked at.

    Grids don't prune in many dimensions, distances to pivots do. Points go to the cell of their nearest pivot, and there, in the order of their distance to it, to rings of
    BLOCK points at most: a ring is a range of distances. A query is compared with the ring that holds its own distance in the cell of its nearest pivot, which bounds its answer; by the triangle
    inequality only rings whose range comes as near to its distance from their pivot can hold a nearer point. Rings are keys of equi-joins: large cells have many, and a ring that
    many queries meet is copied for blocks of BLOCK of them. Where nothing can be skipped (vectors without any structure) queries meet every ring, which is what the search then asks for.

    Vectors that are null or hold a null, NaN or infinite number have no neighbour and are none; queries without another vector of their length are left out; points with a
    query's own id are never its neighbour; equal query ids are answered each by themselves. d2 is infinite where a double can't hold it.
    """
    with scratch(queries.sparkSession, keep=1):
        sound = lambda df, i, v: df.where(_finite(vector)).select(F.col(i).alias(f"{v}_id"), F.col(vector).alias(v), F.monotonically_increasing_id().alias(f"{v}_row"))
        own, asked = written(sound(points, p_id, "_p"), "points"), written(sound(queries, q_id, "_q"), "queries")
        pivots = written(pivots_of(own, "_p"), "pivots")
        # every vector meets the pivots of its length
        every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda k: F.size("_v") * F.lit(PIVOTS).cast("bigint") + k))
        meet = lambda df, v: df.withColumnRenamed(v, "_v").withColumn("pivot", every).join(F.broadcast(pivots), "pivot").select(f"{v}_row", "pivot", F.sqrt(_squared(F.col("_v"), F.col("_at"))).alias("d"))
        nearest_pivot = meet(own, "_p").groupBy("_p_row").agg(F.min(F.struct("d", "pivot")).alias("n")).select("_p_row", "n.*")
        ordered = number_rows(own.join(nearest_pivot, "_p_row"), "pivot", "d", "_p_row")
        ringed = written(ordered.select("_p_id", "_p", "pivot", "d", F.floor(F.col(ROW) / BLOCK).cast("bigint").alias("ring")), "rings")
        ranges = ringed.groupBy("pivot", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
        # 24 bytes for each BLOCK points of a cell, copied to salts so that queries that meet a pivot are spread
        salt, salts = F.pmod(F.xxhash64("_q_row"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        ranges = written(ranges.groupBy("pivot").agg(F.collect_list(F.struct("ring", "low", "high", "n")).alias("rings")), "ranges").withColumn("salt", salts)
        far = written(meet(asked, "_q").withColumn("salt", salt), "distances")
        gap = lambda r: F.greatest(r["low"] - F.col("d"), F.col("d") - r["high"], F.lit(0.0))

        def compare(pairs: DataFrame, name: str) -> DataFrame:
            """_q_row, the best (d2, id) of its rings, and their points."""
            pairs = written(pairs, name)
            load = written(pairs.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")), f"{name}_load")
            dealt = pairs.join(load, ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("_q_row", F.lit(1)), F.col("blocks"))).join(asked, "_q_row")
            blocks = ringed.drop("d").join(load, ["pivot", "ring"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
            tasks = load.agg(F.sum("blocks")).first()[0] or 1
            found = _compared(dealt, blocks, ["pivot", "ring", "block"], tasks)
            return found.groupBy("_q_row").agg(F.min(F.struct("d2", "_p_id")).alias("best"), F.sum("n_compared").alias("n_compared"))

        cell = far.groupBy("_q_row", "salt").agg(F.min(F.struct("d", "pivot")).alias("n")).select("_q_row", "salt", "n.*")
        # a ring of one point may be the query itself
        first = F.array_min(F.transform("rings", lambda r: F.struct((r["n"] < 2).alias("alone"), gap(r).alias("gap"), r["ring"].alias("ring"))))
        start = written(cell.join(ranges, ["pivot", "salt"]).select("_q_row", "pivot", first["ring"].alias("ring")), "first")
        known = written(compare(start, "first_pairs"), "bounds")
        bound = known.join(start, "_q_row", "right").select("_q_row", F.sqrt("best.d2").alias("u"), F.col("pivot").alias("_c"), F.col("ring").alias("_r"))
        # rounding must not skip anything; a distance that overflowed decides nothing
        near = lambda r: F.col("u").isNull() | F.isnan(gap(r)) | (gap(r) <= F.col("u") + (F.col("u") + F.col("d") + r["high"]) * 1e-9)
        new = lambda r: F.coalesce((F.col("pivot") != F.col("_c")) | (r["ring"] != F.col("_r")), F.lit(True))
        left = far.join(bound, "_q_row", "left").join(ranges, ["pivot", "salt"])
        more = left.select("_q_row", "pivot", F.explode(F.transform(F.filter("rings", lambda r: near(r) & new(r)), lambda r: r["ring"])).alias("ring"))
        both = known.unionByName(compare(more, "pairs")).groupBy("_q_row").agg(F.min("best").alias("best"), F.sum("n_compared").alias("n_compared")).where("best IS NOT NULL")
        out = asked.join(both, "_q_row").select(F.col("_q_id").alias(q_id), F.col("best._p_id").alias(p_id), F.col("best.d2").alias("d2"), "n_compared")
        return written(out, "answers")


def in_box(point: Vec, low: Vec, high: Vec) -> Column:
    """Whether a point is in a closed box."""
    out = point[0].between(low[0], high[0])
    for p, a, b in zip(point[1:], low[1:], high[1:], strict=True):
        out = out & p.between(a, b)
    return out


def _level(sides: Sequence[Column]) -> Column:
    """The level of a box: grid cells of 4 ** level are as wide as its largest side, so it meets few of them. Boxes without a side have the one of 2 ** -40."""
    side = F.greatest(*sides, F.lit(2.0**-80)) if len(sides) > 1 else F.greatest(sides[0], F.lit(2.0**-80))
    return F.least(F.ceil(F.log2(side) / 2), F.lit(500)).cast("int")


def _met(boxes: DataFrame, axes: Sequence[str], h: float | None, low: str, high: str) -> DataFrame:
    """``boxes`` once for each grid cell that they meet (_level, _b and each axis), on the level of their own size, or all with width ``h``."""
    side = lambda a: F.col(f"{high}{a}") - F.col(f"{low}{a}")
    out = boxes.withColumn("_level", F.lit(0) if h else _level([side(a) for a in axes]))
    w = F.lit(float(h)) if h else F.pow(F.lit(4.0), F.col("_level"))
    for a in axes:
        out = out.withColumn(f"_b{a}", F.explode(F.sequence(bin_of(F.col(f"{low}{a}"), w), bin_of(F.col(f"{high}{a}"), w))))
    return out


def _probing(points: DataFrame, axes: Sequence[str], h: float | None, met: DataFrame) -> DataFrame:
    """``points`` once for each level that ``met`` has boxes on: powers of four between the smallest and the largest."""
    if h:
        return points.select("*", F.lit(0).alias("_level"), *[bin_of(F.col(a), float(h)).alias(f"_b{a}") for a in axes])
    levels = [r[0] for r in met.select("_level").distinct().collect()] or [0]
    each = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)])))
    return each.select("*", *[bin_of(F.col(a), F.pow(F.lit(4.0), F.col("_level"))).alias(f"_b{a}") for a in axes])


def range_join(points: DataFrame, boxes: DataFrame, h: float | None = None) -> DataFrame:
    """box_id, pid of points (pid, x, y) in boxes (box_id, lx, ly, ux, uy): a box is replicated to the grid cells that it meets.

    Grids form a hierarchy: a box goes to the few cells that are as wide as it is, whatever the sizes of others, and a point looks into its cell on every level that has boxes.
    With ``h`` there is one grid of that width. Points and boxes with a null, NaN or infinite coordinate are in none; empty boxes hold none.
    """
    sound = usable(["lx", "ly", "ux", "uy"]) & (F.col("lx") <= F.col("ux")) & (F.col("ly") <= F.col("uy"))
    met = _met(boxes.where(sound), ("x", "y"), h, "l", "u")
    binned = _probing(points.where(usable(["x", "y"])).select("pid", "x", "y"), ("x", "y"), h, met)
    hit = in_box([F.col("x"), F.col("y")], [F.col("lx"), F.col("ly")], [F.col("ux"), F.col("uy")])
    binned, met, keys = _dealt(binned, met.select("box_id", "lx", "ly", "ux", "uy", "_level", "_bx", "_by"), "pid", ["_level", "_bx", "_by"])
    return binned.join(met, keys).where(hit).select("box_id", "pid")


def _dealt(left: DataFrame, right: DataFrame, key: str, bins: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join by ``bins``, and what to join by: bins of more than PAIRS pairs are cut in blocks of ``left``, for each of which ``right`` is copied, and tasks are as many as the pairs need,
    since small inputs may have many."""
    each = left.groupBy(*bins).agg(F.count("*").alias("_n")).join(large(right).groupBy(*bins).agg(F.count("*").alias("_m")), bins)
    load = written(each.select(*bins, F.ceil(F.col("_n") * F.col("_m") / F.lit(PAIRS)).alias("_blocks"), (F.col("_n") * F.col("_m")).alias("_pairs")), "load")
    pairs = load.agg(F.sum("_pairs")).first()[0] or 0
    tasks, keys = max(left.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS)), [*bins, "_block"]
    load = load.drop("_pairs")
    a = left.join(load, bins).withColumn("_block", F.pmod(F.xxhash64(key, F.lit(1)), F.col("_blocks"))).drop("_blocks")
    b = right.join(load, bins).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    return a.repartition(tasks, *keys), large(b.repartition(tasks, *keys)), keys


def _spread(left: DataFrame, right: DataFrame, key: str, bins: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join by ``bins``, and what to join by: bins of more than CROWD rows of ``left`` are cut in blocks, for each of which ``right`` is copied, and tasks are as many as the rows need.

    These bins alone, of which there are fewer than ``left`` has CROWD rows, are broadcast, so no task meets all rows of a bin on the way either.
    """
    counts = written(left.groupBy(*bins).agg(F.count("*").alias("_n")), "counts")
    tasks, keys = max(left.sparkSession.sparkContext.defaultParallelism, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // (2 * CROWD))), [*bins, "_block"]
    crowded = F.broadcast(counts.where(F.col("_n") > CROWD).select(*bins, F.ceil(F.col("_n") / F.lit(CROWD)).alias("_blocks")))
    blocks = F.coalesce("_blocks", F.lit(1).cast("bigint"))
    a = left.join(crowded, bins, "left").withColumn("_block", F.pmod(F.xxhash64(key, F.lit(1)), blocks)).drop("_blocks")
    b = right.join(crowded, bins, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("_blocks")
    return a.repartition(tasks, *keys), large(b.repartition(tasks, *keys)), keys


def _own(simplex: Simplex, z: Vec) -> Column:
    """Whether a cell holds what lies next to a point of it in the direction of x (then y, then z): of the cells at a shared side one does, so they are half-open."""
    back = simplex.inverse()
    slopes = [[-reduce(lambda x, y: x + y, g) for g in zip(*back, strict=True)], *back]
    ahead = [F.coalesce(*[F.when(g != 0, g > 0) for g in s], F.lit(False)) for s in slopes]
    return reduce(lambda x, y: x & y, [(c > EPSILON) | a for c, a in zip(z, ahead, strict=True)])


def _hits(points: DataFrame, mesh: Mesh, h: float | None, geometry: DataFrame | None) -> DataFrame:
    """As ``locate_all``, with _apart: 0 for the cell whose own a point is, else 1."""
    simplex, axes = mesh.simplex(), mesh.axes
    low, high = simplex.bounding_box()
    cells = (geometry if geometry is not None else mesh.geometry()).select("*", *[c.alias(f"_l{a}") for a, c in zip(axes, low, strict=True)], *[c.alias(f"_u{a}") for a, c in zip(axes, high, strict=True)])
    met = _met(cells.where(usable([f"_{k}{a}" for a in axes for k in "lu"])), axes, h, "_l", "_u")
    binned = _probing(points.where(usable(axes)), axes, h, met)
    z = simplex.barycentric([F.col(a) for a in axes])
    near = in_box([F.col(a) for a in axes], [F.col(f"_l{a}") for a in axes], [F.col(f"_u{a}") for a in axes])
    names = [f"z{i}" for i in range(len(z))]
    apart = F.when(_own(simplex, z), 0).otherwise(1).alias("_apart")
    hits = binned.join(met, ["_level", *[f"_b{a}" for a in axes]]).where(near).select(*points.columns, "cell_id", *mesh.vertices, *[c.alias(n) for n, c in zip(names, z, strict=True)], apart)
    return hits.where(F.least(*names) >= -EPSILON)


def locate_all(points: DataFrame, mesh: Mesh, h: float | None = None, geometry: DataFrame | None = None) -> DataFrame:
    """pid, cell_id and the barycentric coordinates z0, z1, ... in every cell that contains a point (pid, x, y[, z]).

    Cells go to the grid of their own size, so graded meshes need no width; with ``h`` there is one grid. Points and cells with a null, NaN or infinite coordinate meet nothing.
    """
    return _hits(points, mesh, h, geometry).drop("_apart")


def located(points: DataFrame, mesh: Mesh, h: float | None = None, geometry: DataFrame | None = None) -> DataFrame:
    """One row of ``locate_all`` (pid, cell_id, v0, ..., z0, ...) for each pid in a cell. Of the cells at a shared side it is the one that goes on in the direction of x (along x: of y, then z); where
    none does, as on the last sides of a mesh, that of smallest id."""
    keep = ["cell_id", *mesh.vertices, *[f"z{i}" for i in range(mesh.order + 1)]]
    return _hits(points, mesh, h, geometry).groupBy("pid").agg(F.min(F.struct("_apart", *keep)).alias("hit")).select("pid", *[f"hit.{c}" for c in keep])


def locate(points: DataFrame, mesh: Mesh, h: float | None = None) -> DataFrame:
    """pid, cell_id: the containing cell as in ``located``, -1 outside."""
    found = located(points, mesh, h).select("pid", "cell_id")
    return points.select("pid").join(found, "pid", "left").select("pid", F.coalesce("cell_id", F.lit(-1)).alias("cell_id"))


def locate_interval(points: DataFrame, knots: list[float], x: str = "x") -> DataFrame:
    """All of ``points`` with cell_id in the half-open cells between ascending knots (the last is closed), -1 outside."""
    at = F.size(F.filter(F.array(*[F.lit(float(k)) for k in knots]), lambda k: k <= F.col(x))) - 1
    last = len(knots) - 2
    cell = F.when((F.col(x) < knots[0]) | (F.col(x) > knots[-1]), -1).otherwise(F.least(at, F.lit(last)))
    return points.withColumn("cell_id", cell.cast("bigint"))


def locate_knots(points: DataFrame, knots: DataFrame, x: str = "x") -> DataFrame:
    """As ``locate_interval``, where the knots are a table (u): the last knot that isn't behind each point, by one merge of points and knots in the order of x.

    Points and knots are range-partitioned together, many points of one place over several partitions; a partition that has no knot of its own yet goes on with the
    last one of those before it (one row for each partition). Null and NaN points have a null cell, knots that aren't finite are ignored, of equal knots the last counts.
    """
    line = number_rows(knots.where(usable(["u"])).select(F.col("u").cast("double").alias("u")), "u").select("u", F.col(ROW).alias("k"))
    row = F.struct(*[F.col(c) for c in points.columns])
    at = points.select(F.col(x).cast("double").alias("u"), F.lit(None).cast("bigint").alias("k"), row.alias("row"), F.xxhash64(*points.columns).alias("salt"))
    both = line.select("u", "k", F.lit(None).cast(at.schema["row"].dataType).alias("row"), F.lit(0).cast("bigint").alias("salt")).unionByName(at)
    order = ["u", F.col("k").isNull(), "salt"]
    ranged = written(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "merged")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("_part").agg(F.max("k").alias("last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    carried = parts.select("_part", F.max("last").over(before).alias("carry"))
    ends = line.agg(F.max("k").alias("n"), F.max("u").alias("high"))
    known = ranged.select("*", F.max("k").over(inside).alias("own")).where("row IS NOT NULL").join(F.broadcast(carried), "_part").crossJoin(F.broadcast(ends))
    k = F.coalesce("own", "carry", F.lit(-1).cast("bigint"))
    cell = F.when(F.col("u").isNull() | F.isnan("u"), F.lit(None)).when((F.col("u") > F.col("high")) | F.col("n").isNull() | (F.col("n") < 1), -1).otherwise(F.least(k, F.col("n") - 1))
    return known.select("row.*", cell.cast("bigint").alias("cell_id"))


def project(points: DataFrame, mesh: Mesh, geometry: DataFrame | None = None) -> DataFrame:
    """pid, cell_id, d2 and the nearest point of the mesh (px, ...), over all cells: exact.

    The nearest vertex bounds the distance; only cells whose box is as near can be nearer. Grid cells are as wide as that distance (in powers of two, at least
    the mean cell), so a point looks into three of them along each axis. Points with a null or NaN coordinate, and all points if the mesh has no cells, have
    null answers; equal pids are answered each by themselves.
    """
    axes, spark = mesh.axes, points.sparkSession
    low, high = mesh.simplex().bounding_box()
    with scratch(spark, keep=1):
        cells = (geometry if geometry is not None else mesh.geometry()).select("*", *[c.alias(f"_l{a}") for a, c in zip(axes, low, strict=True)], *[c.alias(f"_u{a}") for a, c in zip(axes, high, strict=True)])
        cells = written(cells, "cells")
        asked = written(points.select("pid", *[F.col(a).alias(f"_{a}") for a in axes]).withColumn("_q", F.monotonically_increasing_id()), "points")
        corner = F.explode(F.array(*[F.struct(*[F.col(f"{a}{k}").alias(a) for a in axes]) for k in range(mesh.order + 1)]))
        vertices = cells.select(corner.alias("c")).select("c.*").withColumn("pid", F.lit(0))
        near = nearest(asked.select(F.col("_q").alias("qid"), *[F.col(f"_{a}").alias(a) for a in axes]), vertices, axes=tuple(axes)).select(F.col("qid").alias("_q"), F.sqrt("d2").alias("_r"))
        width = cells.agg(F.avg(F.greatest(*[F.col(f"_u{a}") - F.col(f"_l{a}") for a in axes])) if len(axes) > 1 else F.avg(F.col(f"_u{axes[0]}") - F.col(f"_l{axes[0]}"))).first()[0] or 1.0
        level = F.greatest(F.ceil(F.log2(F.greatest(F.col("_r"), F.lit(width)) / width)), F.lit(0)).cast("int")
        around = written(asked.join(near, "_q").where("_r IS NOT NULL").withColumns({"_r": F.col("_r") * (1 + 1e-9), "_level": level}), "around")
        levels = [r[0] for r in around.select("_level").distinct().collect()]  # powers of two between two lengths
        bins, side = [f"_b{a}" for a in axes], lambda: F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
        span = lambda a, b: F.explode(F.sequence(F.floor(a / side()).cast("bigint"), F.floor(b / side()).cast("bigint")))
        # a mesh has few different levels, and a cell few grid cells on each
        dealt = cells.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]))) if levels else cells.withColumn("_level", F.lit(0))
        for a, b in zip(axes, bins, strict=True):
            dealt = dealt.withColumn(b, span(F.col(f"_l{a}"), F.col(f"_u{a}")))
            around = around.withColumn(b, span(F.col(f"_{a}") - F.col("_r"), F.col(f"_{a}") + F.col("_r")))
        p = [F.col(f"_{a}") for a in axes]
        gaps = [F.greatest(F.col(f"_l{a}") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"_u{a}"), F.lit(0.0)) for a in axes]
        close = reduce(lambda x, y: x + y, [g * g for g in gaps]) <= F.col("_r") * F.col("_r")
        on = mesh.simplex().nearest(p)
        spot = F.struct(squared_distance(p, on).alias("d2"), "cell_id", *[c.alias(f"p{a}") for a, c in zip(axes, on, strict=True)])
        around, dealt, keys = _spread(around, dealt, "_q", ["_level", *bins])
        best = around.join(dealt, keys).where(close).groupBy("_q").agg(F.min(spot).alias("best"))
        return written(asked.select("_q", "pid").join(best, "_q", "left").select("pid", "best.*"), "projected")


def project_near(points: DataFrame, mesh: Mesh, h: float | None = None) -> DataFrame:
    """As ``project``, but only over the cells around the nearest node: equi-joins throughout. Points with a null or NaN coordinate are left out."""
    axes = mesh.axes
    near = nearest(points, mesh.nodes, h, "pid", "node_id", tuple(axes)).select("pid", "node_id")
    cells = near.join(mesh.node_patch(), "node_id").join(mesh.geometry(), "cell_id")
    named = points.select("pid", *[F.col(a).alias(f"_{a}") for a in axes])
    p = [F.col(f"_{a}") for a in axes]
    on = mesh.simplex().nearest(p)
    spot = F.struct(squared_distance(p, on).alias("d2"), "cell_id", *[c.alias(f"p{a}") for a, c in zip(axes, on, strict=True)])
    return cells.join(named, "pid").groupBy("pid").agg(F.min(spot).alias("best")).select("pid", "best.*")
