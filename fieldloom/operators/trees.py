"""Trees as relations (node_id, parent_id, is_left, value): an Euler tour gives the orders, depths and subtrees as numbers, paths give places in shallow binary trees.

Defined cases: roots are nodes with a null parent, of which there may be several; nodes that no root reaches (on a cycle, below one, or below a parent that isn't there) have
null numbers and null paths; nodes are told apart by their id, so a repeated id, or a null one, is no tree and counts as reached by no root; an empty tree gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_older, large, scratch, written
from .frame import ROW, number_rows

#: Children of a block in the tree of minima; a power of two.
WIDE = 64
#: Arcs of a tour that a task joins; one arc in STOPS is a stop, where there are more than FEW.
ARCS, STOPS, FEW = 1_000_000, 8, 200_000
#: Characters of a path, far beyond those of shallow trees.
LONGEST_PATH = 1 << 20


def with_paths(tree: DataFrame) -> DataFrame:
    """``tree`` with path (L and R from the root) and depth. Pointers double each round, so rounds grow with the log of the depth; paths are as long as the depth, for deep trees see ``toured``."""
    step = F.when(F.col("parent_id").isNull(), "").when(F.col("is_left"), "L").otherwise("R")
    state = written(tree.select("node_id", F.col("parent_id").alias("up"), step.alias("path"), F.lit(True).alias("reached")), "paths")
    # after so many doublings, what still has a node above is on a cycle or below one
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("reached").alias("reached2"))
        # long paths of a cycle aren't made: they would double each round
        path = F.when(F.length("path") + F.length(F.coalesce("path2", F.lit(""))) < LONGEST_PATH, F.concat(F.coalesce("path2", F.lit("")), "path"))
        found = F.col("up").isNull() | F.coalesce("reached2", F.lit(False))
        state = written(state.join(above, "up", "left").select("node_id", F.col("up2").alias("up"), path.alias("path"), (F.col("reached") & found).alias("reached")), "paths")
    sound = F.when(F.col("up").isNull() & F.col("reached"), F.col("path"))
    return tree.join(state.select("node_id", sound.alias("path")).withColumn("depth", F.length("path")), "node_id")


def _dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """One side of a join or the rows of a window over ``key``, in tasks as many as ``n`` rows need, so that no task grows with the input; Spark deals few rows by itself."""
    return df.repartition(-(-n // ARCS), key) if n > ARCS else df


def _summed(arcs: DataFrame, n: int, level: int = 0) -> DataFrame:
    """``arcs`` (arc, to, nodes, deep, root), written, with sums over all arcs that follow, and the root where they end; ``to`` is null then.

    Pointers jump over twice the distance each round, but not beyond a stop, which a hash of the arc tells. So after a few rounds, whatever the length, all point to a stop or the end; then the
    stops, which are few, are summed in the same way. What goes round on a cycle gets no root.
    """
    spark, sums = arcs.sparkSession, ("nodes", "deep")
    stop = lambda c: (F.pmod(F.xxhash64(c, F.lit(level)), F.lit(STOPS)) == 0) if n > FEW else F.lit(False)
    goes_on, at_stop = F.col("to").isNotNull() & ~stop("to"), F.col("to").isNotNull() & stop("to")
    added = [(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in sums]
    named = lambda df: _dealt(df.select(F.col("arc").alias("to"), F.col("to").alias("to2"), *[F.col(c).alias(f"{c}2") for c in (*sums, "root")]), n, "to")
    jumped = lambda moving, after: _dealt(moving, n, "to").join(named(after), "to", "left").select("arc", F.col("to2").alias("to"), *added, F.coalesce("root", "root2").alias("root"))
    with scratch(spark, keep=1) as paths:
        state = arcs
        for _ in range(max(1, n).bit_length() + 1):
            if state.where(goes_on).isEmpty():
                break
            moved = jumped(state.where(goes_on), state.where(~stop("arc")))
            state = written(moved.unionByName(state.where(~goes_on)), "arcs")
            drop_older(spark, paths, 1)
        if n <= FEW:
            return state
        stops = written(state.where(stop("arc") & ~goes_on), "stops")
        known = _summed(stops, stops.count(), level + 1)
        return written(jumped(state.where(at_stop), known).unionByName(state.where(~at_stop)), "summed")


def toured(tree: DataFrame) -> DataFrame:
    """``tree`` with root, pre (place in pre-order below its root, from 0), depth and size (nodes of its subtree, itself included).

    The Euler tour goes down and up each edge. Every such arc points to the one before it: from down to a child to the last way up from the child before, or to the way down to the parent; from up
    to the way up from the last child below, or to its own way down. Sums back to the start of the tour (see ``_summed``) are the numbers, of any depth, a chain's too.
    The nodes below one are those with pre from its own on, ``size`` of them. Any number of children is allowed: left ones come first, then by node_id.
    """
    kids = Window.partitionBy("parent_id").orderBy(F.coalesce("is_left", F.lit(False)).desc(), "node_id")
    known = large(tree).select("node_id", "parent_id", "is_left").where("node_id IS NOT NULL")
    with scratch(tree.sparkSession, keep=1):
        n = known.count()
        roots = known.where("parent_id IS NULL").select(F.col("node_id").alias("parent_id"), F.lit(True).alias("top"))
        below = _dealt(known.where("parent_id IS NOT NULL"), n, "parent_id").join(_dealt(roots, n, "parent_id"), "parent_id", "left")
        whole = written(below.select("node_id", "parent_id", F.coalesce("top", F.lit(False)).alias("top"), F.lag("node_id").over(kids).alias("before"), F.lead("node_id").over(kids).isNull().alias("last")), "children")
        last = whole.where("last").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
        rows = written(_dealt(whole, n, "node_id").join(_dealt(last, n, "node_id"), "node_id", "left").select("node_id", "parent_id", "before", "child", "top"), "edges")
        # arcs: 2 id is down to a node, 2 id + 1 up from it
        back = F.when(F.col("before").isNotNull(), F.col("before") * 2 + 1).when(~F.col("top"), F.col("parent_id") * 2)
        down = rows.select((F.col("node_id") * 2).alias("arc"), back.alias("to"), F.lit(1).cast("bigint").alias("nodes"), F.lit(1).cast("bigint").alias("deep"), F.when(F.col("before").isNull() & F.col("top"), F.col("parent_id")).alias("root"))
        up = rows.select((F.col("node_id") * 2 + 1).alias("arc"), F.coalesce(F.col("child") * 2 + 1, F.col("node_id") * 2).alias("to"), F.lit(0).cast("bigint").alias("nodes"), F.lit(-1).cast("bigint").alias("deep"), F.lit(None).cast(rows.schema["node_id"].dataType).alias("root"))
        state = _summed(written(down.unionByName(up), "arcs"), 2 * n)
        # a start that isn't at a root is none
        ended = state.where("to IS NULL AND root IS NOT NULL")
        side = lambda up: _dealt(ended.where(F.pmod("arc", F.lit(2)) == up).select(F.floor(F.col("arc") / 2).cast("bigint").alias("node_id"), "root", "nodes", "deep"), n, "node_id")
        inner = side(0).join(side(1).select("node_id", F.col("nodes").alias("end")), "node_id").select("node_id", "root", F.col("nodes").alias("pre"), F.col("deep").alias("depth"), (F.col("end") - F.col("nodes") + 1).alias("size"))
        total = ended.groupBy("root").agg(F.max("nodes").alias("all"))
        tops = known.where("parent_id IS NULL").select("node_id", F.col("node_id").alias("root"), F.lit(0).cast("bigint").alias("pre"), F.lit(0).cast("bigint").alias("depth"))
        tops = _dealt(tops, n, "root").join(_dealt(total, n, "root"), "root", "left").select("node_id", "root", "pre", "depth", (F.coalesce("all", F.lit(0)) + 1).alias("size"))
        numbers = written(inner.unionByName(tops), "tour")
    return _dealt(tree, n, "node_id").join(_dealt(numbers, n, "node_id"), "node_id", "left")


def below(tour: DataFrame, node_id: int) -> DataFrame:
    """The subtree of a node: a range of its root's pre-order."""
    top = tour.where(F.col("node_id") == node_id).select(F.col("root").alias("_root"), F.col("pre").alias("_from"), (F.col("pre") + F.col("size")).alias("_to"))
    return tour.join(F.broadcast(top), (F.col("root") == F.col("_root")) & (F.col("pre") >= F.col("_from")) & (F.col("pre") < F.col("_to"))).drop("_root", "_from", "_to")


def without(tour: DataFrame, node_id: int) -> DataFrame:
    """Erase a node and all below it; nodes that no root reaches stay."""
    return large(tour).join(below(tour, node_id).select("node_id"), "node_id", "left_anti")


def depth_first() -> list[Column]:
    """Pre-order: node, left, right."""
    return [F.col("path").asc()]


def breadth_first() -> list[Column]:
    return [F.col("depth").asc(), F.col("path").asc()]


def subtree(paths: DataFrame, root_path: str) -> DataFrame:
    return paths.where(F.col("path").startswith(root_path))


def without_subtree(paths: DataFrame, root_path: str) -> DataFrame:
    """Erase a node and all below it."""
    return paths.where(~F.col("path").startswith(root_path))


def leaves(tree: DataFrame) -> DataFrame:
    return large(tree).join(tree.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")


def put(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add nodes by their paths; those that exist are replaced."""
    return paths.join(nodes.select("path"), "path", "left_anti").select(nodes.columns).unionByName(nodes)


def search_tree(items: DataFrame) -> DataFrame:
    """node_id, value, parent_id, is_left of the binary search tree that results from inserting items (node_id, value) in the order of node_id.

    Equal values go right; null values aren't inserted. In the order of values, a node's parent is the later one of the nearest nodes on
    either side that were inserted before it. These are looked for in a tree of minima with WIDE children: up to the first block that has one, and
    down again. So the joins grow with the logarithm of the number of items, whatever their order, and none has a frequent key: a block is read by the items below it.
    """
    rows = written(number_rows(items.where("value IS NOT NULL").select("node_id", "value"), "value", "node_id"), "ordered")
    bits, n, blocks = WIDE.bit_length() - 1, rows.count(), []
    least = rows.select(F.col(ROW).alias("at"), F.col("node_id").alias("m"))
    while True:
        placed = least.groupBy(F.shiftright("at", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("c"))
        blocks.append(written(placed.select("block", F.col("c.m").alias("m")), "minima"))
        if n <= WIDE ** len(blocks):
            break
        least = blocks[-1].select(F.col("block").alias("at"), F.array_min("m").alias("m"))
    own = F.col("node_id")
    kinds = "struct<level:int,at:bigint,node:bigint>"
    state = rows.withColumns({side: F.lit(None).cast(kinds) for side in ("before", "after")})
    spot = lambda k, j: F.when(j.isNotNull(), F.struct(F.lit(k).alias("level"), (F.col("block") * WIDE + j).alias("at"), F.get("m", j.cast("int")).alias("node"))).cast(kinds)
    smaller = lambda keep: F.filter(F.transform("m", lambda m, i: F.when((m < own) & keep(i), i)), lambda i: i.isNotNull())
    for k, block in enumerate(blocks):
        digit = F.shiftright(ROW, bits * k).bitwiseAND(F.lit(WIDE - 1).cast("bigint"))
        joined = state.withColumn("block", F.shiftright(ROW, bits * (k + 1))).join(block, "block")
        state = joined.withColumns({
            "before": F.coalesce("before", spot(k, F.array_max(smaller(lambda i: i < digit)))),  # noqa: B023
            "after": F.coalesce("after", spot(k, F.array_min(smaller(lambda i: i > digit)))),  # noqa: B023
        }).drop("block", "m")
    for k in range(len(blocks) - 1, 0, -1):
        for side, pick in (("before", F.array_max), ("after", F.array_min)):
            # a key of their own for those that look for nothing here
            state = written(state, "sides") if side == "before" else state
            key = F.when(F.col(f"{side}.level") == k, F.col(f"{side}.at")).otherwise(-1 - F.col(ROW))
            joined = state.withColumn("block", F.coalesce(key, -1 - F.col(ROW))).join(blocks[k - 1], "block", "left")
            state = joined.withColumn(side, F.when(F.col("m").isNotNull(), spot(k - 1, pick(smaller(lambda i: F.lit(True))))).otherwise(F.col(side))).drop("block", "m")
    parent = F.greatest("before.node", "after.node")
    return state.select("node_id", "value", parent.alias("parent_id"), F.coalesce(parent == F.col("after.node"), F.lit(False)).alias("is_left"))


def find(tree: DataFrame, value: Column) -> DataFrame:
    """The nodes of a value: a filter, which reaches the scan."""
    return tree.where(F.col("value") == value)
