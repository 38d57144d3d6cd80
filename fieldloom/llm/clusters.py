"""Exact k-means whose rounds are Exponion searches.

A vector carries its centroid, an upper bound of the distance to it, and a lower bound of that to any other. When centroids have moved, a
vector whose upper bound stays below the lower one keeps its centroid unseen. The others measure their centroid, and if that
doesn't decide it, scan the centroids inside a ball around it: those at most 2u + s away, u being the vector's distance and
s the distance of the nearest other centroid. That holds the nearest and the second nearest, and comes first in the centroid's list of
others sorted by distance. Bounds are doubles, rounded to the safe side; distances are compared as whole numbers. The ball is closed and a bound
decides only when it is strictly smaller, so no tie is passed over, and ties go to the smaller number.

Each round is one pass over a written table, which writes the next one with the bounds and, for each task, the change that its vectors
made to the sums of the centroids; sums are whole numbers, so no order of tasks changes a result. Nothing is shuffled but these changes.
Only centroids are on the driver: ``k`` times ``dims`` numbers, at most MOST_NUMBERS.

Defined cases: vectors that are null, of another length than ``dims``, or hold a null or a number that isn't finite, are left out; repeated rows are
vectors of their own; vectors without an id are clustered, but sort behind others as first centroids; equal ids sort by their components; of fewer
vectors than ``k`` each is a centroid; components beyond ``vectors.LARGEST`` after scaling raise an ArithmeticError, as their squared
distances may not fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.shared import drop_older
from .common import scratch, small_batches, written
from .vectors import packed, parts_of, squared, summed, unpacked, whole_numbers

#: Numbers of all centroids; they go to every task.
MOST_NUMBERS = 4_000_000
#: Relative room for the rounding of bounds.
ROOM = 1e-12
NO_OTHER = np.iinfo(np.int64).max


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + ROOM)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0) * (1 - ROOM)


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int, scale: float) -> np.ndarray:
    """The ``k`` kept vectors with the smallest SHA-256 of seed and vec_id, in the order of the hash."""
    key = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    x = F.col("embedding")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select("embedding", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k)
    return whole_numbers(rows.toArrow().column("embedding"), dims, scale)[1].astype(np.int64)


class Centroids:
    """Centroids with their lists of others by distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.k = len(values)
        d2 = np.stack([squared(values, v) for v in values])
        self.near = np.argsort(d2, axis=1, kind="stable")
        self.far = np.sqrt(np.take_along_axis(d2, self.near, 1).astype(np.float64))
        # the list begins with the centroid itself, or one at the same place
        self.next = up(self.far[:, 1]) if self.k > 1 else np.zeros(self.k)

    def search(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Sets centroid and bounds of each vector; a vector whose bounds decide keeps them."""
        open_ = np.flatnonzero(upper >= lower)
        upper[open_] = up(np.sqrt(squared(x[open_], self.values[own[open_]]).astype(np.float64)))
        open_ = open_[upper[open_] >= lower[open_]]
        if not len(open_):
            return
        start = own[open_]
        radius = up(2 * upper[open_] + self.next[start])
        n = np.zeros(len(open_), np.int64)
        for c in np.unique(start):
            n[start == c] = np.searchsorted(down(self.far[c]), radius[start == c], "right")
        order = np.argsort(-n, kind="stable")
        open_, start, n = open_[order], start[order], n[order]
        v, best, second, at = x[open_].astype(np.int64), np.full(len(n), NO_OTHER), np.full(len(n), NO_OTHER), np.full(len(n), self.k)
        for t in range(int(n[0])):
            m = int(np.searchsorted(-n, -t, "left"))  # those with more than t centroids in their ball
            j = self.near[start[:m], t]
            d = squared(v[:m], self.values[j])
            nearer = (d < best[:m]) | ((d == best[:m]) & (j < at[:m]))
            second[:m] = np.where(nearer, best[:m], np.minimum(second[:m], d))
            best[:m], at[:m] = np.where(nearer, d, best[:m]), np.where(nearer, j, at[:m])
        own[open_] = at
        upper[open_] = up(np.sqrt(best.astype(np.float64)))
        lower[open_] = np.where(second == NO_OTHER, np.inf, down(np.sqrt(second.astype(np.float64))))

    def moved_to(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each centroid goes at most, and the farthest of the others."""
        far = up(np.sqrt(squared(self.values, values).astype(np.float64)))
        others = np.array([np.delete(far, j).max(initial=0.0) for j in range(self.k)])
        return far, others


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: float = 1024.0) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every kept vector of ``vectors`` (vec_id, embedding), and the final centroids.

    Rounds end early where no centroid moves, since all later ones would change nothing.
    """
    if k * dims > MOST_NUMBERS:
        raise ValueError(f"at most {MOST_NUMBERS} numbers in all centroids")
    spark, vectors = vectors.sparkSession, vectors.select("vec_id", "embedding")
    small_batches(spark)
    kind = vectors.schema["vec_id"].dataType
    state_of = StructType([StructField("vec_id", kind), StructField("x", BinaryType()), StructField("own", IntegerType()), StructField("upper", DoubleType()), StructField("lower", DoubleType()), StructField("change", ArrayType(LongType()))])
    result_of = StructType([StructField("vec_id", kind), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    with scratch(spark, keep=1) as paths:
        values = first_centroids(vectors, k, seed, dims, scale)
        if not len(values):
            return spark.createDataFrame([], result_of), values
        count, total = np.zeros(len(values), np.int64), np.zeros((len(values), dims), np.int64)
        state, before = vectors, None

        def opened(batches: Iterator[pa.RecordBatch], now: np.ndarray, before: np.ndarray | None) -> Iterator[tuple]:
            """id column, vectors, centroid, bounds of batches of the table of vectors, or of a state."""
            centroids = Centroids(now)
            if before is not None:
                far, others = Centroids(before).moved_to(now)
            for batch in parts_of(batches):
                if before is None:
                    kept, x = whole_numbers(batch.column("embedding"), dims, scale)
                    ids = batch.column("vec_id").filter(pa.array(kept))
                    old, upper, lower = np.full(len(x), -1), np.full(len(x), np.inf), np.zeros(len(x))
                else:
                    ids, x = batch.column("vec_id"), unpacked(batch.column("x"), "<i4", dims)
                    old = batch.column("own").to_numpy().astype(np.int64)
                    upper = up(batch.column("upper").to_numpy() + far[old])
                    lower = down(batch.column("lower").to_numpy() - others[old])
                own = np.maximum(old, 0)
                centroids.search(x, own, upper, lower)
                yield ids, x, old, own, upper, lower

        def step(now: np.ndarray, before: np.ndarray | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                change = np.zeros((len(now), dims + 1), np.int64)
                for ids, x, old, own, upper, lower in opened(batches, now, before):
                    other = np.flatnonzero(old != own)
                    for sign, where in ((1, own[other]), (-1, old[other])):
                        for j in np.unique(where[where >= 0]):
                            rows = x[other[where == j]]
                            change[j] += sign * np.append(rows.sum(0, dtype=np.int64), len(rows))
                    none = pa.nulls(len(x), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, packed(x), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), none], names=state_of.names)
                j = np.flatnonzero(change.any(1))
                if len(j):
                    empty = [pa.nulls(len(j), pa.binary()), pa.array(j.astype(np.int32)), *[pa.nulls(len(j), pa.float64())] * 2]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(j), ids.type), *empty, pa.array(change[j].tolist(), pa.list_(pa.int64()))], names=state_of.names)

            return run

        def last(now: np.ndarray, before: np.ndarray | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for ids, x, _, own, _, _ in opened(batches, now, before):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(squared(x, now[own]))], names=result_of.names)

            return run

        for _ in range(rounds):
            table = written(state.mapInArrow(step(values, before), state_of), "clusters", "zstd")
            drop_older(spark, paths, 1)
            for j, sums in summed(table.where("x IS NULL").select("own", "change"), "own", "change").items():
                total[j] += [sums[i] for i in range(dims)]
                count[j] += sums[dims]
            state, before = table.where("x IS NOT NULL").drop("change"), values
            values = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], before)
            if (values == before).all():
                break
        return written(state.mapInArrow(last(values, before), result_of), "clustered", "zstd"), values


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distances summed over each cluster and over all, and a digest of the vector's centroid."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, sums.get(j, 0), sum(sums.values()), d) for j, d in enumerate(digests)]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
