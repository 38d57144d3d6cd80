"""Vector codes: equal parts of a vector become indexes into codebooks, which are found by Exponion search.

A part starts at the entry of the round before and measures it: u. Entries that are as near lie within twice u of that entry, since
distance(entry, other) <= distance(entry, part) + distance(part, other); they come first in the entry's list of others sorted by distance. All of it is
whole numbers: the radius is compared as d2 <= 4 u2, closed, and of equal distances the smallest index is taken.

Each round is one pass over a written table, which writes the next one with the codes, and for each task the sums that its parts add to
their entries; entries are set to the floor of the mean. Only codebooks are on the driver: ``parts`` times ``entries`` entries, at most MOST_NUMBERS numbers.

Defined cases: vectors that are null, of another length than ``dims``, or hold a null or a number that isn't finite, are left out; repeated rows are
vectors of their own; vectors without an id have codes, but come behind others as first entries; equal ids sort by their components; of fewer
vectors than ``entries`` each gives an entry; a null label is a label of its own; components beyond ``vectors.LARGEST`` after scaling raise an
ArithmeticError, as their squared distances may not fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..sources.shared import drop_older
from .common import scratch, small_batches, written
from .vectors import packed, parts_of, squared, summed, unpacked, whole_numbers

#: Numbers of all codebooks, which go to every task; an index is two hex digits.
MOST_NUMBERS, MOST_ENTRIES = 1_000_000, 256
#: Up to so many labels, their sums are broadcast (some tens of bytes each); more are joined by a shuffle in which each label has SALTS keys.
FEW_LABELS, SALTS = 50_000, 64
#: Distances that are measured at once.
PAIRS = 400_000


class Codebook:
    """Entries of one part position with their lists of others by squared distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        d2 = np.stack([squared(entries, e) for e in entries])
        self.near = np.argsort(d2, axis=1, kind="stable")
        self.far = np.take_along_axis(d2, self.near, 1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row of ``x``, looked for from ``start``."""
        u2 = squared(x, self.entries[start])
        n = np.zeros(len(x), np.int64)
        for e in np.unique(start):
            n[start == e] = np.searchsorted(self.far[e], 4 * u2[start == e], "right")
        index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        ends = np.cumsum(n)  # an entry is in its own list, so no list is empty
        begin = 0
        while begin < len(x):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            m = n[begin:end]
            owner = np.repeat(np.arange(begin, end), m)
            first = np.cumsum(m) - m
            j = self.near[start[owner], np.arange(len(owner)) - np.repeat(first, m)]
            d = squared(x[owner], self.entries[j])
            best = np.minimum.reduceat(d, first)
            index[begin:end] = np.minimum.reduceat(np.where(d == np.repeat(best, m), j, len(self.entries)), first)
            least[begin:end] = best
            begin = end
        return index, least


def first_entries(vectors: DataFrame, parts: int, entries: int, dims: int, scale: float) -> np.ndarray:
    """(parts, entries, dims / parts): the parts of the kept vectors with the smallest ids, in their order."""
    x = F.col("embedding")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    x = whole_numbers(rows.toArrow().column("embedding"), dims, scale)[1].astype(np.int64)
    return x.reshape(len(x), parts, dims // parts).swapaxes(0, 1)


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64, scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits for each part), error (squared distances summed over the parts) of every kept vector, and the final codebooks."""
    if dims % parts or entries > MOST_ENTRIES or entries * dims > MOST_NUMBERS:
        raise ValueError(f"parts of equal length, at most {MOST_ENTRIES} entries of a part and {MOST_NUMBERS} numbers are needed")
    spark, vectors = vectors.sparkSession, vectors.select("vec_id", "label", "embedding")
    small_batches(spark)
    fields = [vectors.schema["vec_id"], vectors.schema["label"]]
    state_of = StructType([*fields, StructField("x", BinaryType()), StructField("codes", BinaryType()), StructField("part", LongType()), StructField("change", ArrayType(LongType()))])
    result_of = StructType([*fields, StructField("code", StringType()), StructField("error", LongType())])
    width = dims // parts
    with scratch(spark, keep=1) as paths:
        books = first_entries(vectors, parts, entries, dims, scale)
        if not books.shape[1]:
            return spark.createDataFrame([], result_of), books
        state = vectors

        def searched(batches: Iterator[pa.RecordBatch], books: np.ndarray, raw: bool) -> Iterator[tuple]:
            """The two first columns, vectors, codes and errors of batches of the table of vectors, or of a state."""
            found = [Codebook(b) for b in books]
            for batch in parts_of(batches):
                if raw:
                    kept, x = whole_numbers(batch.column("embedding"), dims, scale)
                    own = [batch.column(c).filter(pa.array(kept)) for c in ("vec_id", "label")]
                    old = np.zeros((len(x), parts), np.uint8)
                else:
                    own, x = [batch.column(c) for c in ("vec_id", "label")], unpacked(batch.column("x"), "<i4", dims)
                    old = unpacked(batch.column("codes"), "u1", parts)
                codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(found):
                    index, d2 = book.search(x[:, p * width : (p + 1) * width].astype(np.int64), old[:, p].astype(np.int64))
                    codes[:, p] = index
                    error += d2
                yield own, x, codes, error

        def step(books: np.ndarray, raw: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums, own = np.zeros((parts, books.shape[1], width + 1), np.int64), None
                for own, x, codes, _ in searched(batches, books, raw):
                    for p in range(parts):
                        np.add.at(sums[p], codes[:, p], np.c_[x[:, p * width : (p + 1) * width], np.ones(len(x), np.int64)])
                    yield pa.RecordBatch.from_arrays([*own, packed(x), packed(codes), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))], names=state_of.names)
                if own is not None:
                    empty = [*[pa.nulls(parts, c.type) for c in own], *[pa.nulls(parts, pa.binary())] * 2]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array(np.arange(parts)), pa.array(sums.reshape(parts, -1).tolist(), pa.list_(pa.int64()))], names=state_of.names)

            return run

        def last(books: np.ndarray, raw: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for own, _, codes, error in searched(batches, books, raw):
                    yield pa.RecordBatch.from_arrays([*own, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=result_of.names)

            return run

        for k in range(rounds):
            table = written(state.mapInArrow(step(books, k == 0), state_of), "codes", "zstd")
            drop_older(spark, paths, 1)
            by_part = summed(table.where("x IS NULL").select("part", "change"), "part", "change")
            sums = np.array([[by_part[p][i] for i in range(books.shape[1] * (width + 1))] for p in range(parts)], np.int64).reshape(parts, -1, width + 1)
            n = sums[:, :, width:]
            books = np.where(n > 0, sums[:, :, :width] // np.maximum(n, 1), books)
            state = table.where("x IS NOT NULL").select("vec_id", "label", "x", "codes")
        return written(state.mapInArrow(last(books, rounds == 0), result_of), "encoded", "zstd"), books


def with_label_errors(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with its error summed over equal labels, null ones together, and a digest of the codebooks."""
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= FEW_LABELS:
        joined = coded.join(F.broadcast(sums), same)
    else:
        salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = coded.withColumn("_own", F.pmod(F.xxhash64("code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_own") == F.col("_salt")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
