"""A typed column-block frame over a DataFrame with an explicit row id.

Defined cases: nulls and NaN are values like others; equal rows are told apart by their row id; ids that a gather asks for and that aren't there have no row; an empty table is a frame of no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import large, written

ROW = "row_id"


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Dense row ids from 0 in a total order, without a window over all rows.

    Rows are range-partitioned by the order and written with their partition and place in it; then each is moved by the rows
    of the partitions before.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_seq"))
    ranged = written(ranged, "numbered")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return large(ranged.join(F.broadcast(starts), "_part").withColumn(ROW, (F.col("_base") + F.col("_seq")).cast("bigint")).drop("_part", "_seq", "_base"))


class BlockFrame:
    """Columns (numbers, or arrays for blocks of several columns) of rows 0 to n - 1.

    Every method that changes anything returns a new frame; ranges include both of their ends.
    """

    def __init__(self, df: DataFrame, dirty: Sequence[str] = ()):
        if ROW not in df.columns:
            raise ValueError(f"a frame needs the column {ROW}")
        self.df, self._dirty = df, frozenset(dirty)

    @staticmethod
    def of(df: DataFrame, *order: str) -> BlockFrame:
        """Rows of ``df`` numbered in a total order."""
        return BlockFrame(number_rows(df, *order))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def rows(self) -> int:
        return self.df.count()

    def has_block(self, key: str) -> bool:
        return key in self.columns

    def _need(self, *keys: str) -> None:
        if missing := [k for k in keys if k not in self.columns]:
            raise KeyError(f"no block {missing}")

    def insert(self, key: str, values: DataFrame | Column, dirty: bool = True) -> BlockFrame:
        """Add or replace a block: an expression over the frame, or a DataFrame (row_id, key) with as many rows."""
        if isinstance(values, Column):
            df = self.df.withColumn(key, values)
        else:
            mine, theirs = self.df.drop(key), values.select(ROW, key)
            df = mine.join(theirs, ROW, "full")
            strays = df.select(F.count_if(F.col(key).isNull()).alias("n"), F.count("*").alias("all")).first()
            if strays["all"] != self.rows() or strays["all"] != theirs.count():
                raise ValueError("numbers of rows differ")
        return BlockFrame(df, self._dirty | {key} if dirty else self._dirty - {key})

    def stack(self, key: str) -> DataFrame:
        """The block's columns below each other: row_id = column * rows + row."""
        self._need(key)
        return self.df.select(ROW, F.posexplode(key).alias("_c", key)).select((F.col("_c") * F.lit(self.rows()) + F.col(ROW)).alias(ROW), key)

    def get(self, *keys: str) -> DataFrame:
        """One block, or several beside each other as one array."""
        self._need(*keys)
        if len(keys) == 1:
            return self.df.select(ROW, keys[0])
        kinds = dict(self.df.dtypes)
        return self.df.select(ROW, F.concat(*[F.col(k) if kinds[k].startswith("array") else F.array(k) for k in keys]).alias("block"))

    def column(self, key: str, index: int) -> DataFrame:
        """One column of a block."""
        self._need(key)
        return self.df.select(ROW, F.get(key, F.lit(index)).alias(key))

    def unique(self, key: str) -> DataFrame:
        """Different values in the order in which they first occur."""
        self._need(key)
        firsts = self.df.groupBy(key).agg(F.min(ROW).alias("first"))
        return number_rows(firsts, "first").select(ROW, key)

    def where(self, condition: Column) -> BlockFrame:
        return BlockFrame(self.df.where(condition), self._dirty)

    def row(self, index: int) -> BlockFrame:
        return self.where(F.col(ROW) == index)

    def range(self, begin: int, end: int) -> BlockFrame:
        return self.where(F.col(ROW).between(begin, end))

    def head(self, end: int) -> BlockFrame:
        return self.where(F.col(ROW) <= end)

    def tail(self, begin: int) -> BlockFrame:
        return self.where(F.col(ROW) >= begin)

    def gather(self, index: DataFrame) -> BlockFrame:
        """Rows by an index (pos, row_id), in its order and with its repetitions; ``source_id`` is the row they come from."""
        taken = index.select("pos", F.col(ROW).alias("source_id")).join(self.df.withColumnRenamed(ROW, "source_id"), "source_id")
        return BlockFrame(taken.withColumnRenamed("pos", ROW), self._dirty)

    def extract(self) -> BlockFrame:
        """The rows of a view, numbered anew."""
        return BlockFrame(number_rows(self.df.withColumnRenamed(ROW, "_old"), "_old").drop("_old"), self._dirty)

    def index(self) -> DataFrame:
        return self.df.select(ROW)

    def shuffle(self, seed: int = 0) -> BlockFrame:
        """A permutation of the rows that depends on the seed alone."""
        dealt = number_rows(self.df.withColumnRenamed(ROW, "_old").withColumn("_key", F.xxhash64("_old", F.lit(seed))), "_key", "_old")
        return BlockFrame(dealt.drop("_key", "_old"), self._dirty)

    def remove(self, key: str) -> BlockFrame:
        self._need(key)
        return BlockFrame(self.df.drop(key), self._dirty - {key})

    def dirty_columns(self) -> list[str]:
        return [c for c in self.columns if c in self._dirty]

    def is_dirty(self, key: str) -> bool:
        return key in self._dirty

    def clear_dirty_bit(self, key: str) -> BlockFrame:
        return BlockFrame(self.df, self._dirty - {key})


class BlockVector:
    """n blocks of m numbers as (idx, value); a zero that isn't stored is a zero."""

    def __init__(self, df: DataFrame, n: int, m: int):
        self.df, self.n, self.m = df, n, m

    def blocks(self, first: int, count: int = 1) -> DataFrame:
        """``count`` blocks from ``first``, with idx from 0."""
        low = first * self.m
        return self.df.where(F.col("idx").between(low, low + count * self.m - 1)).select((F.col("idx") - low).alias("idx"), "value")

    def head(self, count: int) -> DataFrame:
        return self.blocks(0, count)

    def tail(self, count: int) -> DataFrame:
        return self.blocks(self.n - count, count)

    def dense(self) -> DataFrame:
        """All n * m numbers."""
        grid = self.df.sparkSession.range(self.n * self.m).withColumnRenamed("id", "idx")
        return grid.join(self.df, "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))
