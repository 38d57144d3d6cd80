"""Bit matrices as sets of true cells (row, col), or for dense ones in packed words (``Words``).

Defined cases: a cell that is there is true, however often it is given to ``of``; null conditions are false; an empty table is a matrix of false cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import large


@dataclass(frozen=True)
class Bits:
    """The true cells of a matrix, each once."""

    df: DataFrame
    n_rows: int
    n_cols: int

    def _new(self, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> Bits:
        return Bits(df.select("row", "col"), self.n_rows if n_rows is None else n_rows, self.n_cols if n_cols is None else n_cols)

    def _same(self, other: Bits) -> None:
        if (self.n_rows, self.n_cols) != (other.n_rows, other.n_cols):
            raise ValueError("dimensions differ")

    def __and__(self, other: Bits) -> Bits:
        self._same(other)
        return self._new(self.df.join(other.df, ["row", "col"], "left_semi"))

    def __or__(self, other: Bits) -> Bits:
        self._same(other)
        return self._new(self.df.unionByName(other.df).distinct())

    def __xor__(self, other: Bits) -> Bits:
        """One shuffle: cells that only one of both has."""
        self._same(other)
        return self._new(self.df.unionByName(other.df).groupBy("row", "col").agg(F.count("*").alias("n")).where("n = 1"))

    def __invert__(self) -> Bits:
        return self._new(grid(self.df.sparkSession, self.n_rows, self.n_cols).join(self.df, ["row", "col"], "left_anti"))

    def set(self, cells: DataFrame) -> Bits:
        return self._new(self.df.unionByName(cells.select("row", "col")).distinct())

    def clear(self, cells: DataFrame) -> Bits:
        return self._new(self.df.join(cells, ["row", "col"], "left_anti"))

    def block(self, first_row: int, first_col: int, n_rows: int, n_cols: int) -> Bits:
        inside = F.col("row").between(first_row, first_row + n_rows - 1) & F.col("col").between(first_col, first_col + n_cols - 1)
        return self._new(self.df.where(inside).select((F.col("row") - first_row).alias("row"), (F.col("col") - first_col).alias("col")), n_rows, n_cols)

    def row(self, i: int) -> Bits:
        return self.block(i, 0, 1, self.n_cols)

    def col(self, j: int) -> Bits:
        return self.block(0, j, self.n_rows, 1)

    def top_rows(self, n: int) -> Bits:
        return self.block(0, 0, n, self.n_cols)

    def bottom_rows(self, n: int) -> Bits:
        return self.block(self.n_rows - n, 0, n, self.n_cols)

    def left_cols(self, n: int) -> Bits:
        return self.block(0, 0, self.n_rows, n)

    def right_cols(self, n: int) -> Bits:
        return self.block(0, self.n_cols - n, self.n_rows, n)

    def assign(self, first_row: int, first_col: int, other: Bits) -> Bits:
        """With the block at this place replaced."""
        inside = F.col("row").between(first_row, first_row + other.n_rows - 1) & F.col("col").between(first_col, first_col + other.n_cols - 1)
        moved = other.df.select((F.col("row") + first_row).alias("row"), (F.col("col") + first_col).alias("col"))
        return self._new(self.df.where(~inside).unionByName(moved))

    def summary(self) -> DataFrame:
        """n, all, any."""
        return self.df.agg(F.count("*").alias("n")).select("n", (F.col("n") == self.n_rows * self.n_cols).alias("all"), (F.col("n") > 0).alias("any"))

    def which(self, value: bool = True) -> DataFrame:
        """idx, row by row, of the cells with this value."""
        cells = self if value else ~self
        return cells.df.select((F.col("row") * self.n_cols + F.col("col")).alias("idx"))

    def select(self, entries: DataFrame) -> DataFrame:
        """The entries (row, col, value) at true cells."""
        return entries.join(self.df, ["row", "col"], "left_semi").select("row", "col", "value")

    def repeat(self, down: int, right: int) -> Bits:
        tiles = F.explode(F.array(*[F.struct(F.lit(i * self.n_rows).alias("r"), F.lit(j * self.n_cols).alias("c")) for i in range(down) for j in range(right)]))
        return self._new(self.df.withColumn("t", tiles).select((F.col("row") + F.col("t.r")).alias("row"), (F.col("col") + F.col("t.c")).alias("col")), self.n_rows * down, self.n_cols * right)

    def reshape(self, n_rows: int, n_cols: int) -> Bits:
        if n_rows * n_cols != self.n_rows * self.n_cols:
            raise ValueError("sizes differ")
        idx = F.col("row") * self.n_cols + F.col("col")
        return self._new(self.df.select(F.floor(idx / n_cols).cast("bigint").alias("row"), (idx % n_cols).alias("col")), n_rows, n_cols)

    def vector_view(self) -> Bits:
        return self.reshape(self.n_rows * self.n_cols, 1)

    def resize(self, n_rows: int, n_cols: int) -> Bits:
        """All false."""
        return self._new(self.df.limit(0), n_rows, n_cols)

    def equals(self, other: Bits) -> bool:
        return (self.n_rows, self.n_cols) == (other.n_rows, other.n_cols) and (self ^ other).df.isEmpty()


def grid(spark: SparkSession, n_rows: int, n_cols: int) -> DataFrame:
    """All cells, from one range."""
    return spark.range(n_rows * n_cols).select(F.floor(F.col("id") / n_cols).cast("bigint").alias("row"), (F.col("id") % n_cols).alias("col"))


def ones(spark: SparkSession, n_rows: int, n_cols: int) -> Bits:
    return Bits(grid(spark, n_rows, n_cols), n_rows, n_cols)


def identity(spark: SparkSession, n: int) -> Bits:
    return Bits(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col")), n, n)


def of(entries: DataFrame, n_rows: int, n_cols: int, condition: Column | None = None) -> Bits:
    """Cells of the entries (row, col, value) that aren't zero, or that meet a condition."""
    true = condition if condition is not None else F.col("value") != 0
    return Bits(entries.where(true).select("row", "col").distinct(), n_rows, n_cols)


# ---------------------------------------------------------------- packed words

WORD = 64
#: Words that a task sums at most, about.
SPREAD = 1_000_000


@dataclass(frozen=True)
class Words:
    """The same matrices as ``Bits`` in words of 64 columns: rows (row, word, bits) of words that aren't zero, each once.

    Operations are bitwise expressions and aggregates of words, so dense matrices have a row for 64 cells and not for each. A complement is the same words with ``flipped`` set:
    operations and counts work on what is stored, and only ``cells`` of a complement makes its words, as many as the matrix has.
    """

    df: DataFrame
    n_rows: int
    n_cols: int
    flipped: bool = False
    #: Tasks that sum words; Spark would merge them by the size of what it shuffles, which is a small part of what a sum holds.
    tasks: int = 1

    @property
    def n_words(self) -> int:
        return -(-self.n_cols // WORD)

    def _new(self, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None, flipped: bool = False) -> Words:
        return Words(df.where("bits <> 0").select("row", "word", "bits"), self.n_rows if n_rows is None else n_rows, self.n_cols if n_cols is None else n_cols, flipped, self.tasks)

    def _with(self, other: Words, of: Callable[[Column, Column], Column], flipped: bool = False) -> Words:
        """``of`` the stored bits of both, absent words as zeros: one sum by word."""
        if (self.n_rows, self.n_cols) != (other.n_rows, other.n_cols):
            raise ValueError("dimensions differ")
        none = F.lit(0).cast("bigint")
        sides = self.df.select("row", "word", F.col("bits").alias("a"), none.alias("b")).unionByName(other.df.select("row", "word", none.alias("a"), F.col("bits").alias("b")))
        tasks = max(self.tasks, other.tasks)
        both = sides.repartition(tasks, "row", "word").groupBy("row", "word").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
        out = self._new(both.select("row", "word", of(F.col("a"), F.col("b")).alias("bits")), flipped=flipped)
        return replace(out, tasks=tasks)

    def __and__(self, other: Words) -> Words:
        if self.flipped and other.flipped:
            return self._with(other, lambda a, b: a.bitwiseOR(b), True)
        if self.flipped:
            return other & self
        return self._with(other, lambda a, b: a.bitwiseAND(F.bitwise_not(b) if other.flipped else b))

    def __or__(self, other: Words) -> Words:
        if self.flipped or other.flipped:
            return ~(~self & ~other)
        return self._with(other, lambda a, b: a.bitwiseOR(b))

    def __xor__(self, other: Words) -> Words:
        return self._with(other, lambda a, b: a.bitwiseXOR(b), self.flipped != other.flipped)

    def _inside(self, n_cols: int) -> Column:
        """The columns of a word that a matrix of ``n_cols`` columns has."""
        left = F.lit(n_cols) - F.col("word") * WORD
        ones = F.lit(-1).cast("bigint")
        return F.when(left >= WORD, ones).otherwise(F.call_function("shiftrightunsigned", ones, (WORD - left).cast("int"))) if n_cols % WORD else ones

    def __invert__(self) -> Words:
        return replace(self, flipped=not self.flipped)

    def _plain(self) -> Words:
        """Without ``flipped``: of a complement a row for each word of the matrix, whatever it holds."""
        if not self.flipped:
            return self
        i = F.col("id")
        grid = self.df.sparkSession.range(self.n_rows * self.n_words).select(F.floor(i / self.n_words).cast("bigint").alias("row"), (i % self.n_words).alias("word"))
        known = grid.join(self.df, ["row", "word"], "left")
        return self._new(known.withColumn("bits", F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint"))).bitwiseAND(self._inside(self.n_cols))))

    def clear(self, other: Words) -> Words:
        """Without the true cells of ``other``."""
        return self & ~other

    def block(self, row: int, col: int, n_rows: int, n_cols: int) -> Words:
        """The block from (row, col) on: words shifted by the odd part of the column, the two halves of a word added by bits. Cells outside of the matrix are false."""
        if self.flipped and (row < 0 or col < 0 or row + n_rows > self.n_rows or col + n_cols > self.n_cols):
            return self._plain().block(row, col, n_rows, n_cols)
        skip, odd = divmod(col, WORD)
        at, bits = F.col("word") - skip, F.col("bits")
        halves = [F.struct(at.alias("word"), F.shiftrightunsigned(bits, odd).alias("bits"))]
        if odd:
            halves.append(F.struct((at - 1).alias("word"), F.shiftleft(bits, WORD - odd).alias("bits")))
        cut = self.df.where(F.col("row").between(row, row + n_rows - 1)).select((F.col("row") - row).alias("row"), F.explode(F.array(*halves)).alias("h")).select("row", "h.*")
        cut = cut.where(F.col("word").between(0, -(-n_cols // WORD) - 1)).groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))
        return self._new(cut.withColumn("bits", F.col("bits").bitwiseAND(self._inside(n_cols))), n_rows, n_cols, self.flipped)

    def summary(self) -> DataFrame:
        """n (true cells), all and any: one row."""
        n = F.coalesce(F.sum(F.bit_count("bits").cast("bigint")), F.lit(0))
        if self.flipped:
            n = F.lit(self.n_rows * self.n_cols).cast("bigint") - n
        return self.df.agg(n.alias("n")).select("n", (F.col("n") == self.n_rows * self.n_cols).alias("all"), (F.col("n") > 0).alias("any"))

    def row_counts(self) -> DataFrame:
        """row, n: true cells of every row that has any."""
        counts = self.df.groupBy("row").agg(F.sum(F.bit_count("bits").cast("bigint")).alias("n"))
        if not self.flipped:
            return counts
        rows = self.df.sparkSession.range(self.n_rows).withColumnRenamed("id", "row").join(large(counts), "row", "left")
        return rows.select("row", (F.lit(self.n_cols).cast("bigint") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")

    def cells(self) -> DataFrame:
        """(row, col) of the true cells."""
        own = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("bits", k) == 1)
        return self._plain().df.select("row", "word", F.explode(own).alias("k")).select("row", (F.col("word") * WORD + F.col("k")).alias("col"))


def packed(cells: DataFrame, n_rows: int, n_cols: int) -> Words:
    """Words of true cells (row, col), repeated ones once; cells outside of the matrix, or with a null, are left out."""
    inside = cells.where(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1))
    bit = F.expr("shiftleft(1L, cast(col % 64 AS int))")
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-inside.count() // SPREAD))
    words = inside.select(F.col("row").cast("bigint").alias("row"), F.floor(F.col("col") / WORD).cast("bigint").alias("word"), bit.alias("bit")).repartition(tasks, "row", "word")
    return Words(words.groupBy("row", "word").agg(F.bit_or("bit").alias("bits")), n_rows, n_cols, tasks=tasks)
