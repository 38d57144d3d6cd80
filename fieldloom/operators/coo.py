"""Sparse matrices in coordinate form: DataFrames (row, col, value) with their dimensions.

Defined cases: an absent entry is zero; a null value counts as zero in sums and products, and a place with only such values has a null;
NaN stays NaN; entries without a row or column meet nothing in products; entries of one place add up; an empty table is a matrix of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import large


@dataclass(frozen=True)
class Coo:
    """Entries (row LONG, col LONG, value DOUBLE) of a matrix; entries of one place add up in ``summed``."""

    df: DataFrame
    n_rows: int
    n_cols: int

    def _new(self, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> Coo:
        return Coo(df, self.n_rows if n_rows is None else n_rows, self.n_cols if n_cols is None else n_cols)

    def summed(self) -> Coo:
        return self._new(self.df.groupBy("row", "col").agg(F.sum("value").alias("value")))

    def prune(self, at_most: float = 0.0) -> Coo:
        """Without entries of up to this size."""
        return self._new(self.df.where(F.abs("value") > at_most))

    def transpose(self) -> Coo:
        return self._new(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), self.n_cols, self.n_rows)

    def scale(self, s: float) -> Coo:
        return self._new(self.df.withColumn("value", F.col("value") * float(s)))

    def plus(self, other: Coo) -> Coo:
        if (self.n_rows, self.n_cols) != (other.n_rows, other.n_cols):
            raise ValueError("dimensions differ")
        return self._new(self.df.unionByName(other.df)).summed()

    def times_vector(self, x: DataFrame) -> DataFrame:
        """(idx, value) of the product with a sparse vector (idx, value); it grows with the matrix, so it is ``large``."""
        products = large(self.df).join(x.select(F.col("idx").alias("col"), F.col("value").alias("x")), "col")
        return large(products.groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("x")).alias("value")))

    def times(self, other: Coo) -> Coo:
        right = other.df.select(F.col("row").alias("col"), F.col("col").alias("to"), F.col("value").alias("y"))
        products = large(self.df).join(right, "col").groupBy("row", F.col("to").alias("col")).agg(F.sum(F.col("value") * F.col("y")).alias("value"))
        return self._new(products, n_cols=other.n_cols)

    def kronecker(self, other: Coo) -> Coo:
        """row = a.row * rows of b + b.row, and so for columns: every entry of one meets every entry of the other by definition."""
        b = other.df.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))
        entries = self.df.crossJoin(b).select((F.col("row") * other.n_rows + F.col("r")).alias("row"), (F.col("col") * other.n_cols + F.col("c")).alias("col"), (F.col("value") * F.col("v")).alias("value"))
        return self._new(entries, self.n_rows * other.n_rows, self.n_cols * other.n_cols)

    def lump(self) -> Coo:
        """Diagonal matrix of the row sums."""
        if self.n_rows != self.n_cols:
            raise ValueError("a square matrix is needed")
        return self._new(self.df.groupBy("row").agg(F.sum("value").alias("value")).select("row", F.col("row").alias("col"), "value"))

    def symmetric_from_lower(self) -> Coo:
        low = self.df.where("row >= col")
        return self._new(low.unionByName(low.where("row > col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value")))

    def block(self, first_row: int, first_col: int, n_rows: int, n_cols: int) -> Coo:
        inside = F.col("row").between(first_row, first_row + n_rows - 1) & F.col("col").between(first_col, first_col + n_cols - 1)
        return self._new(self.df.where(inside).select((F.col("row") - first_row).alias("row"), (F.col("col") - first_col).alias("col"), "value"), n_rows, n_cols)

    def replace_rows(self, rows: DataFrame) -> Coo:
        """The rows of ``rows`` (row) become those of the identity."""
        unit = rows.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))
        return self._new(large(self.df).join(rows, "row", "left_anti").select("row", "col", "value").unionByName(unit))

    def non_zeros(self) -> int:
        return self.df.count()


def identity(spark: SparkSession, n: int) -> Coo:
    return Coo(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value")), n, n)


def from_dense(df: DataFrame, columns: list[str], n_rows: int, row: str = "row_id") -> Coo:
    """Non-zero entries of a wide table with a row id."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
    return Coo(df.select(F.col(row).alias("row"), cells.alias("x")).select("row", "x.col", "x.value").where("value <> 0"), n_rows, len(columns))


def block_matrix(blocks: list[list[Coo | None]]) -> Coo:
    """A grid of blocks as one matrix; None is a block of zeros. Heights agree along rows, widths along columns."""
    heights = [{b.n_rows for b in r if b} for r in blocks]
    widths = [{r[j].n_cols for r in blocks if r[j]} for j in range(len(blocks[0]))]
    if any(len(x) != 1 for x in [*heights, *widths]):
        raise ValueError("dimensions of blocks differ")
    tall, wide = [next(iter(x)) for x in heights], [next(iter(x)) for x in widths]
    out = None
    for i, r in enumerate(blocks):
        for j, b in enumerate(r):
            if b:
                moved = b.df.select((F.col("row") + sum(tall[:i])).alias("row"), (F.col("col") + sum(wide[:j])).alias("col"), "value")
                out = moved if out is None else out.unionByName(moved)
    return Coo(out, sum(tall), sum(wide))
