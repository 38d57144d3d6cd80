"""Text sources: labelled CSV tables, sparse triplets, Matrix Market files and mesh folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coo import Coo
from ..operators.frame import ROW, number_rows
from ..operators.mesh import AXES, Mesh

NOT_A_NUMBER = ("NA", "NaN", "nan")


def clean(token: Column) -> Column:
    """A token as a number: without blanks and quotes, the marks of missing values as NaN."""
    t = F.regexp_replace(token, '[ "]', "")
    return F.when(t.isin(*NOT_A_NUMBER), F.lit(float("nan"))).otherwise(t.try_cast("double"))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the columns of a CSV file, without that of the label; from its first line."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return [n.strip(' "') for n in first.value.split(",")][1:]


def number(token: Column, integer: bool = False) -> Column:
    """``clean``, or an error that shows the token if it is no number; no token is no number of its own (null). Of integers, NaN is 0."""
    value = clean(token)
    bad = value.isNull() & (F.regexp_replace(token, '[ "]', "") != "")
    value = F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), token))).otherwise(value)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).cast("bigint") if integer else value


def read_dense(spark: SparkSession, path: str, names: list[str] | None = None, integer: bool = False) -> DataFrame:
    """row_id and the columns of a CSV file whose first column is a label; the header is skipped, and gives the names if none are given.

    Labels that are all whole numbers count from 1 and give the row ids; others are dropped, and rows are numbered in the order of the file.
    A token that isn't a number is an error; NA, NaN and nan are NaN.
    """
    names = header_of(spark, path) if names is None else names
    schema = ", ".join(["label string", *(f"`{n}` string" for n in names)])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    label = F.regexp_replace("label", '[ "]', "").try_cast("bigint")
    if rows.agg(F.bool_and(label.isNotNull())).first()[0] is not False:
        rows = rows.withColumn(ROW, label - 1)
    else:
        rows = number_rows(rows.withColumn("_at", F.monotonically_increasing_id()), "_at")
    return rows.select(ROW, *[number(F.col(f"`{n}`"), integer).alias(n) for n in names])


def read_triplets(spark: SparkSession, path: str) -> Coo:
    """A CSV file of label, row, column and value, ids from 1; dimensions are the largest ids, repeated places add up. Any other number of columns is an error."""
    if len(found := header_of(spark, path)) != 3:
        raise ValueError(f"a label and three columns are needed, not {len(found)}")
    t = read_dense(spark, path, ["row", "col", "value"])
    m = Coo(t.select((F.col("row") - 1).cast("bigint").alias("row"), (F.col("col") - 1).cast("bigint").alias("col"), "value"), 0, 0).summed()
    size = m.df.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return Coo(m.df, (size["r"] if size["r"] is not None else -1) + 1, (size["c"] if size["c"] is not None else -1) + 1)


def read_matrix_market(spark: SparkSession, path: str) -> Coo:
    """A real general coordinate file, ids from 1."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("i"))
    size = parts.orderBy("i").first()
    n_rows, n_cols = int(size.p[0]), int(size.p[1])
    entries = parts.where(F.col("i") != size.i).select(*[(F.col("p")[k].cast("bigint") - 1).alias(n) for k, n in enumerate(("row", "col"))], F.col("p")[2].cast("double").alias("value"))
    return Coo(entries, n_rows, n_cols)


def read_mesh(spark: SparkSession, folder: str, order: int = 2, space: int = 2) -> Mesh:
    """Nodes and cells of a folder with points.csv and elements.csv; ids from 1 become ids from 0."""
    points = read_dense(spark, f"{folder}/points.csv", list(AXES[:space])).withColumnRenamed("row_id", "node_id")
    names = [f"v{i}" for i in range(order + 1)]
    cells = read_dense(spark, f"{folder}/elements.csv", names, integer=True)
    return Mesh(points, cells.select(F.col("row_id").alias("cell_id"), *[(F.col(n) - 1).alias(n) for n in names]), order)


def rebased(df: DataFrame, *names: str) -> DataFrame:
    """Ids from 1 as ids from 0, what isn't positive as -1."""
    return df.withColumns({n: F.when(F.col(n) > 0, F.col(n) - 1).otherwise(F.lit(-1)).cast("bigint") for n in names})
