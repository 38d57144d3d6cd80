"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Lists of paths written inside the ``scratch`` blocks that this thread or task has open, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own if the session is local, else an error.

    On a cluster executors would write to a folder of their own machine, which the driver can't read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's file system is closed, or with the ``scratch`` block around."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, hadoop = _file_system(spark, path)
    system.deleteOnExit(hadoop)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, hadoop = _file_system(spark, path)
    system.delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[list[str]]:
    """Tables written inside are removed at the end, but for the last ``keep``, which belong to the block around.

    What the block returns must read none of the removed ones. The list of paths is given, so that loops can drop what they are done with.
    """
    paths: list[str] = []
    around = _OPEN.get()
    token = _OPEN.set((*around, paths))
    try:
        yield paths
    finally:
        _OPEN.reset(token)
        cut = len(paths) - keep
        for p in paths[:cut]:
            remove(spark, p)
        if around:
            around[-1].extend(paths[cut:])


def drop_older(spark: SparkSession, paths: list[str], most: int) -> None:
    """Removes all but the last ``most`` of a ``scratch`` block's tables."""
    while len(paths) > most:
        remove(spark, paths.pop(0))


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors. It counts as ``large``."""
    return large(stored(df, name, codec))


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """As ``written``, where Spark may take the table for a small one."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a relation that grows with the input: joins with it, or with what single-table steps make of it, don't take it to the driver, however well its files are compressed.

    Explicit broadcasts of small sides go before.
    """
    return df.hint("merge")
