"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, scratch, shared_dir
from ..sources.shared import stored as written

__all__ = ["base_columns", "new_path", "scratch", "shared_dir", "small_batches", "text_groups", "written"]

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker.

    The setting stays, since plans read it when they run; a smaller bound of the caller's is kept (0 or less is none).
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def base_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, those that ``docs`` lacks as nulls; other columns (whatever their names) go."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    have = set(docs.columns)
    return docs.select(*[(docs[n] if n in have else F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def text_groups(texts: list[str | None], chars: int = 1_000_000):
    """(first, last) bounds of runs of texts with about ``chars`` characters; a longer text is a run of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and total + n > chars:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)
