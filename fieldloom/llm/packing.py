"""Packing by concatenate-and-cut: prefix sums over partition token totals give global offsets, then windows are cut.

Pass 1 sorts documents by id (or a given order) in range partitions, encodes each once and writes the ids with the running token count inside
the partition. Pass 2 sums the partitions (one row each), adds the sum of the partitions before, and cuts every document
where a multiple of the sequence length falls. No task sees more than its partition, and no id is encoded twice.

Defined cases: a null or empty text is one end id; null doc_ids sort first; equal doc_ids sort by a hash of their text and
stay separate documents; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import base_columns, small_batches, written
from .mixing import numbered
from .tokens import MEMO_WORDS, default_tokenizer, encoder, gathered

TOKENS = "part int, start_in_part bigint, doc_id bigint, doc_tokens bigint, width int, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, starts_document boolean, ends_document boolean"


def in_order(docs: DataFrame, order: Column | None = None) -> DataFrame:
    """doc_id and text (null: empty), range-partitioned and sorted by ``order``, then doc_id."""
    keys = [*([] if order is None else ["place"]), "doc_id", F.xxhash64("text")]
    rows = base_columns(docs, "doc_id", "text") if order is None else docs.select("doc_id", "text", order.alias("place"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def copies_apart(docs: DataFrame, place: Callable[[Column, Column], Column]) -> DataFrame:
    """doc_id, text and place, a function of doc_id and of the copy's number among equal rows.

    Equal rows are counted with partial sums, so a document with many copies is no large group; its copies are made again in blocks, one by one, and dealt by place.
    """
    counts = base_columns(docs, "doc_id", "text").groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("n"))
    copies = numbered(counts, "n", "copy")
    return copies.select("doc_id", "text", place(F.col("doc_id"), F.col("copy")).alias("place"))


def token_table(docs: DataFrame, tokenizer: str, end_id: int, memo_words: int = MEMO_WORDS, order: Column | None = None) -> DataFrame:
    """Written table TOKENS: each document's ids with its end id, and the tokens before it in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = encoder(tokenizer, memo_words), TaskContext.get().partitionId(), 0
        size = enc.dtype.itemsize
        for batch in gathered(batches):
            ids, n = enc.ended(batch.column("text"), end_id)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n) * size).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch.column("doc_id"), pa.array(n), pa.array(np.full(len(n), size, np.int32)), raw],
                names=["part", "start_in_part", "doc_id", "doc_tokens", "width", "ids"],
            )

    small_batches(docs.sparkSession)
    return written(in_order(docs, order).mapInArrow(encode, TOKENS), "tokens", "zstd")


def part_offsets(totals: DataFrame, part: str = "part", n: str = "n") -> DataFrame:
    """Tokens of all parts before each part. ``totals`` has one row for each partition written, so the window is small."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint").alias("base"))


def cut(tokens: DataFrame, length: int) -> DataFrame:
    """PIECES of the concatenation of ``tokens``, cut at every multiple of ``length``."""
    offsets = part_offsets(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, out = batch.column("start").to_numpy(), []
            raws, widths = batch.column("ids"), batch.column("width").to_numpy()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.frombuffer(raws[i].as_buffer(), f"<u{widths[i]}")
                start, n = int(starts[i]), len(ids)
                at = 0
                while at < n:
                    sequence, offset = divmod(start + at, length)
                    to = min(n, at + length - offset)
                    out.append((doc_id, at, to - at, zlib.crc32(ids[at:to].astype("<u4")), n, sequence, offset, at == 0, to == n))
                    at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if k > 6 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "starts_document", "ends_document"])

    # one row for each partition written: bounded by the number of tasks
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "width", "ids")
    return placed.mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 1, memo_words: int = MEMO_WORDS, order: Column | None = None) -> DataFrame:
    """Boundary records of ``docs`` packed into sequences of ``length`` tokens; only the last sequence needs padding.

    Documents follow each other by ``order`` (default: none), then by doc_id.
    """
    return cut(token_table(docs, tokenizer or default_tokenizer(), end_id, memo_words, order), length)
