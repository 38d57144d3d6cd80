"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code on 46 of the 64 bits: two perfect binary Golay codes [23,12], each of covering
radius 3. Every fingerprint has one home anchor within that radius in both blocks, and is replicated to every anchor within
covering radius plus threshold (the excess over both blocks at most the threshold). Of two fingerprints within the
threshold, one is thus replicated to the home of the other, and fingerprints are compared per anchor, residents against
visitors. Links then become components by repeated contraction to the smallest neighbour.

Copies share a fingerprint and are folded into one row before any of this; a fingerprint has at most 1 + 64 + 2016 others
within two bits, so links grow with the input even in one large group of near copies, and no set of all pairs is made.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; null doc_ids
count as larger than others for a component's smallest id; equal doc_ids keep one row for each input row; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import base_columns, scratch, small_batches, written

N, RADIUS, BLOCKS = 23, 3, (0, 23)
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles' XXH64, seed 42: a bit is 1 if it is set in over half of them."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), 42)
    whole = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(w) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    h = np.fromiter((xxh64_intdigest(whole[a:b], 42) for a, b in zip(begins, ends, strict=True)), np.uint64, len(ends))
    counts = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return base_columns(docs, "doc_id", "text").mapInArrow(hashed, "doc_id bigint, fp bigint")


def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = v.copy()
    for bit in range(N - 1, 10, -1):
        r ^= np.where(r >> bit & 1, GOLAY << (bit - 11), 0)
    return r


def near_codewords(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For an excess 0..threshold over the radius: error patterns ordered by syndrome, and where each syndrome's begin.

    A word of syndrome s has the codewords ``word ^ pattern`` for the patterns of syndrome s.
    """
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if not excess else [RADIUS + excess]
        patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(N), w)], np.int64)
        s = syndromes(patterns)
        order = np.argsort(s, kind="stable")
        out.append((patterns[order], np.searchsorted(s[order], np.arange(2049))))
    return out


def covered(fps: np.ndarray, threshold: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, index into ``fps``, home: every anchor within covering radius plus threshold of each fingerprint."""
    blocks = [(fps.view(np.uint64) >> np.uint64(b)).astype(np.int64) & ((1 << N) - 1) for b in BLOCKS]
    found = {}
    for k, v in enumerate(blocks):
        s = syndromes(v)
        for excess, (patterns, begins) in enumerate(tables):
            n = begins[s + 1] - begins[s]
            index = np.repeat(np.arange(len(v)), n)
            at = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[s], n)
            found[k, excess] = index, v[index] ^ patterns[at], np.cumsum(n) - n, n
    anchors, owners, homes = [], [], []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            i, x, _, _ = found[0, a]
            _, y, begins, n = found[1, b]
            reps = n[i]
            index = np.repeat(i, reps)
            at = np.arange(len(index)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(begins[i], reps)
            anchors.append(np.repeat(x, reps) | y[at] << N)
            owners.append(index)
            homes.append(np.full(len(index), a == b == 0))
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(homes)


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """a < b, each pair of different ``fps`` (column fp) at ``threshold`` or fewer differing bits, once."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = near_codewords(threshold)
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for i in range(0, len(values), 2048):
                part = values[i : i + 2048]
                anchor, owner, home = covered(part, threshold, tables)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[owner]), pa.array(home)], names=["anchor", "fp", "home"])

    rows = fps.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    residents = rows.where("home").select("anchor", F.col("fp").alias("a"))
    visitors = rows.select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # most residents meet no visitor: the hint keeps the many visitors out of a sort
    return residents.hint("shuffle_hash").join(visitors, "anchor").where(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex of the component, for every vertex of ``edges`` (a, b).

    Each round points every vertex at its smallest neighbour, follows these pointers to their ends and contracts the
    edges; the rounds grow with the logarithm of the vertices. Every round is written to the shared folder.
    """
    edges = written(edges, "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("v"), "p"), "pointers")
        while True:
            ends = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = written(pointers.join(ends, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            pointers = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        of = lambda name: pointers.select(F.col("v").alias(name), F.col("p").alias(f"{name}_root"))  # noqa: B023, E731
        joined = edges.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
        edges = written(joined.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        if mapping is None:
            mapping = pointers.select("v", F.col("p").alias("root"))
        else:
            mapping = written(mapping.join(pointers.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "mapping")
    return mapping if mapping is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def roots_of(fps: DataFrame, threshold: int) -> DataFrame:
    """fp, root: the smallest fingerprint of its component, for every different one of ``fps`` (fp)."""
    with scratch(fps.sparkSession, keep=1):
        classes = written(fps.select("fp").distinct(), "classes")
        found = components(links(classes, threshold))
        return written(classes.join(found.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row for each row of ``docs``."""
    rows = written(fingerprints(docs, words), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots_of(rows, threshold), "fp")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(rooted.join(ids, "root").select("fp", "component_id"), "class_ids")
    return rows.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null ids last, and of equal ids any one.

    Rows have keys of their own, so that documents without an id or with the same one are told apart.
    """
    small_batches(docs.sparkSession)
    names = [*docs.columns, "_fp"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], names=names)

    rows = written(docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("_fp", LongType())])).withColumn("_row", F.monotonically_increasing_id()), "hashed", "zstd")
    rooted = rows.select(F.col("_fp").alias("fp"), "doc_id", "_row").join(roots_of(rows.select(F.col("_fp").alias("fp")), threshold), "fp")
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    # as many keys as documents: never a broadcast, at any size
    return rows.join(written(kept.select("_row"), "kept").hint("merge"), "_row", "left_semi").select(docs.columns)
