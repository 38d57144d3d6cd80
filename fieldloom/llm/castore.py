"""Content-addressed token store: rolling-hash chunks, unique chunks once, document recipes, Merkle manifests.

Layout of a store (Parquet): ``objects``, of kind "chunk" (key, ids, n_tokens), each different chunk once; ``recipes`` (part, row,
doc_id, n_tokens, start_in_part, chunks, ends, root, part_root) in ascending doc_id order; ``manifest`` (part, n_docs, n_tokens,
root), one Merkle root for each part of the recipes; ``top`` (n_parts, root), the Merkle root over the parts. A chunk's address is the
BLAKE2b digest of its ids as little-endian unsigned 32-bit integers, so reading verifies itself. A document's root is that of its
chunks' addresses; a part's root is that of its recipes' digests (id, tokens, chunk ends, root), in their order.

Reading trusts nothing: a document is verified if its chunks have their addresses, its recipe gives its root, the recipes of
its part give the part's root and counts in the manifest, and the manifest gives the root on top.

Defined cases: a null or empty text is one end id; null doc_ids come first; equal doc_ids stay separate documents, in the
order of their roots; an empty table gives an empty store; columns other than doc_id and text are ignored. Lost, doubled, swapped,
emptied or lengthened objects and recipes make ``verified`` false and raise nothing; recipes that are lost have no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base_columns, new_path, small_batches, written
from .packing import part_offsets
from .tokens import MEMO_WORDS, default_tokenizer, encoder, gathered

#: Chunk bounds in tokens: least, most, and the mask whose zero bits of the rolling hash make a cut (1 of 512 on average).
LEAST, MOST, MASK, WINDOW = 64, 4096, np.uint64(0x1FF << 54), 8
#: Addresses that a task remembers so as not to shuffle a frequent chunk again and again.
REMEMBERED = 200_000
#: Addresses of a shuffle partition that a worker keeps (some 100 bytes each); further ones are told apart by a second shuffle.
ADDRESSES = 1_000_000
RECIPES = "part int, row bigint, doc_id bigint, n_tokens bigint, start_in_part bigint, chunks array<binary>, ends array<bigint>, root binary, part_root binary"
MANIFEST = "part int, n_docs bigint, n_tokens bigint, root binary"
TOP = "n_parts bigint, root binary"
OBJECTS = "kind string, key binary, ids binary, doc_id bigint, n_tokens bigint, chunks array<binary>, ends array<bigint>"


def gear(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each token id (splitmix64)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_marks(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW ids says cut."""
    g = table[ids]
    h = g.copy()
    for j in range(1, min(WINDOW, len(ids))):
        h[j:] += g[:-j] << np.uint64(8 * j)
    return np.flatnonzero((h & MASK) == 0) + 1


def bounded(marks: list[int], begin: int, n: int) -> list[int]:
    """Ends of the chunks from ``begin`` to ``n`` by the ``marks`` inside, at least LEAST and at most MOST ids each."""
    ends = []
    for c in marks:
        while c - begin > MOST:
            begin += MOST
            ends.append(begin)
        if c - begin >= LEAST:
            ends.append(begin := c)
    while n - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def chunk_ends(ids: np.ndarray, table: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of ``ids``: a cut depends on the last WINDOW ids alone, but for LEAST and MOST."""
    return bounded(cut_marks(ids, table).tolist(), 0, len(ids))


def address(ids: np.ndarray) -> bytes:
    return digest(ids.astype("<u4").tobytes())


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Binary Merkle root; an odd node goes up unchanged."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """``merkle`` of leaves that come one by one; holds one node for each power of two."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size = 1
        while self.nodes and self.nodes[-1][0] == size:
            leaf, size = digest(self.nodes.pop()[1] + leaf), 2 * size
        self.nodes.append((size, leaf))

    def root(self) -> bytes:
        if not self.nodes:
            return b""
        out = self.nodes[-1][1]
        for _, node in self.nodes[-2::-1]:
            out = digest(node + out)
        return out


def recipe_digest(doc_id: int | None, n_tokens: int | None, ends: list[int | None] | None, root: bytes | None) -> bytes:
    return digest(b"|".join([repr((doc_id, n_tokens, ends)).encode(), root or b""]))


@cache
def crc_tables() -> np.ndarray:
    """[bit of the length][byte][value]: tables that append 2**bit zero bytes to a CRC-32 (its linear part)."""
    one = np.array([zlib.crc32(b"\0", i ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in (1 << np.arange(32, dtype=np.uint64)).tolist()], np.uint32)
    out = np.zeros((40, 4, 256), np.uint32)
    for bit in range(40):
        for byte in range(4):
            for k in range(8):
                out[bit, byte, (np.arange(256) >> k & 1) == 1] ^= one[8 * byte + k]
        one = through(out[bit], one)
    return out


def through(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the CRC-32 of a stream in which ``n_bytes`` bytes follow; these add up by XOR."""
    crc, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for bit, t in enumerate(crc_tables()):
        if (on := (n >> bit & 1) == 1).any():
            crc[on] = through(t, crc[on])
    return crc


@dataclass
class Store:
    """Paths of a written store; every method reads them back."""

    spark: SparkSession
    path: str

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(OBJECTS).parquet(f"{self.path}/objects").where("kind = 'chunk'").select(F.col("key").alias("chunk_id"), "ids", "n_tokens")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(RECIPES).parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def top(self) -> DataFrame:
        return self.spark.read.schema(TOP).parquet(f"{self.path}/top")


def build(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, path: str | None = None, memo_words: int = MEMO_WORDS) -> Store:
    """Encode ``docs`` and write a store under ``path`` (default: a fresh path in the shared folder); ``memo_words`` words of a worker's memo are some 60 bytes each."""
    spark = docs.sparkSession
    tokenizer, path = tokenizer or default_tokenizer(), path or new_path(spark, "castore")
    small_batches(spark)

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer, memo_words), set()
        table = gear(enc.tokenizer.get_vocab_size() + end_id + 1)
        size, kinds = enc.dtype.itemsize, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        for batch in gathered(batches):
            ids, counts = enc.ended(batch.column("text"), end_id)
            # a hash that reaches into the document before marks the first WINDOW - 1 ids only, where no chunk may end
            marks, stops = cut_marks(ids, table), np.cumsum(counts)
            first = np.searchsorted(marks, stops - counts, side="right").tolist()
            last = np.searchsorted(marks, stops, side="right").tolist()
            stored, wide, marks = memoryview(ids).cast("B"), memoryview(ids.astype("<u4")).cast("B"), marks.tolist()
            out, begin = [], 0
            for doc_id, stop, i, j in zip(batch.column("doc_id").to_pylist(), stops.tolist(), first, last, strict=True):
                keys, start, ends = [], begin, bounded(marks[i:j], begin, stop)
                for e in ends:
                    key = digest(wide[4 * begin : 4 * e])
                    keys.append(key)
                    if key not in seen:  # copies meet here first, so that few rows of a frequent chunk are shuffled
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(key)
                        out.append(("chunk", key, bytes(stored[size * begin : size * e]), None, e - begin, None, None))
                    begin = e
                out.append(("recipe", merkle(keys), None, doc_id, stop - start, keys, [e - start for e in ends]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "key", "ids", "doc_id", "n_tokens", "chunks", "ends"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # addresses of a partition, at most ADDRESSES; what comes after them is told apart later
        for batch in batches:
            kinds, keep = batch.column("kind").to_pylist(), []
            for i, key in enumerate(batch.column("key").to_pylist()):
                keep.append(kinds[i] == "recipe" or key not in seen)
                if kinds[i] == "chunk" and keep[-1]:
                    if len(seen) < ADDRESSES:
                        seen.add(key)
                    else:
                        kinds[i] = "late"
            out = batch.set_column(batch.schema.get_field_index("kind"), "kind", pa.array(kinds, pa.string()))
            yield out.filter(pa.array(keep, pa.bool_()))

    rows = base_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spread = F.when(F.col("kind") == "recipe", F.xxhash64("key", "doc_id")).otherwise(F.xxhash64("key"))
    one_pass = rows.mapInArrow(objects, OBJECTS).withColumn("spread", spread)
    one_pass.repartition("spread").drop("spread").mapInArrow(once, OBJECTS).write.option("compression", "lz4_raw").parquet(f"{path}/objects")
    made = spark.read.schema(OBJECTS).parquet(f"{path}/objects")
    late = made.where("kind = 'late'")
    if not late.isEmpty():
        # copies of a late chunk are all late: a partition's chunks meet in the order of the shuffle, and none of these was remembered
        late.repartition("key").dropDuplicates(["key"]).withColumn("kind", F.lit("chunk")).write.mode("append").option("compression", "lz4_raw").parquet(f"{path}/objects")
    made.where("kind = 'recipe'").select("doc_id", "n_tokens", "chunks", "ends", F.col("key").alias("root")).repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").mapInArrow(_numbered, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    store = Store(spark, path)
    # the root after a part's last recipe is the part's
    store.recipes().groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max_by("part_root", "row").alias("root")).write.parquet(f"{path}/manifest")
    _top(store.manifest()).write.parquet(f"{path}/top")
    return store


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part, the row in it, the tokens before it in the part, and the part's Merkle root up to it."""
    from pyspark import TaskContext

    part, row, before, stream = TaskContext.get().partitionId(), 0, 0, MerkleStream()
    names = ["part", "row", "doc_id", "n_tokens", "start_in_part", "chunks", "ends", "root", "part_root"]
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        starts, roots = before + np.cumsum(n) - n, []
        for leaf in _digests(b):
            stream.add(leaf)
            roots.append(stream.root())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), b.column("doc_id"), b.column("n_tokens"), pa.array(starts), b.column("chunks"), b.column("ends"), b.column("root"), pa.array(roots, pa.binary())], names=names)
        row, before = row + len(n), before + int(n.sum())


def _digests(b: pa.RecordBatch) -> list[bytes]:
    return list(map(recipe_digest, *(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ends", "root"))))


def _top(manifest: DataFrame) -> DataFrame:
    """One row: the number of parts and the root over their rows in the manifest, of which there is one for each partition written."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [merkle([digest(repr((x["part"], x["n_docs"], x["n_tokens"], x["root"])).encode()) for x in parts]) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("n_parts"), pa.array(roots, pa.binary())], names=["n_parts", "root"])

    parts = F.sort_array(F.collect_list(F.struct("part", "n_docs", "n_tokens", "root")))
    return manifest.agg(F.count("*").alias("n_parts"), parts.alias("parts")).mapInArrow(fold, TOP)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored chunk: whether its bytes have its address, and their CRC-32."""
    for b in batches:
        out = []
        for key, raw, n in zip(b.column("chunk_id").to_pylist(), b.column("ids").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
            width = len(raw) // n if raw and n and n > 0 else 0
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4") if width in (2, 4) and width * n == len(raw) else np.zeros(0, "<u4")
            out.append((key, len(ids) > 0 and address(ids) == key, zlib.crc32(ids), len(ids)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["chunk_id", "intact", "crc", "n"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = crc_shift(b.column("crc").to_numpy(), 4 * b.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("row"), b.column("intact"), b.column("n"), pa.array(crc.astype(np.int64))], names=["part", "row", "intact", "n", "crc"])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "row", "doc_id", "start_in_part", "n_tokens", "root", "proof", "leaf"]
    for b in batches:
        proof = [c is not None and None not in c and merkle(c) == r for c, r in zip(b.column("chunks").to_pylist(), b.column("root").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:6]), pa.array(proof, pa.bool_()), pa.array(_digests(b), pa.binary())], names=names)


def part_roots(leaves: DataFrame) -> DataFrame:
    """MANIFEST as the recipes (part, row, n_tokens, leaf) give it, by one sorted pass over each part."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stream, n_docs, n_tokens, out = None, MerkleStream(), 0, 0, []

        def close() -> None:
            if n_docs:
                out.append((part, n_docs, n_tokens, stream.root()))

        for b in batches:
            for p, row, n, leaf in zip(*(b.column(c).to_pylist() for c in ("part", "row", "n_tokens", "leaf")), strict=True):
                if p != part:
                    close()
                    part, stream, n_docs, n_tokens = p, MerkleStream(), 0, 0
                stream.add(leaf if row == n_docs else b"")  # rows are counted from 0 without gaps
                n_docs, n_tokens = n_docs + 1, n_tokens + (n or 0)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "n_docs", "n_tokens", "root"])

    return leaves.select("part", "row", "n_tokens", "leaf").repartition("part").sortWithinPartitions("part", "row").mapInArrow(fold, MANIFEST)


def references(store: Store) -> DataFrame:
    """part, row, chunk_id, pos, after: each chunk of each recipe, and the tokens that follow it in its document."""
    spread = store.recipes().select("part", "row", "n_tokens", F.posexplode(F.arrays_zip("chunks", "ends")).alias("pos", "c"))
    return spread.select("part", "row", "pos", F.col("c.chunks").alias("chunk_id"), F.greatest(F.coalesce(F.col("n_tokens") - F.col("c.ends"), F.lit(0)), F.lit(0)).alias("after"))


def verify(store: Store) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, n_chunks, root (hex), verified.

    The ids' CRC-32 is put together from those of the stored chunks, so no ids are shuffled. ``verified``: all chunks
    are there once with the bytes of their addresses, their addresses give the document's Merkle root, and the recipes give the
    manifest, which gives the root on top.
    """
    # a doubled object counts as damaged; written, so that a chunk that many documents share is a skewed join that Spark can split
    measured = written(store.chunks().mapInArrow(_measured, "chunk_id binary, intact boolean, crc bigint, n bigint").groupBy("chunk_id").agg((F.bool_and("intact") & (F.count("*") == 1)).alias("intact"), F.max("crc").alias("crc"), F.max("n").alias("n")), "measured")
    parts = references(store).join(measured, "chunk_id", "left").withColumns({"crc": F.coalesce("crc", F.lit(0)), "n": F.coalesce("n", F.lit(0)), "intact": F.coalesce("intact", F.lit(False))})
    shifted = parts.select("part", "row", "intact", "n", "crc", "after").mapInArrow(_shifted, "part int, row bigint, intact boolean, n bigint, crc bigint")
    whole = shifted.groupBy("part", "row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"), F.count("*").alias("n_chunks"), F.bool_and("intact").alias("intact"))
    manifest = store.manifest()
    docs = written(store.recipes().mapInArrow(_proved, "part int, row bigint, doc_id bigint, start_in_part bigint, n_tokens bigint, root binary, proof boolean, leaf binary"), "proofs")
    same = ["part", *[F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")).alias(f"same_{c}") for c in ("n_docs", "n_tokens", "root")]]
    checked = manifest.alias("m").join(part_roots(docs).alias("r"), "part", "left").select(*same)
    top = _top(manifest).join(store.top(), ["n_parts", "root"], "left_semi").agg((F.count("*") > 0).alias("topped"))
    offsets = part_offsets(manifest, n="n_tokens").join(checked.select("part", (F.col("same_n_docs") & F.col("same_n_tokens") & F.col("same_root")).alias("listed")), "part")
    # offsets: one row for each part; top: one row
    return docs.join(whole, ["part", "row"], "left").join(F.broadcast(offsets), "part", "left").crossJoin(F.broadcast(top)).select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lower(F.hex("root")).alias("root"),
        F.coalesce(F.col("intact") & F.col("proof") & (F.col("n") == docs["n_tokens"]) & F.col("listed") & F.col("topped"), F.lit(False)).alias("verified"),
    )


def reconstruct(store: Store) -> DataFrame:
    """Per document: doc_id, part, row and its ids as an array, put together from the stored chunks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int32) for raw, n in zip(b.column("ids").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("row"), b.column("pos"), pa.array(ids, pa.list_(pa.int32()))], names=["part", "row", "pos", "ids"])

    pieces = references(store).select("part", "row", "pos", "chunk_id").join(store.chunks(), "chunk_id").select("part", "row", "pos", "ids", "n_tokens").mapInArrow(decode, "part int, row bigint, pos int, ids array<int>")
    whole = pieces.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p")).select("part", "row", F.flatten("p.ids").alias("ids"))
    return store.recipes().select("part", "row", "doc_id").join(whole, ["part", "row"])
