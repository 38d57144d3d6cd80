import random
import zlib
from collections import Counter

import numpy as np

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import castore, packing
from fieldloom.llm.tokens import WordEncoder, default_tokenizer, encoder, gathered

from .conftest import ROWS

ALPHABET = [" ", "  ", "\n", " \n", "\t", "a", "ab", "é", "1", "!", " ", "\x1c", "　", "'s", "'", "<|endoftext|>", "日", "²", "_", "ß,", "###", "x" * 60]


def plain_ids(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_apart_give_the_ids_of_the_whole():
    enc, rnd = encoder(default_tokenizer()), random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(12))) for _ in range(5000)]
    for text, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == plain_ids(text), text


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_packing_against_plain_python(odd):
    length, total, expected = 256, 0, []
    for doc_id, text in in_order(ROWS):
        ids = [*plain_ids(text), 1]
        at = 0
        while at < len(ids):
            sequence, offset = divmod(total + at, length)
            to = min(len(ids), at + length - offset)
            expected.append((doc_id, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4")), len(ids), sequence, offset))
            at = to
        total += len(ids)
    found = [tuple(r)[:7] for r in packing.pack(odd, length).collect()]
    assert Counter(found) == Counter(expected)


def test_packing_of_nothing(no_rows):
    assert packing.pack(no_rows).collect() == []


def test_store_round_trip(odd):
    store = castore.build(odd)
    expected = Counter((i, tuple([*plain_ids(t), 2])) for i, t in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in castore.reconstruct(store).collect()) == expected
    rows = castore.verify(store).collect()
    assert all(r.verified for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter({(i, len(x), zlib.crc32(np.array(x, "<u4"))): n for (i, x), n in expected.items()})
    starts = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in starts] == np.cumsum([0, *(r.n_tokens for r in starts[:-1])]).tolist()
    assert [r.doc_id or 0 for r in starts] == sorted(r.doc_id or 0 for r in starts)
    keys = [bytes(r.chunk_id) for r in store.chunks().collect()]
    assert len(keys) == len(set(keys))
    assert store.manifest().agg({"n_docs": "sum"}).first()[0] == len(ROWS)


@pytest.fixture(scope="module")
def store(odd):
    return castore.build(odd)


def verified(store, **tables):
    """verified by doc_id, after ``tables`` of a store were replaced."""
    changed = castore.Store(store.spark, store.path)
    for name, df in tables.items():
        setattr(changed, name, lambda df=df: df)
    return [(r.doc_id, r.verified) for r in castore.verify(changed).collect()]


LONG = "n_tokens > 50"
CHUNK_DAMAGE = {
    "changed": lambda c: c.withColumn("ids", F.when(F.expr(LONG), F.expr("overlay(ids placing X'FFFF' from 1)")).otherwise(F.col("ids"))),
    "emptied": lambda c: c.withColumn("ids", F.when(F.expr(LONG), F.lit(b"")).otherwise(F.col("ids"))),
    "null": lambda c: c.withColumn("ids", F.when(F.expr(LONG), F.lit(None).cast("binary")).otherwise(F.col("ids"))),
    "lengthened": lambda c: c.withColumn("ids", F.when(F.expr(LONG), F.concat("ids", F.lit(b"abc"))).otherwise(F.col("ids"))),
    "no tokens": lambda c: c.withColumn("n_tokens", F.when(F.expr(LONG), 0).otherwise(F.col("n_tokens"))),
    "lost": lambda c: c.where(f"NOT ({LONG})"),
    "doubled": lambda c: c.unionByName(c.where(LONG)),
}


@pytest.mark.parametrize("kind", CHUNK_DAMAGE)
def test_damaged_objects_are_seen(store, kind):
    found = verified(store, chunks=CHUNK_DAMAGE[kind](store.chunks()))
    assert {i for i, ok in found if not ok} == {9, 10} and len(found) == len(ROWS)


def in_part_of_10(store, change):
    """The recipes with ``change`` for document 10, and the doc_ids that may not be verified then: those of its part."""
    part = store.recipes().where("doc_id = 10").first().part
    return change(store.recipes()), {r.doc_id for r in store.recipes().where(F.col("part") == part).collect()}


OF_10 = "doc_id <=> 10"
RECIPE_DAMAGE = {
    "lost": lambda r: r.where("NOT doc_id <=> 10"),
    "doubled": lambda r: r.unionByName(r.where(OF_10)),
    "ends": lambda r: r.withColumn("ends", F.when(F.expr(OF_10), F.transform("ends", lambda e: e - 1)).otherwise(F.col("ends"))),
    "null chunks": lambda r: r.withColumn("chunks", F.when(~F.expr(OF_10), F.col("chunks"))),
    "renamed": lambda r: r.withColumn("doc_id", F.when(F.expr(OF_10), 11).otherwise(F.col("doc_id"))),
}


@pytest.mark.parametrize("kind", RECIPE_DAMAGE)
def test_damaged_recipes_are_seen(store, kind):
    changed, part = in_part_of_10(store, RECIPE_DAMAGE[kind])
    found = verified(store, recipes=changed)
    if kind == "null chunks":  # the part's root holds the document's root, which is still there
        part = {10}
    assert {11 if i == 10 and kind == "renamed" else i for i in part} - ({10} if kind == "lost" else set()) == {i for i, ok in found if not ok}


def test_a_recipe_with_the_root_of_another_is_seen(store):
    """A whole recipe (chunks, ends and root) takes the place of another: every digest of its own is right."""
    other = store.recipes().where("doc_id = 6").first()
    take = lambda r: r.withColumns({c: F.when(F.expr(OF_10), F.lit(v)).otherwise(F.col(c)) for c, v in (("n_tokens", other.n_tokens), ("root", bytes(other.root)))} | {c: F.when(F.expr(OF_10), F.array(*[F.lit(bytes(x) if c == "chunks" else x) for x in other[c]])).otherwise(F.col(c)) for c in ("chunks", "ends")})
    changed, part = in_part_of_10(store, take)
    assert {i for i, ok in verified(store, recipes=changed) if not ok} == part


def test_a_damaged_manifest_is_seen(store):
    m = store.manifest()
    for changed in (m.withColumn("root", F.lit(b"0" * 16)), m.withColumn("n_docs", F.lit(99).cast("bigint")), m.where("part <> 0"), m.limit(0)):
        assert not any(ok for _, ok in verified(store, manifest=changed))
    assert not any(ok for _, ok in verified(store, top=store.top().withColumn("root", F.lit(b"1"))))
    assert all(ok for _, ok in verified(store))


def test_streamed_roots():
    leaves, stream = [bytes([k]) for k in range(40)], castore.MerkleStream()
    for n, leaf in enumerate(leaves, 1):
        stream.add(leaf)
        assert stream.root() == castore.merkle(leaves[:n])


def test_empty_store(no_rows):
    assert castore.verify(castore.build(no_rows)).collect() == []


def test_chunks_depend_on_content_alone():
    rng, table = np.random.default_rng(3), castore.gear(50_000)
    ids = rng.integers(0, 50_000, 20_000)
    moved = np.concatenate([rng.integers(0, 50_000, 777), ids])
    cuts = lambda x: {castore.address(x[a:b]) for a, b in zip([0, *castore.chunk_ends(x, table)[:-1]], castore.chunk_ends(x, table), strict=True)}
    assert len(cuts(ids) & cuts(moved)) > 0.8 * len(cuts(ids))
    for x in (ids, ids[:1], ids[:64], np.zeros(9000, np.int64)):
        ends = castore.chunk_ends(x, table)
        assert ends[-1] == len(x) and max(np.diff([0, *ends])) <= castore.MOST


def test_crc_of_parts():
    rng = np.random.default_rng(4)
    data = rng.bytes(5000)
    cuts = [0, 17, 1000, 1001, 4000, 5000]
    parts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    after = np.array([5000 - b for b in cuts[1:]])
    assert np.bitwise_xor.reduce(castore.crc_shift(np.array([zlib.crc32(p) for p in parts]), after)) == zlib.crc32(data)


def test_late_chunks_are_stored_once(spark, odd, monkeypatch):
    """Where a partition has more addresses than a worker keeps: the same chunks, each once, and all verified."""
    docs = odd.select("doc_id", "text").unionByName(spark.range(60).selectExpr("100 + id AS doc_id", "repeat(concat('word', id % 7, ' and more '), 700) AS text")).repartition(6)
    usual = castore.build(docs)
    monkeypatch.setattr(castore, "ADDRESSES", 2)
    store = castore.build(docs)
    keys = lambda s: sorted((r.chunk_id, r.ids) for r in s.chunks().collect())
    assert keys(store) == keys(usual) and len({k for k, _ in keys(store)}) == len(keys(store)) > 8
    found = castore.verify(store).collect()
    assert all(r.verified for r in found) and len(found) == len(ROWS) + 60
