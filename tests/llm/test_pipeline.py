import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import mixing, quality, rules
from fieldloom.llm.tokens import default_tokenizer, encoder

from .conftest import ROWS
from .test_shingles import groups, plain

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage returns, each from all of its predecessor."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D).cache()
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_filters(spark, stages):
    scores = quality.quality_scores(stages[0], spark.read.parquet(f"{D}/labels.parquet"))
    assert ids(stages[1]) == ids(scores.where("score >= 0.5"))
    assert ids(stages[2]) == ids(rules.apply_policy(rules.ledger(stages[1]), "v1").where("kept"))
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == groups(rows)


def test_mixing_and_packing(stages):
    assert ids(stages[4]) == ids(mixing.replicate(stages[3]))
    enc = encoder(default_tokenizer())
    texts = [r.text for r in stages[4].orderBy("doc_id").collect()]
    lengths = [len(raw) // enc.dtype.itemsize + 1 for raw in enc.encode(texts)]
    pieces = stages[5].collect()
    assert sum(p.length for p in pieces) == sum(lengths)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, own in by_sequence.items():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
        assert sum(n for _, n in own) == 2048 or s == max(by_sequence)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.sequence_id, r.offset, r.doc_id, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, D).collect())) == sorted(map(key, stages[5].collect()))
    assert zlib.crc32(b"") == 0 and stages[5].where(F.col("length") <= 0).isEmpty()


def test_odd_documents(spark, odd, no_rows):
    """Each stage on nulls, empty, long and repeated texts: what stays, and that rows stay whole."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    whole = {(i, t) for i, t in ROWS}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, D)
        assert stage(spark, no_rows.select(docs.columns), D).collect() == []
        rows = found.collect()
        if name == "packing":
            enc = encoder(default_tokenizer())
            assert sum(r.length for r in rows) == sum(len(x) // enc.dtype.itemsize + 1 for x in enc.encode([t or "" for _, t in ROWS]))
            continue
        assert found.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= whole
        if name == "quality rules":
            assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 6, 7, 7, None], key=str)
        if name == "near-duplicates":
            assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 5, 6, 8, None, 9, 10], key=str)


def test_near_copies_are_caught(spark):
    """Of all pairs of similarity 0.8 or more, 0.9 at least (here: all) have one document left out, and only such documents go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    kept = set(ids(corpus_pipeline.dedup_stage(spark, docs, "")))
    holders = {}
    for i, s in texts.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for own in holders.values() if len(own) <= 200 for i in own for j in own if i < j}
    near = [(i, j) for i, j in pairs if 5 * len(texts[i] & texts[j]) >= 4 * len(texts[i] | texts[j])]
    caught = sum(not {i, j} <= kept for i, j in near)
    assert len(near) > 20 and caught >= 0.9 * len(near)
    assert set(texts) - kept <= {j for p in near for j in p} | {i for i, s in texts.items() if not s}


def test_packing_keeps_the_shuffle_of_mixing(spark):
    """Copies of a document are spread over the sequences, in the order of mixing."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat(concat('word ', id), 40)) AS text", "'en' AS lang", "CASE WHEN id = 7 THEN 'rare' ELSE 'hot' END AS source", "9L AS n_chars")
    pieces = corpus_pipeline.packing_stage(spark, corpus_pipeline.mixing_stage(spark, docs, D), D).where("starts_document").collect()
    found = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    assert found == [r.doc_id for r in mixing.replicate(docs).orderBy("order_key").collect()]
    assert found.count(7) > 100 and len({r.sequence_id for r in pieces if r.doc_id == 7}) > 0.8 * max(r.sequence_id for r in pieces)
