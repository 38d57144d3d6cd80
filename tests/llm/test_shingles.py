from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm import shingles, simhash

from .conftest import ROWS


def plain(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows):
    """The smallest id of each group of rows (id, text), by all pairs."""
    sets, low = [plain(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b) and low[i] != low[j]:
            old, new = max(low[i], low[j]), min(low[i], low[j])
            low = [new if x == old else x for x in low]
    members = {}
    for (i, _), root in zip(rows, low, strict=True):
        members.setdefault(root, []).append(i)
    return sorted(min(m) for m in members.values())


def near_copies(copies=40):
    """Texts of 60 to 400 words with copies of one to nine changed words, and texts that only share a passage."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage, texts = words(40), []
    for size in (60, 120, 400):
        base = words(size)
        for _ in range(copies):
            w = list(base)
            for at in rng.integers(0, size, rng.integers(1, 10)):
                w[at] = f"n{rng.integers(1 << 40)}"
            texts.append(w)
        texts += [words(size) + passage for _ in range(10)]
    order = rng.permutation(len(texts)).tolist()
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize(("few", "hot", "rounds", "classes"), [(shingles.FEW, 10_000, 3, 500_000), (3, 10_000, 1, 500_000), (3, 5, 3, 1), (shingles.FEW, shingles.HOT, 3, 500_000), (2, 5, 2, 500_000)])
def test_groups_against_all_pairs(spark, monkeypatch, few, hot, rounds, classes):
    """Also where most lists are long or hot, and where sets are found by a shuffle of the texts."""
    monkeypatch.setattr(shingles, "FEW", few)
    monkeypatch.setattr(shingles, "HOT", hot)
    monkeypatch.setattr(shingles, "ROUNDS", rounds)
    monkeypatch.setattr(shingles, "FEW_CLASSES", classes)
    monkeypatch.setattr(shingles, "BLOCK", 1024 if few > 3 else 7)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == groups(rows)


def chained(n, seed=8):
    """Families in which each text changes a few words of the one before, so that ends aren't similar, and two families a step too far from each other."""
    rng = np.random.default_rng(seed)
    rows, base = [], [f"w{x}" for x in rng.integers(0, 3000, 150)]
    for family in range(3):
        w = list(base)
        for at in range(0, 5 * family):
            w[at * 7] = f"f{family}x{at}"
        for k in range(n):
            w[int(rng.integers(0, 150))] = f"c{family}x{k}"
            rows.append((family * n + k, " ".join(w)))
    return rows


def test_chains_of_small_changes(spark, monkeypatch):
    """One representative sees few of a chain; the rest is linked across components."""
    monkeypatch.setattr(shingles, "FEW", 4)
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rows = chained(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == groups(rows)


def test_across_gives_a_forest_of_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.r_[base[: 50 - k % 9], rng.integers(0, 1 << 60, k % 9).astype(np.uint64)]) for k in range(40)]
    roots = np.arange(40) // 2
    found = shingles.across(sets[:10], sets[10:], roots[:10], roots[10:], 0.8)
    low = list(range(20))
    for pairs in (found,):
        for a, b in pairs:
            low = [min(low[a], low[b]) if x in (low[a], low[b]) else x for x in low]
    want = list(range(20))
    for i in range(10):
        for j in range(10, 40):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 10 * c >= 8 * (len(sets[i]) + len(sets[j]) - c):
                a, b = want[roots[i]], want[roots[j]]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert low == want and len(found) == 20 - len(set(want))


def test_near_copies_of_one_text_grow_in_proportion(spark, monkeypatch):
    """Comparisons of sets for four times the copies: some four times as many, none in blocks."""
    seen, real = [], shingles.by_representatives
    monkeypatch.setattr(shingles, "by_representatives", lambda m, *a: (seen.append(m.select("_class").distinct().count()), out := real(m, *a), seen.append(sum(x.count() for x in out)))[1])
    for n in (300, 1200):
        rng = np.random.default_rng(6)
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            w = list(base)
            for at in rng.integers(0, 200, 3):
                w[at] = f"n{i}x{at}"
            rows.append((i, " ".join(w)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert [r.doc_id for r in shingles.keep_one(docs).collect()] == [0]
    assert seen[0] == 300 and seen[2] == 1200 and seen[3] <= 1.2 * 4 * seen[1] and seen[3] < 1200 * 3


def test_stage_finds_near_copies_that_are_many_bits_apart(spark):
    """Documents 1 and 177 have similarity 0.83 and fingerprints 17 bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert (simhash.fingerprint(texts[1], 5) ^ simhash.fingerprint(texts[177], 5)).bit_count() == 17
    kept = [r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert sorted(kept) == groups(sorted(texts.items())) and 1 in kept and 177 not in kept


def test_odd_rows(odd, no_rows):
    kept = shingles.keep_one(odd)
    assert kept.columns == odd.columns and shingles.keep_one(no_rows).collect() == []
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 5, 6, 8, None, 9, 10], key=str)
    for _, t in ROWS:
        assert len(shingles.shingles(t)) == len(plain(t.replace("\x1c", "x") if t else t))


def test_a_shared_passage_makes_no_candidates(spark, monkeypatch):
    """Pairs of texts with a fifth in common share shingles of their lists, but not enough for their places in the order; copies with one other word do."""
    seen, real = [], shingles.candidates
    monkeypatch.setattr(shingles, "candidates", lambda *a: (out := real(*a), seen.append(out.count()))[0])
    rng = np.random.default_rng(11)
    texts = [[f"t{i}x{k}" for k in range(160)] + [f"p{i // 2}x{k}" for k in range(40)] for i in range(30)]
    alone = [[f"a{i}x{k}" for k in range(200)] for i in range(4)]
    texts += alone + [[*t[:70], f"other{i}", *t[71:]] for i, t in enumerate(alone)]
    rows = [(int(i), " ".join(texts[k])) for i, k in enumerate(rng.permutation(len(texts)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == groups(rows)
    assert seen == [4]


def test_far_copies_of_one_text_are_compared_once(spark, monkeypatch):
    """Of a text with near copies and with copies too far from all others, sets are sent for each copy and block, not for each of their lists."""
    seen, real = {}, shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, name, *a: (out := real(df, name, *a), seen.update({name: out.count()}))[0])
    rng = np.random.default_rng(12)
    base, rows = [f"w{x}" for x in rng.integers(0, 5000, 300)], []
    for i in range(260):
        w = list(base)
        for k, at in enumerate(rng.permutation(300)[: 3 if i < 200 else 9 + i % 4]):
            w[at] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == groups(rows)
    assert seen["long"] > 20 * 260 and seen.get("facing", seen["mixed"]) <= 2 * 260
