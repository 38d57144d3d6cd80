import os
from itertools import combinations

import numpy as np
from xxhash import xxh64_intdigest

from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.common import new_path

from .conftest import ROWS


def plain(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest index reachable by links of at most two bits."""
    low = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, j in combinations(range(len(fps)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def test_fingerprints(odd, few):
    for _, t in ROWS:
        if len(t or "") < 20_000:
            assert simhash.fingerprint(t) == plain(t)
    for r in few[0].limit(40).collect():
        assert simhash.fingerprint(r.text) == plain(r.text)
    assert simhash.fingerprints(odd).count() == len(ROWS)


def test_every_pair_within_the_threshold_shares_an_anchor():
    rng = np.random.default_rng(7)
    tables = simhash.near_codewords(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= 1 << int(bit)
        fps = np.array([a, b], np.uint64).view(np.int64)
        anchor, owner, home = simhash.covered(fps, 2, tables)
        own = anchor[(owner == 0) & home]
        assert len(own) == 1 and own[0] in set(anchor[owner == 1].tolist())


def test_codewords_within_the_radius():
    """Every word of 23 bits has exactly one codeword within distance 3, and those at 4 and 5 are all found."""
    codewords = np.flatnonzero(simhash.syndromes(np.arange(1 << 23)) == 0)
    assert len(codewords) == 4096
    tables = simhash.near_codewords(2)
    for v in np.random.default_rng(1).integers(0, 1 << 23, 50):
        s = int(simhash.syndromes(np.array([v]))[0])
        distance = np.bitwise_count(codewords ^ v)
        for excess, (patterns, begins) in enumerate(tables):
            found = set((patterns[begins[s] : begins[s + 1]] ^ v).tolist())
            assert found == set(codewords[distance <= 3 if not excess else distance == 3 + excess].tolist())
        assert (distance <= 3).sum() == 1


def test_links_and_components_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 1 << 63, 30).tolist()
    fps = []
    for s in seeds:  # chains and clusters of neighbours
        x = s
        for _ in range(rng.integers(1, 12)):
            fps.append(x)
            for bit in rng.choice(64, rng.integers(1, 3), replace=False):
                x ^= 1 << int(bit)
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert edges == {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2}
    roots = {r.v: r.root for r in simhash.components(simhash.links(df)).collect()}
    low = components(fps)
    for i, j in combinations(range(len(fps)), 2):
        same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
        assert same == (low[i] == low[j])


def test_a_long_chain(spark):
    """Rounds of contraction cope with a path whose vertices are in order."""
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(df).collect()} == {0}


def test_documents(odd, no_rows):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert of[2, zero] == of[3, zero] == of[4, zero] == 2
    assert {c for (i, _), c in of.items() if i in (6, 7)} == {6}
    assert simhash.near_duplicates(no_rows).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 7 not in ids and 6 in ids and None in ids


def test_rows_without_an_id_or_with_the_same_one_are_told_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (6, text(4)), (4, text(3)), (7, text(5)), (7, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_n", F.lit(1))
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs.repartition(3)).collect()), key=str)
    assert kept == sorted([(None, text(1)), (None, text(2)), (4, text(3)), (5, text(4)), (7, text(5))], key=str)
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_scratch_tables_are_removed(spark, few):
    root = new_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert simhash.near_duplicates(few[0]).count() == few[0].count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"fingerprints", "roots", "class_ids"}
