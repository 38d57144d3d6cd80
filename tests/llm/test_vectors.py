import hashlib
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from fieldloom.llm import clusters, codes, queries
from fieldloom.llm.vectors import packed, unpacked, whole_numbers

COLUMNS = "vec_id long, embedding array<float>, label int, own int, x string, code string"


def kept(rows, dims, scale):
    return [(i, [math.floor(scale * v) for v in x], lab) for i, x, lab in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]


def plain_clusters(rows, k, rounds, dims, scale):
    v = kept(rows, dims, scale)
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, x, _ in order[:k]]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min((d2(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x, _ in v]
        for j in range(len(c)):
            mine = [x for (_, x, _), o in zip(v, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(t) // len(mine) for t in zip(*mine, strict=True)]
    return sorted(((i, *near(x)[::-1]) for i, x, _ in v), key=repr), c


def plain_codes(rows, parts, entries, rounds, dims, scale):
    v, w = kept(rows, dims, scale), dims // parts
    first = sorted(v, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(cut(x, p), e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(x, p)[1] for p in range(parts)] for _, x, _ in v]
        for p in range(parts):
            for j in range(len(first)):
                mine = [cut(x, p) for (_, x, _), o in zip(v, own, strict=True) if o[p] == j]
                if mine:
                    books[p][j] = [sum(t) // len(mine) for t in zip(*mine, strict=True)]
    found = [(i, lab, [near(x, p) for p in range(parts)]) for i, x, lab in v]
    return sorted(((i, lab, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n)) for i, lab, n in found), key=repr), books


def table(spark, rows):
    return spark.createDataFrame([(i, x, lab, 7, "clash", "clash") for i, x, lab in rows], COLUMNS).repartition(4)


def odd_rows(dims, n=400, seed=2):
    """Groups, ties on a coarse lattice, repeated rows, copies under other ids, missing ids, and all kinds of vectors that are left out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = np.round((centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dims))) * 2) / 2
    rows = [(int(i), v.astype(float).tolist(), int(i) % 3 if i % 5 else None) for i, v in enumerate(x)]
    rows += rows[:30] + [(1000 + i, rows[5][1], 1) for i in range(60)] + [(None, rows[3][1], None), (None, rows[8][1], 0)]
    bad = [None, [], [1.0] * (dims - 1), [1.0] * (dims + 1), [None] + [0.0] * (dims - 1), [float("nan")] * dims, [0.0] * (dims - 1) + [float("inf")]]
    return rows + [(2000 + i, b, 1) for i, b in enumerate(bad)]


@pytest.mark.parametrize("k,rounds,dims", [(8, 10, 8), (40, 4, 6), (1, 2, 4), (5, 0, 4), (900, 1, 2)])
def test_clusters_by_brute_force(spark, k, rounds, dims):
    rows = odd_rows(dims)
    found, centroids = clusters.cluster(table(spark, rows), k=k, rounds=rounds, dims=dims, scale=4.0)
    want, c = plain_clusters(rows, k, rounds, dims, 4.0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert centroids.tolist() == c


def test_inertia(spark):
    rows = odd_rows(4, 60)
    found = clusters.with_inertia(*clusters.cluster(table(spark, rows), k=3, rounds=2, dims=4, scale=4.0)).collect()
    want, c = plain_clusters(rows, 3, 2, 4, 4.0)
    for r in found:
        assert r.inertia == sum(d for *_, d in want) and r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
    assert len(found) == len(want)


@pytest.mark.parametrize("parts,entries,rounds,dims", [(4, 16, 2, 8), (2, 64, 3, 6), (1, 3, 1, 4), (4, 5, 0, 4), (2, 256, 1, 4)])
def test_codes_by_brute_force(spark, parts, entries, rounds, dims):
    rows = odd_rows(dims, 200)
    found, books = codes.encode(table(spark, rows), parts=parts, entries=entries, rounds=rounds, dims=dims, scale=4.0)
    want, plain = plain_codes(rows, parts, entries, rounds, dims, 4.0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert books.tolist() == plain


@pytest.mark.parametrize("few", [50_000, 1])
def test_label_errors(spark, monkeypatch, few):
    monkeypatch.setattr(codes, "FEW_LABELS", few)
    rows = odd_rows(4, 60)
    found = codes.with_label_errors(*codes.encode(table(spark, rows), parts=2, entries=8, dims=4, scale=4.0)).collect()
    want, books = plain_codes(rows, 2, 8, 2, 4, 4.0)
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    assert len(found) == len(want) and all(r.label_error == sums[r.label] for r in found) and None in sums
    assert {r.codebooks_sha256 for r in found} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_searches_look_at_few(monkeypatch):
    """Balls and bounds decide most: far fewer distances than vectors times centroids, and the same answer."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-5000, 5000, (200, 8))
    x = (middle[rng.integers(0, 200, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int32)
    seen, real = [0], clusters.squared
    monkeypatch.setattr(clusters, "squared", lambda a, b: (seen.__setitem__(0, seen[0] + max(len(a) if a.ndim > 1 else 1, 1)), real(a, b))[1])
    c = clusters.Centroids(middle.astype(np.int64))
    brute = ((x[:, None].astype(np.int64) - middle[None]) ** 2).sum(2)
    own, upper, lower = brute.argmin(1), np.full(3000, np.inf), np.zeros(3000)
    start, seen[0] = own.copy(), 0
    c.search(x, own, upper, lower)
    assert (own == start).all() and seen[0] < 3000 * 200 / 20
    seen[0] = 0
    c.search(x, own, upper, lower)
    assert seen[0] < 60  # bounds decide all but ties


def test_empty_tables_and_ranges(spark):
    none = table(spark, odd_rows(4, 20)).limit(0)
    bad = table(spark, [(1, None, 1), (2, [float("nan")] * 4, 0)])
    for df in (none, bad):
        assert clusters.with_inertia(*clusters.cluster(df, k=2, rounds=1, dims=4)).count() == 0
        assert codes.with_label_errors(*codes.encode(df, parts=2, entries=4, dims=4)).count() == 0
    with pytest.raises(ValueError):
        codes.encode(none, parts=3, dims=4)
    with pytest.raises(Exception, match="measured exactly"):
        clusters.cluster(table(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)]), k=1, dims=4)


def test_whole_numbers_of_slices():
    import pyarrow as pa

    a = pa.array([[1.0, 2.0], None, [0.5, -0.3], [None, 1.0], [3.0]], pa.list_(pa.float32()))
    keep, x = whole_numbers(a.slice(1), 2, 4.0)
    assert keep.tolist() == [False, True, False, False] and x.tolist() == [[2, -2]]
    b = packed(np.arange(12, dtype=np.int32).reshape(4, 3))
    assert unpacked(b.slice(2, 1), "<i4", 3).tolist() == [[6, 7, 8]]


def test_registered_queries_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").limit(10_000).collect()]
    want, _ = plain_codes(rows, 16, 64, 2, 64, 256.0)
    assert sorted((r.vec_id, r.code, r.error) for r in queries.op13_vector_codes(spark, d).collect()) == sorted((i, c, e) for i, _, c, e in want)
    found = queries.op12_centroid_clustering(spark, d).select("vec_id", "cluster", "distance").collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_clusters(rows, 8, 10, 64, 1024.0)[0])
    assert spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("embedding").isNull()).count() == 0
