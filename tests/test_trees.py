"""Euler tours against plain walks; cycles, orphans and deep chains."""

import random

import pytest

from fieldloom.operators import trees as tr

COLUMNS = "node_id long, parent_id long, is_left boolean"


def walk(rows):
    """root, pre, depth and size of every node that a root reaches."""
    kids, out = {}, {}
    for n, p, left in rows:
        kids.setdefault(p, []).append((not left, n))
    for _, root in sorted(kids.get(None, [])):
        stack, pre = [(root, 0)], 0
        while stack:
            n, depth = stack.pop()
            out[n] = [root, pre, depth, 1]
            pre += 1
            stack += [(k, depth + 1) for _, k in sorted(kids.get(n, []), reverse=True)]
    parents = {n: p for n, p, _ in rows}
    for n in sorted(out, key=lambda n: -out[n][2]):
        if parents[n] is not None:
            out[parents[n]][3] += out[n][3]
    return out


def test_tours_of_random_trees(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1000), 150)
    rows = [(n, None if k < 3 else ids[rng.randrange(k)], rng.random() < 0.5) for k, n in enumerate(ids)]
    # a cycle of three with a node below, a node that is its own parent, and one whose parent isn't there
    rows += [(2001, 2003, True), (2002, 2001, True), (2003, 2002, False), (2004, 2002, True), (2005, 2005, True), (2006, 9999, True), (2007, 2006, False)]
    tour = tr.toured(spark.createDataFrame(rows, COLUMNS))
    found = {r.node_id: [r.root, r.pre, r.depth, r.size] for r in tour.collect()}
    want = walk(rows)
    assert found == {n: want.get(n, [None] * 4) for n, _, _ in rows}
    top = next(n for n, v in want.items() if v[3] > 5 and v[2])
    inside = {n for n, v in want.items() if v[0] == want[top][0] and want[top][1] <= v[1] < want[top][1] + want[top][3]}
    assert {r.node_id for r in tr.below(tour, top).collect()} == inside
    assert {r.node_id for r in tr.without(tour, top).collect()} == {n for n, _, _ in rows} - inside


@pytest.mark.parametrize("n", [1, 5000])
def test_chains(spark, n):
    chain = spark.range(n).selectExpr("id AS node_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "id % 2 = 0 AS is_left")
    for r in tr.toured(chain).collect():
        assert (r.root, r.pre, r.depth, r.size) == (0, r.node_id, r.node_id, n - r.node_id)
    assert tr.toured(chain.limit(0)).count() == 0


def test_tours_with_stops(spark, monkeypatch):
    """Stops on two levels, a cycle among the arcs, and tasks that are as many as the arcs need."""
    monkeypatch.setattr(tr, "FEW", 60)
    monkeypatch.setattr(tr, "ARCS", 100)
    seen, put = [], tr.written

    def spied(df, name):
        out = put(df, name)
        seen.append((name, df.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(tr, "written", spied)
    rng = random.Random(5)
    rows = [(n, None if n < 2 else n - 1 if n > 300 else rng.randrange(n), rng.random() < 0.5) for n in range(600)]
    rows += [(n, 1000 + (n + 1) % 40, True) for n in range(1000, 1040)]
    found = {r.node_id: [r.root, r.pre, r.depth, r.size] for r in tr.toured(spark.createDataFrame(rows, COLUMNS)).collect()}
    want = walk(rows)
    assert found == {n: want.get(n, [None] * 4) for n, _, _ in rows}
    assert dict((name, parts) for name, parts, _ in seen)["children"] == 7
    # pointers that had come to a stop don't go on: not all of some 1,200 arcs are joined in a logarithm of rounds
    assert any(name == "stops" and count < 400 for name, _, count in seen)


def test_paths_end_on_cycles(spark):
    rows = [(0, None, False), (1, 0, True), (2, 1, False), (5, 6, True), (6, 5, True), (7, 6, False), (8, 77, True)]
    found = {r.node_id: (r.path, r.depth) for r in tr.with_paths(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == {0: ("", 0), 1: ("L", 1), 2: ("LR", 2), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}
