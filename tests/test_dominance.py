"""Dominator trees and nearest common ancestors against brute force; rows and rounds on a long chain."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control, dominance, graph

KEYS = ["g"]


def graphs():
    """Random graphs (thin, busy), a chain, a ring, a ladder, an irreducible pair, self and repeated edges, unreached nodes."""
    out = {}
    for seed in range(10):
        rnd = random.Random(seed)
        out[seed] = [(rnd.randrange(12), rnd.randrange(12)) for _ in range((14, 20, 30)[seed % 3])]
    out[20] = [(i, i + 1) for i in range(11)]
    out[21] = [(i, (i + 1) % 9) for i in range(9)]
    out[22] = [(0, 1), (0, 2)] + [(i, j) for k in range(1, 12, 2) for i in (k, k + 1) for j in (k + 2, k + 3)]
    out[23] = [(0, 1), (0, 2), (1, 2), (2, 1), (2, 3), (3, 3), (3, 1), (0, 1), (7, 3), (3, 0)]
    out[24] = [(5, 6)]
    return out


GRAPHS = graphs()


def reach(es, start, without=None):
    seen, todo = {start} - {without}, [start]
    while todo:
        x = todo.pop()
        for a, b in es:
            if a == x and x != without and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def strict(es):
    """Pairs (node, dominator) from root 0."""
    alive = reach(es, 0)
    return {(v, x) for x in alive for v in alive - reach(es, 0, x) - {x}}


@pytest.fixture(scope="module", params=[dominance.WIDTH, 3])
def width(request):
    """Production bands, and bands so narrow that small graphs have several levels."""
    before, dominance.WIDTH = dominance.WIDTH, request.param
    yield request.param
    dominance.WIDTH = before


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(g, a, b) for g, es in GRAPHS.items() for a, b in es], "g int, src long, dst long").cache()


@pytest.fixture(scope="module")
def roots(spark):
    return spark.createDataFrame([(g, 0) for g in GRAPHS], "g int, node long").cache()


def test_tree_and_intervals(edges, roots, width):
    rows = dominance.dominator_tree(roots, edges, KEYS).collect()
    trees = {}
    for r in rows:
        trees.setdefault(r.g, {})[r.node] = r
    assert len(rows) == sum(len(t) for t in trees.values())
    for g, es in GRAPHS.items():
        want, tree = strict(es), trees[g]
        assert set(tree) == reach(es, 0)
        assert {(v, x) for v, a in tree.items() for x, b in tree.items() if b.first < a.first <= b.last} == want
        for v, r in tree.items():
            above = {x for w, x in want if w == v}
            # The nearest has all the others above itself.
            assert (r.parent is None) == (not above)
            assert not above or above - {r.parent} == {x for w, x in want if w == r.parent}


def test_pairs_and_steps(edges, roots):
    rows = graph.dominators(roots, edges, KEYS).collect()
    got = {(r.g, r.node, r.dom): r.steps for r in rows}
    assert len(got) == len(rows)
    for g, es in GRAPHS.items():
        want = strict(es)
        assert {(v, x) for h, v, x in got if h == g} == want
        for v, x in want:
            between = {y for w, y in want if w == v and (y, x) in want}
            assert got[g, v, x] == len(between) + 1


def test_nearest_common_ancestors(spark, width):
    rnd = random.Random(1)
    parent = {0: None}
    for i in range(1, 120):
        parent[i] = rnd.randrange(max(0, i - 3), i)
    line = lambda v: [v] + (line(parent[v]) if parent[v] is not None else [])
    # Depths may leave gaps.
    tree = spark.createDataFrame([(1, v, p, 3 * len(line(v)) - 3) for v, p in parent.items()], "g int, node int, parent int, depth int")
    pairs = [(1, rnd.randrange(120), rnd.randrange(120)) for _ in range(200)]
    met = dominance.nearest_common(spark.createDataFrame(pairs, "g int, x int, y int"), dominance.bands(tree, KEYS), KEYS)
    rows = met.collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.common == next(v for v in line(r.x) if v in line(r.y))


def test_no_edges_null_ends_and_lone_roots(spark):
    empty = spark.createDataFrame([], "g int, src long, dst long")
    none = spark.createDataFrame([], "g int, node long")
    assert dominance.dominator_tree(none, empty, KEYS).count() == 0
    lone = spark.createDataFrame([(1, 4)], "g int, node long")
    broken = spark.createDataFrame([(1, 4, None), (1, None, 4), (1, None, 5)], "g int, src long, dst long")
    for edges in (empty, broken):
        rows = dominance.dominator_tree(lone, edges, KEYS).collect()
        assert [(r.g, r.node, r.parent) for r in rows] == [(1, 4, None)]


def test_rows_and_rounds_on_a_long_chain(spark, monkeypatch):
    """1,000 blocks in a row with a diamond at every hundredth: tables are linear but for the links, rounds few."""
    es = [(1, i, i + 1) for i in range(1000)] + [(1, i, 2000 + i) for i in range(0, 1000, 100)]
    es += [(1, 2000 + i, i + 1) for i in range(0, 1000, 100)]
    written = []
    write = dominance.materialise

    def counted(df, name="table", path=None):
        out = write(df, name, path)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(dominance, "materialise", counted)
    monkeypatch.setattr("tidemark.operators.fixpoint.materialise", counted)
    root = spark.createDataFrame([(1, 0)], "g int, node int")
    rows = dominance.immediate_dominators(root, spark.createDataFrame(es, "g int, src int, dst int"), KEYS).collect()
    assert {r.node: r.parent for r in rows} == {
        0: None, **{i + 1: i for i in range(1000)}, **{2000 + i: i for i in range(0, 1000, 100)}
    }
    # Links over 2, 4, 8, ... nodes of chains are n log n rows, all else is linear.
    assert max(n for name, n in written if name != "dom_links") <= 3 * len(es)
    assert max(n for name, n in written if name == "dom_links") <= 10 * len(es)
    assert sum(name == "dom_moved" for name, _ in written) <= 2


def test_decided_blocks_and_stops(spark):
    """Interval tests and pointer doubling against pairs of post-dominators."""
    blocks, edges, hot = [], [], []
    for fn, es in GRAPHS.items():
        nodes = {n for e in es for n in e}
        blocks += [(1, fn, v, v == min(nodes), v == max(nodes)) for v in nodes]
        edges += [(1, fn, a, b) for a, b in set(es)]
        hot += [(1, fn, v) for v in nodes if v % 3 != 1]
    blocks = spark.createDataFrame(blocks, "module int, fn long, block int, is_entry boolean, is_exit boolean")
    edges = spark.createDataFrame(edges, "module int, fn long, src int, dst int")
    hot = spark.createDataFrame(hot, "module int, fn long, block int")
    pairs = {(r.fn, r.block, r.pdom): r.steps for r in graph.post_dominators(blocks, edges).collect()}
    tree = graph.post_dominator_tree(blocks, edges)
    decided = {(r.fn, r.block) for r in control.decided_blocks(blocks, edges, tree).collect()}
    stops = {(r.fn, r.start): r.stop for r in control.region_stops(hot, blocks, hot, tree).collect()}
    for fn, es in GRAPHS.items():
        nodes = {n for e in es for n in e}
        entry, last = min(nodes), max(nodes)
        for v in nodes:
            before = {a for a, b in es if b == v} | ({entry} if v != entry else set())
            assert ((fn, v) in decided) == all((fn, u, v) in pairs for u in before)
            if v % 3 != 1:
                fit = [(n, x) for (f, b, x), n in pairs.items() if (f, b) == (fn, v) and (x % 3 == 1 or x == last)]
                assert stops[fn, v] == (min(fit)[1] if fit else last)
    assert len(stops) == hot.count()
