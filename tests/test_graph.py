"""Graph operators against brute force on small random graphs."""

from __future__ import annotations

import itertools
import random

import pytest

from tidemark.operators import graph
from tidemark.operators.fixpoint import chase, pace

KEYS = ["module", "fn"]


def random_graph(seed, n=9, m=13):
    rnd = random.Random(seed)
    return {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}


GRAPHS = {fn: random_graph(fn) for fn in range(6)}


def reach(edges, start, avoid=None):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen and b != avoid:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, fn, a, b) for fn, es in GRAPHS.items() for a, b in es]
    return spark.createDataFrame(rows, "module int, fn long, src int, dst int").cache()


def nodes_of(es):
    return set(itertools.chain(*es))


def test_scc(edges):
    got = {(r.fn, r.node): r.comp for r in graph.scc(edges, KEYS).collect()}
    want = {}
    for fn, es in GRAPHS.items():
        for v in nodes_of(es):
            mine = reach(es, v)
            want[fn, v] = min(u for u in mine if v in reach(es, u))
    assert got == want


def test_cut_vertices(edges):
    got = {(r.fn, r.node) for r in graph.cut_vertices(edges).collect()}
    want = set()
    for fn, es in GRAPHS.items():
        both = {(a, b) for a, b in es if a != b} | {(b, a) for a, b in es if a != b}
        for v in nodes_of(both):
            part = reach(both, v) - {v}
            if part and reach({e for e in both if v not in e}, min(part)) != part:
                want.add((fn, v))
    assert got == want


def test_post_dominators(spark, edges):
    blocks = spark.createDataFrame(
        [(1, fn, v, v == 0, v in (7, 8)) for fn, es in GRAPHS.items() for v in nodes_of(es)],
        "module int, fn long, block int, is_entry boolean, is_exit boolean",
    )
    got = {(r.fn, r.block, r.pdom) for r in graph.post_dominators(blocks, edges).collect()}
    want = set()
    for fn, es in GRAPHS.items():
        exits = nodes_of(es) & {7, 8}
        for v in nodes_of(es):
            if not reach(es, v) & exits:
                continue
            for x in nodes_of(es) - {v}:
                if not reach(es, v, avoid=x) & (exits - {x}):
                    want.add((fn, v, x))
    assert got == want


def test_propagate_equals_condensed_and_grows(spark, edges):
    seeds = [(1, fn, min(nodes_of(es)), 4, -1) for fn, es in GRAPHS.items()]
    seeds += [(1, fn, max(nodes_of(es)), 3, 0) for fn, es in GRAPHS.items()]
    schema = "module int, fn long, node int, level int, ref int"
    df = spark.createDataFrame(seeds, schema)
    every = edges.selectExpr("module", "fn", "src as node").union(edges.selectExpr("module", "fn", "dst")).distinct()
    label = lambda facts: {(r.fn, r.node): (r.level, r.args) for r in graph.node_labels(every, facts, KEYS).collect()}
    plain = label(graph.propagate(df, edges, KEYS))
    assert plain == label(graph.resolve_condensed(df, edges, KEYS))
    shuffled = edges.repartition(3).sortWithinPartitions("dst")
    assert plain == label(graph.propagate(df.repartition(2), shuffled, KEYS))
    more = df.union(spark.createDataFrame([(1, 0, 3, 4, -1)], schema))
    grown = label(graph.propagate(more, edges, KEYS))
    assert all(grown[k][0] >= plain[k][0] for k in plain)
    for fn, es in GRAPHS.items():
        for v in reach(es, min(nodes_of(es))):
            assert plain[fn, v][0] == 4


def test_chase_follows_long_chains_and_leaves_cycles_out(spark):
    links = [(1, i, i + 1) for i in range(40)] + [(1, 100, 101), (1, 101, 102), (1, 102, 100)]
    df = spark.createDataFrame(links, "module int, src int, dst int")
    got = {r.src: (r.end, r.steps) for r in chase(df, ["module"]).collect()}
    assert got == {i: (40, 40 - i) for i in range(40)}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    from tidemark.operators import fixpoint

    rounds = []
    add = fixpoint._Rounds.add
    monkeypatch.setattr(fixpoint._Rounds, "add", lambda self, df: rounds.append(1) or add(self, df))
    line = spark.createDataFrame([(1, i, i + 1) for i in range(200)], "module int, src int, dst int")
    start = spark.createDataFrame([(1, 0)], "module int, node int")
    assert graph.reachable(start, line, ["module"]).count() == 201
    assert len(rounds) < 12


def test_pace_sees_hubs(spark):
    hub = [(1, i, 500) for i in range(60)] + [(1, 500, 600 + i) for i in range(60)]
    assert pace(spark.createDataFrame(hub, "module int, src int, dst int"), ["module"])["stride"] == 1
    line = [(1, i, i + 1) for i in range(60)]
    assert pace(spark.createDataFrame(line, "module int, src int, dst int"), ["module"])["stride"] == 3


def test_region_merge(spark):
    from tidemark.operators.control import merge_regions

    rows = [(1, 1, 1, 9, 1), (1, 1, 1, 9, 2), (1, 1, 2, 5, 2), (1, 1, 2, 5, 3), (1, 1, 5, 8, 5), (1, 1, 7, 9, 7)]
    df = spark.createDataFrame(rows, "module int, fn long, start int, stop int, block int")
    got = {(r.region, r.block) for r in merge_regions(df, None).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 5), (7, 7)}


def test_chain_links_are_judged_graph_by_graph(spark):
    """A busy graph beside a chain does not take the chain's links away, and gets none itself."""
    from tidemark.operators.fixpoint import skip_links

    chain = [(0, k, k + 1) for k in range(200)]
    busy = [(1, a, b) for a in range(12) for b in range(12) if a != b]
    edges = spark.createDataFrame(chain + busy, "g int, src int, dst int")
    got = skip_links(edges, ["g"]).groupBy("g").count().collect()
    counts = {r.g: r["count"] for r in got}
    assert counts[1] == len(busy) and counts[0] > 2 * len(chain)
