"""Small graphs solved whole give the rows of the rounds, in few tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control, dominance, graph, small
from tidemark.operators.fixpoint import chase

G = ["g"]


def graphs(spark):
    """A few random graphs of several densities, NULL keys and ends among them."""
    rng, rows = random.Random(3), []
    for g in range(6):
        n = rng.randint(2, 6)
        rows += [(g, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 3 * n))]
    rows += [(None, 1, 2), (None, 2, 1), (4, None, 1), (5, 2, None)]
    edges = spark.createDataFrame(rows, "g int, src int, dst int")
    roots = spark.createDataFrame([(g, 0) for g in range(6)], "g int, node int")
    seeds = [(g, rng.randrange(6), *rng.choice([(4, -1), (3, 0), (3, 1)])) for g in range(6) for _ in range(3)]
    return edges, roots, spark.createDataFrame(seeds + [(None, 1, 4, -1)], "g int, node int, level int, ref int")


def compare(spark, make, limits=("1000", "8")):
    found = []
    for limit in limits:
        spark.conf.set(small.SMALL_CONF, limit)
        try:
            found.append(sorted(map(str, make().collect())))
        finally:
            spark.conf.unset(small.SMALL_CONF)
    assert found[0] and all(f == found[-1] for f in found)


def test_components(spark):
    compare(spark, lambda: graph.scc(graphs(spark)[0], G).select("g", "node", "comp"))


def test_spread_and_labels(spark):
    edges, roots, seeds = graphs(spark)
    compare(spark, lambda: graph.spread(seeds, edges, G).distinct())
    nodes = edges.select("g", F.col("src").alias("node")).distinct()
    compare(spark, lambda: graph.node_labels(nodes, graph.propagate(seeds, edges, G), G))


def test_dominators_and_cuts():
    """Against taking each node out."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(2, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        edges = [e for e in dict.fromkeys(edges) if e[0] != e[1]]

        def reach(start, without, both=False):
            kept = [e for e in edges if without not in e]
            return small.walk([start], small._next(kept + [(b, a) for a, b in kept] if both else kept))

        above = dict(small.immediate_dominators([(0,)], edges))
        assert set(above) == reach(0, None)
        strict = {(x, y) for x, y, _ in small.ancestors(list(above.items()))}
        assert strict == {(y, x) for x in above for y in above if x != y and (x == 0 or y not in reach(0, x))}
        nodes = {x for e in edges for x in e}
        parts = lambda x: len({frozenset(reach(y, x, True)) for y in reach(x, None, True) - {x}})
        assert {x for x, in small.cuts(edges)} == {x for x in nodes if parts(x) > 1}


def test_regions(spark):
    """Stops, regions and merged regions of functions above and below the limit."""
    edges, roots, _ = graphs(spark)
    fn = lambda df: df.where("g is not null").withColumn("module", F.lit(0)).withColumnRenamed("g", "fn")
    stops = fn(roots).select("module", "fn", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("start"), F.lit(2).alias("stop"))
    compare(spark, lambda: control.region_between(stops, fn(edges)))
    compare(spark, lambda: control.merge_regions(control.region_between(stops, fn(edges))))


def test_tree_intervals_and_ancestors():
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (9, 4)]
    tree = {n: (p, a, z) for n, p, a, z in small.dominator_tree([(0,)], edges)}
    assert {n: t[0] for n, t in tree.items()} == {0: None, 1: 0, 2: 0, 3: 0, 4: 3}
    pairs = {(x, y) for x in tree for y in tree if tree[x][1] < tree[y][1] <= tree[x][2]}
    assert pairs == {(above, n) for n, above, _ in small.ancestors([(n, t[0]) for n, t in tree.items()])}


def test_ends(spark):
    links = [(1, 2), (2, 3), (4, 3), (5, 6), (6, 5), (7, 5), (8, 1)]
    df = spark.createDataFrame([(0, *l) for l in links], "g int, src int, dst int")
    assert sorted(small.ends(links)) == sorted(tuple(r)[1:] for r in chase(df, G).select("g", "src", "end", "steps").collect())


@pytest.mark.parametrize("n", [60, 240])
def test_tables_do_not_follow_paths(spark, monkeypatch, n):
    """A long ladder in a small function: the same few tables for any length."""
    rows = [(0, i, j) for i in range(n) for j in (i + 1, i + 2)]
    edges, root = spark.createDataFrame(rows, "g int, src int, dst int"), spark.createDataFrame([(0, 0)], "g int, node int")
    written = []
    real = small.materialise
    for module in (small, dominance, graph):
        monkeypatch.setattr(module, "materialise", lambda df, name="table", path=None: written.append(name) or real(df, name, path))
    assert dominance.dominator_tree(root, edges, G).count() == n + 2
    assert graph.scc(edges, G).count() == n + 2
    assert len(written) <= 8
