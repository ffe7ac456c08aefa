"""The loop engine with its known rows in buckets: same results, known rows stay where they are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fixpoint, graph
from tidemark.operators.fixpoint import RECENT_CONF, closure, relax

LIMITS = [0, 7, 10**6]


def brute(edges, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        tag, x = todo.pop()
        for a, b in edges:
            if a == x and (tag, b) not in seen:
                seen.add((tag, b))
                todo.append((tag, b))
    return seen


def random_edges(seed, n=25, m=45):
    rnd = random.Random(seed)
    return {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}


@pytest.fixture(params=LIMITS)
def limit(request, spark):
    spark.conf.set(RECENT_CONF, str(request.param))
    yield request.param
    spark.conf.unset(RECENT_CONF)


def step_of(edges_df):
    moves = edges_df.selectExpr("src as node", "dst as _next")
    return lambda d: d.join(moves, "node").selectExpr("tag", "_next as node")


def test_closure_with_null_tags(spark, limit):
    """Tags may be NULL: a NULL row is found once, the loop ends."""
    for seed in range(2):
        edges = random_edges(seed)
        df = spark.createDataFrame(sorted(edges), "src int, dst int")
        starts = [(None, 0), ("a", 1), ("b", 2), ("a", 1)]
        got = closure(spark.createDataFrame(starts, "tag string, node int"), step_of(df)).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == brute(edges, set(starts))


def test_found_rows_take_the_types_of_the_seed(spark, limit):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src int, dst int")
    seed = spark.createDataFrame([("a", 0)], "tag string, node long")
    assert {r.node for r in closure(seed, step_of(df)).collect()} == {0, 1, 2}


def test_empty_seed(spark, limit):
    df = spark.createDataFrame([(0, 1)], "src int, dst int")
    assert closure(spark.createDataFrame([], "tag string, node int"), step_of(df)).count() == 0
    offers = lambda d: d.selectExpr("node", "cost + 1 as cost").limit(0)
    assert relax(spark.createDataFrame([], "node int, cost int"), offers, ["node"], "cost").count() == 0


@pytest.mark.parametrize("best", ["min", "max"])
def test_relax_finds_the_best_value(spark, limit, best):
    rnd = random.Random(5)
    # No cycles, so that a longest way exists.
    edges = {(a, b): rnd.randrange(1, 9) for a, b in random_edges(3, m=60) if a < b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "node int, _next int, w int")
    step = lambda d: d.join(df, "node").selectExpr("_next as node", "cost + w as cost")
    seed = spark.createDataFrame([(0, 5), (0, 9), (1, 3), (2, None)], "node int, cost int")
    pick = min if best == "min" else max
    want = {0: pick(5, 9), 1: 3}
    for _ in range(30):
        for (a, b), w in edges.items():
            if a in want:
                want[b] = pick(want.get(b, want[a] + w), want[a] + w)
    got = relax(seed, step, ["node"], "cost", best=getattr(F, best)).where("cost is not null").collect()
    assert {r.node: r.cost for r in got} == want


def test_labels_with_a_top_level(spark, limit):
    edges = random_edges(8)
    df = spark.createDataFrame([(1, a, b) for a, b in edges], "g int, src int, dst int")
    seeds = [(1, 0, 4, -1), (1, 1, 3, 0), (1, 2, 3, 1), (1, 2, 3, None)]
    facts = graph.propagate(spark.createDataFrame(seeds, "g int, node int, level int, ref int"), df, ["g"]).collect()
    assert len(facts) == len(set(facts))
    got = {}
    for r in facts:
        got.setdefault(r.node, set()).add((r.level, r.ref))
    want = {}
    for _, start, level, ref in seeds:
        for _, n in brute(edges, {("", start)}):
            want.setdefault(n, set()).add((level, ref))
    assert set(got) == set(want)
    for n, expected in want.items():
        if (4, -1) in expected:
            assert (4, -1) in got[n]
        else:
            assert got[n] == expected


def test_buckets_grow_in_powers_of_two(spark, monkeypatch):
    """A loop of many rounds keeps few tables, takes them out of the catalogue in the end, and rewrites little."""
    spark.conf.set(RECENT_CONF, "0")
    try:
        most, rewritten = [], []
        settle = fixpoint._Rounds._settle

        def watched(self):
            settle(self)
            most.append(len(self.settled))
            rewritten.append(self.settled[-1][1])

        monkeypatch.setattr(fixpoint._Rounds, "_settle", watched)
        df = spark.createDataFrame([(i, i + 1) for i in range(24)], "src int, dst int")
        seed = spark.createDataFrame([("a", 0)], "tag string, node int")
        assert closure(seed, step_of(df)).count() == 25
        assert len(most) == 25 and max(most) <= 5
        assert sum(rewritten) <= 25 * 5
    finally:
        spark.conf.unset(RECENT_CONF)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tidemark_known")]


def test_known_rows_are_not_exchanged(spark, capsys):
    """In the plan of a round, buckets are read below a join with a sort between, never an exchange."""
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
            if spark.conf.get(c, None) is not None}
    spark.conf.set(RECENT_CONF, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seed = spark.range(1000).selectExpr("cast(id % 7 as string) as tag", "cast(id as int) as node")
        with fixpoint._Rounds(seed, "plan", seed.columns, lambda d: d) as rounds:
            rounds.add(seed)
            rounds.add(seed.selectExpr("tag", "node + 1000 as node").limit(100))
            assert [n for _, n in rounds.settled] == [1000, 100]
            found = seed.selectExpr("tag", "node + 1049 as node")
            new = rounds.new(found.distinct(), fixpoint.same(seed.columns))
            new.explain()
            plan = capsys.readouterr().out.splitlines()
            assert new.count() == 1000 - 51
    finally:
        spark.conf.unset(RECENT_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for c, v in keep.items():
            spark.conf.set(c, v)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 2
    for i in scans:
        at, above = depth(plan[i]), []
        for line in reversed(plan[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "SortMergeJoin" in line:
                    break
        assert "SortMergeJoin" in above[-1]
        assert not [line for line in above if "Exchange" in line]
