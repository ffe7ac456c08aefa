"""Graphs in a group of their own give the rows of packed ones and of the rounds, in few tables."""

from __future__ import annotations

import random

import pytest

from tidemark.functions.labels import ARG, DEP
from tidemark.operators import fixpoint, graph, small
from tidemark.operators import interproc as I
from tidemark.operators.calls import Resolved

G = ["g"]
#: Packed, each in its own group, in rounds.
WAYS = [{}, {small.SMALL_CONF: "0", small.WHOLE_CONF: "1000"}, {small.SMALL_CONF: "0"}]


def compare(spark, make):
    found = []
    for confs in WAYS:
        for name, value in confs.items():
            spark.conf.set(name, value)
        try:
            found.append(sorted(map(str, make().collect())))
        finally:
            for name in confs:
                spark.conf.unset(name)
    assert found[0] and found[0] == found[1] == found[2]


def edges(spark, weighted=False):
    rng, rows = random.Random(4), []
    for g in range(5):
        n = rng.randint(2, 8)
        rows += [(g, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(2, 2 * n))]
    rows = list(dict.fromkeys(rows)) + [(None, "a", "b"), (1, None, "n1"), (2, "n0", None)]
    if not weighted:
        return spark.createDataFrame(rows, "g int, src string, dst string")
    return spark.createDataFrame([(*r, rng.randint(0, 1)) for r in rows], "g int, src string, dst string, weight int")


def test_components_and_levels(spark):
    compare(spark, lambda: graph.scc(edges(spark), G))
    compare(spark, lambda: graph.levels(edges(spark, weighted=True), G))
    compare(spark, lambda: graph.levels(edges(spark), G))


def test_walks_and_labels(spark):
    seeds = [(g, f"n{i}", level, ref) for g in range(5) for i, level, ref in ((0, ARG, 0), (1, DEP, -1), (2, ARG, 1))]
    seeds = spark.createDataFrame(seeds, "g int, node string, level int, ref int")
    compare(spark, lambda: graph.spread(seeds, edges(spark), G))
    nodes = edges(spark).selectExpr("g", "src as node").where("node is not null").distinct()
    compare(spark, lambda: graph.node_labels(nodes, graph.propagate(seeds, edges(spark), G), G))


def test_many_walks_stay_in_rounds(spark):
    seeds = spark.createDataFrame([(0, 0, i) for i in range(small.WALKS + 1)], "g int, node int, start int")
    assert not small.few_walks(["start"], seeds)
    assert small.few_walks(["start"], seeds.where("start > 0"))
    assert small.few_walks([], seeds)


@pytest.mark.parametrize("n", [1100, 1500])
def test_levels_of_a_large_graph_in_few_tables(spark, monkeypatch, n):
    """More rows than are packed: a chain of cycles took rounds for every colour class and level."""
    rows = [(0, i, i + 1) for i in range(n)] + [(0, i + 1, i) for i in range(0, n, 3)]
    df = spark.createDataFrame(rows, "g int, src int, dst int")
    written, real = [], small.materialise
    for module in (small, graph, fixpoint):
        monkeypatch.setattr(module, "materialise", lambda df, name="table", path=None: written.append(name) or real(df, name, path))
    found = {r.node: r.level for r in graph.levels(df, G).collect()}
    assert len(found) == n + 1 and found[n] == 0 and found[0] == found[1] > found[3]
    assert len(written) <= 4


def calls(spark):
    """Random calls between functions of two modules, some through groups of several targets."""
    rng, call, target = random.Random(6), [], []
    for m in range(2):
        for g in range(3):
            target += [(m, f"type:{g}", f) for f in rng.sample(range(8), 3)]
        target += [(m, f"fn:{f}", f) for f in range(8)]
        call += [(m, rng.randrange(8), 100 * m + i, "direct", rng.choice([f"fn:{rng.randrange(8)}", f"type:{rng.randrange(3)}"])) for i in range(16)]
    calls_ = spark.createDataFrame(call, "module int, fn long, inst long, how string, grp string")
    targets = spark.createDataFrame(target, "module int, grp string, target long")
    resolved = Resolved(calls_, targets, calls_.where("inst = 3").select("module", "fn", "inst"))
    args = [(m, fn, i, a, *rng.choice([(4, -1), (3, 0), (3, 1), (1, -1)])) for m, fn, i, _, _ in call for a in (0, 1)]
    actuals = spark.createDataFrame(args, "module int, fn long, inst long, arg_no int, level int, ref int")
    own = [(m, f, "return", *rng.choice([(4, -1), (3, 0), (3, 1)])) for m in range(2) for f in range(0, 8, 2)]
    own = spark.createDataFrame(own, "module int, fn long, out string, level int, ref int")
    flows = spark.createDataFrame([(m, i, "return", fn, "return") for m, fn, i, _, _ in call if i % 3], "module int, inst long, call_out string, fn long, out string")
    handed = spark.createDataFrame([(m, i, "return", 100 * m + (i + 5) % 16, i % 2) for m, _, i, _, _ in call], "module int, inst long, call_out string, to_inst long, arg_no int")
    fixed = spark.createDataFrame([(0, 2, "return", 4, -1), (1, 105, "return", 3, 1)], "module int, inst long, out string, level int, ref int")
    return resolved, actuals, own, flows, handed, fixed


def test_summaries(spark):
    resolved, actuals, own, flows, _, fixed = calls(spark)
    compare(spark, lambda: I.function_summaries(own, resolved, actuals, flows, fixed))


def test_results_handed_on(spark):
    resolved, actuals, own, flows, handed, fixed = calls(spark)
    compare(spark, lambda: I.solve_calls(own, resolved, actuals, flows, fixed, handed))


def test_arguments(spark):
    resolved, actuals, *_ = calls(spark)
    functions = spark.createDataFrame([(m, f, 1 + f % 2) for m in range(2) for f in range(8)], "module int, fn long, n_args int")
    compare(spark, lambda: I.finalise_arguments(functions, resolved, actuals))
