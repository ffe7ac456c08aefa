"""Tables that are small as files and large in memory."""

from __future__ import annotations

import pytest

from tidemark.functions.labels import ARG, DEP, VALUE
from tidemark.operators import interproc
from tidemark.operators.calls import Resolved
from tidemark.operators.control import region_inputs
from tidemark.operators.fixpoint import RECENT_CONF, closure
from tidemark.operators.graph import along
from tidemark.session import materialise

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def limit(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "100k")
    yield
    spark.conf.set(LIMIT, before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_larger_than_their_files_are_not_broadcast(spark, limit):
    even = lambda n: spark.range(n).selectExpr("cast(0 as int) as module", "id div 100 as fn", "cast(id % 7 as int) as block").repartition(1)
    many, few = materialise(even(30_000)), materialise(even(50))
    files = spark.read.parquet(*many.inputFiles())
    assert "BroadcastHashJoin" in _plan(files.join(files.withColumnRenamed("block", "b"), ["module", "fn"]))
    both = many.join(many.withColumnRenamed("block", "b"), ["module", "fn"])
    assert "Broadcast" not in _plan(both) and both.count() == 300 * 100 * 100
    assert "BroadcastHashJoin" in _plan(many.join(few.withColumnRenamed("block", "b"), ["module", "fn"]))
    assert sorted(many.where("fn = 3").collect()) == sorted(files.where("fn = 3").collect())


def test_region_inputs_broadcast_no_large_regions(spark, limit):
    regions = spark.range(30_000).selectExpr("cast(0 as int) as module", "id div 20 as fn", "cast(0 as int) as start", "cast(id % 20 as int) as block")
    rows = spark.range(40_000).selectExpr("cast(0 as int) as module", "id div 25 as fn", "cast(id % 25 as int) as block", "id as inst", "false as is_storage")
    reads = rows.where("block < 24").selectExpr("module", "fn", "inst + 1 as src", "inst as dst")
    regions, rows, reads = (materialise(t.repartition(1)) for t in (regions, rows, reads))
    found = region_inputs(regions, rows, reads)
    assert "BroadcastExchange" not in _plan(found)
    # The last block of a region reads one row outside.
    assert sorted(map(tuple, found.collect())) == [(0, fn, 0, fn * 25 + 20) for fn in range(1_500)]


def test_settled_rounds_are_not_broadcast(spark, limit):
    spark.conf.set(RECENT_CONF, "1000")
    try:
        edges = spark.range(40_000).where("id % 4 < 3").selectExpr("cast(0 as int) as module", "id as src", "id + 1 as dst")
        seed = spark.range(0, 40_000, 4).selectExpr("cast(0 as int) as module", "id as node")
        found = closure(seed, along(edges, ["module"]))
        assert found.count() == 40_000
        assert "Union" in _plan(found)
    finally:
        spark.conf.unset(RECENT_CONF)


def test_actuals_meet_calls_once(spark, monkeypatch):
    written = {}

    def watched(df, name="table", path=None):
        written[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialise(df, name, path)

    monkeypatch.setattr(interproc, "materialise", watched)
    functions = spark.createDataFrame([(0, f, 2) for f in (1, 2, 3)], "module int, fn long, n_args int")
    calls = spark.createDataFrame([(0, 1, "a", "fn:2"), (0, 2, "b", "fn:3")], "module int, fn long, inst string, grp string")
    targets = spark.createDataFrame([(0, "fn:2", 2), (0, "fn:3", 3)], "module int, grp string, target long")
    actuals = spark.createDataFrame([(0, "a", 0, DEP, -1), (0, "a", 1, VALUE, -1), (0, "b", 1, ARG, 0), (0, "b", 0, ARG, 1)], "module int, inst string, arg_no int, level int, ref int")
    found = interproc.finalise_arguments(functions, Resolved(calls, targets, calls.limit(0)), actuals)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 3, 1)]
    assert "inst#" in written["passed_args"] and "inst#" not in written["arg_steps"]


def test_direct_groups_need_no_list_of_targets(spark):
    calls = spark.createDataFrame([(0, 1, "a", "fn:2"), (0, 1, "b", "type:t"), (0, 2, "c", "fn:4")], "module int, fn long, inst string, grp string")
    targets = spark.createDataFrame([(0, "fn:2", 2), (0, "fn:4", 4), (0, "type:t", 2), (0, "type:t", 3), (0, "type:u", 5)], "module int, grp string, target long")
    resolved = Resolved(calls, targets, calls.limit(0))
    plan = resolved.with_targets(calls.select("module", "grp"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert sorted(x.fn for x in interproc.called_functions(resolved).collect()) == [2, 3, 4]
    functions = spark.createDataFrame([(0, f, f"n{f}", f > 2) for f in range(1, 6)], "module int, fn long, name string, is_declaration boolean")
    assert sorted(map(tuple, resolved.external_calls(functions).collect())) == [(0, 1, "b", 3, "n3"), (0, 2, "c", 4, "n4")]
