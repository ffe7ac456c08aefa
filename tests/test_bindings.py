"""Binding of actuals to formals: what is exchanged, and sums over direct and shared groups."""

from __future__ import annotations

import re

import pytest

from tidemark.operators import calls as C
from tests.test_small_rules import resolved


@pytest.fixture
def merged(spark):
    """Joins as on large tables, plans as they are run."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bound(spark, actuals, passed=None):
    calls = [(0, 1, "a", "direct", "fn:2"), (0, 1, "b", "signature", "type:t"), (0, 1, "c", "signature", "type:t"), (1, 1, "a", "direct", "fn:2")]
    r = resolved(spark, calls, [(0, "fn:2", 2), (0, "type:t", 2), (0, "type:t", 3), (1, "fn:2", 2)])
    fns = spark.createDataFrame([(0, 2, 3), (0, 3, 1), (1, 2, 2)], "module int, fn long, n_args int")
    df = spark.createDataFrame(actuals, "module int, inst string, arg_no int, level int, ref int")
    if passed is not None:
        passed = spark.createDataFrame(passed, "module int, inst string, arg_no int, ref int")
    return C.bind_arguments(r, df, fns, passed)


def rows(df):
    return sorted((x.module, x.fn, x.arg_no, x.level, x.ref, x.n) for x in df.collect())


def test_facts_times_targets_are_taken_apart_after_the_last_exchange(merged):
    facts = [(0, i, 0, 4, -1) for i in "abc"] + [(0, "b", 1, 3, 2), (1, "a", 1, 1, -1), (1, "a", 2, 1, -1), (0, "a", 2, 0, -1)]
    df = bound(merged, facts)
    ops = re.findall(r"Generate inline|Exchange hashpartitioning", plan(df))
    assert ops and ops[0] == "Generate inline"
    assert rows(df) == [(0, 2, 0, 4, -1, 3), (0, 2, 1, 3, 2, 1), (0, 3, 0, 4, -1, 2), (1, 2, 1, 1, -1, 1)]


def test_arrays_of_a_group_have_a_bound(merged):
    """1,000 references of one group: no array holds more than 128 of them, none is lost."""
    df = bound(merged, [(0, i, 0, 3, ref) for i in "bc" for ref in range(1000)])
    assert re.search(r"ObjectHashAggregate\(keys=\[module#\d+, grp#\d+, _args#\d+L, _refs#\d+L\]|ObjectHashAggregate\(keys=\[module#\d+, grp#\d+, _groupingexpression", plan(df))
    assert rows(df) == [(0, fn, 0, 3, ref, 2) for fn in (2, 3) for ref in range(1000)]


def test_open_globals_need_no_join_with_actuals(merged):
    facts = [(0, "a", 0, 4, -1), (0, "a", 0, 0, 7), (0, "a", 1, 0, -1), (0, "b", 0, 1, -1)]
    df = bound(merged, facts, [(0, "a", 0, 70), (0, "a", 1, 71), (0, "a", 1, 71), (0, "c", 0, 72), (1, "a", 1, 73)])
    assert "LeftAnti" not in plan(df)
    assert rows(df) == [
        (0, 2, 0, 1, -1, 1), (0, 2, 0, 2, 72, 1), (0, 2, 0, 4, -1, 1), (0, 2, 1, 2, 71, 2), (0, 3, 0, 1, -1, 1), (0, 3, 0, 2, 72, 1), (1, 2, 1, 2, 73, 1),
    ]
