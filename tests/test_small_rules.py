"""Rules of single operators on hand-written rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import calls as C
from tidemark.operators import interproc as I
from tidemark.operators.report import report_json


def test_report_keeps_plain_and_named_metrics_of_one_owner(spark):
    rows = [
        ("s", "f", "", "n_dep", 1.0), ("s", "f", "blocks", "n", 2.0), ("s", "f", "blocks", "m", 3.0), ("s", "f", "rows", "n", 4.0),
        ("s", "g", "", "n_dep", 5.0), ("", "h", "rows", 'q"\\', 6.0), ("", "", "", "n", 7.0), ('t"', "", "k", "n", 8.0),
    ]
    long = spark.createDataFrame(rows, "section string, owner string, kind string, name string, value double")
    got = {(r.section, r.owner): json.loads(r.doc) for r in report_json(long).collect()}
    assert got == {
        ("s", "f"): {"s": {"f": {"n_dep": 1.0, "blocks": {"n": 2.0, "m": 3.0}, "rows": {"n": 4.0}}}},
        ("s", "g"): {"s": {"g": {"n_dep": 5.0}}}, ("", "h"): {"h": {"rows": {'q"\\': 6.0}}}, ("", ""): {"n": 7.0}, ('t"', ""): {'t"': {"k": {"n": 8.0}}},
    }


def test_return_of_a_function_is_independent(spark):
    df = spark.createDataFrame([("ret", k) for k in ("const", "function", "none", "labelled")], "op string, kind string")
    got = {r.kind: r.level for r in df.select("kind", L.row_rule(F.col("op"), F.col("kind"), F.lit(False)).alias("level")).collect()}
    assert got == {"const": 1, "function": 1, "none": 1, "labelled": None}


def resolved(spark, calls, targets, unknown=()):
    df = spark.createDataFrame
    return C.Resolved(
        df(calls, "module int, fn long, inst string, how string, grp string"), df(targets, "module int, grp string, target long"),
        df(list(unknown), "module int, fn long, inst string"),
    )


def test_global_without_label_depends_on_itself(spark):
    r = resolved(spark, [(0, 1, "a", "direct", "fn:2")], [(0, "fn:2", 2)])
    actuals = spark.createDataFrame([(0, "a", 0, 4, -1), (0, "a", 1, 0, -1)], "module int, inst string, arg_no int, level int, ref int")
    passed = spark.createDataFrame([(0, "a", 0, 70), (0, "a", 1, 71), (0, "a", 2, 72)], "module int, inst string, arg_no int, ref int")
    fns = spark.createDataFrame([(0, 2, 3)], "module int, fn long, n_args int")
    got = {(x.arg_no, x.level, x.ref) for x in C.bind_arguments(r, actuals, fns, passed).collect()}
    assert got == {(0, 4, -1), (1, 2, 71), (2, 2, 72)}


def test_main_starts_independent(spark):
    r = resolved(spark, [(0, 1, "a", "direct", "fn:2"), (0, 4, "b", "direct", "fn:3")], [(0, "fn:2", 2), (0, "fn:3", 3)])
    fns = spark.createDataFrame([(0, 1, "main"), (0, 2, "f"), (0, 3, "g"), (0, 4, "h")], "module int, fn long, name string")
    hot = spark.createDataFrame([(0, "b")], "module int, inst string")
    assert {x.fn: x.called for x in I.call_determinism(r, hot, fns, entry="main").collect()} == {1: "independent", 2: "independent", 3: "dependent", 4: "no call"}


def test_fixed_results_of_calls(spark):
    r = resolved(
        spark,
        [(0, 1, "a", "direct", "fn:2"), (0, 1, "b", "direct", "fn:3"), (0, 3, "c", "direct", "fn:3"), (0, 1, "d", "signature", "type:x"), (0, 1, "e", "direct", "fn:4")],
        [(0, "fn:2", 2), (0, "fn:3", 3), (0, "fn:4", 4), (0, "type:x", 2), (0, "type:x", 4)],
        [(0, 1, "u")],
    )
    fns = spark.createDataFrame([(0, 1, False), (0, 2, True), (0, 3, False), (0, 4, False)], "module int, fn long, no_return boolean")
    invokes = spark.createDataFrame([(0, "e")], "module int, inst string")
    got = {x.inst: x.level for x in I.fixed_results(r, fns, invokes).collect()}
    assert got == {"a": 1, "c": 4, "u": 4, "e": 4}  # d may return through function 4


def test_summaries_of_a_popular_group_are_linear(spark, monkeypatch):
    """300 callers of a type with 300 targets: rows written follow callers + targets, and every caller gets its own actual."""
    n = 300
    calls = [(0, k, f"c{k}", "signature", "type:t") for k in range(n)]
    targets = [(0, "type:t", 10_000 + k) for k in range(n)]
    own = spark.createDataFrame([(0, 10_000 + k, "return", 3, k % 2) for k in range(n)], "module int, fn long, out string, level int, ref int")
    actuals = spark.createDataFrame([(0, f"c{k}", 1, 4 if k % 3 == 0 else 3, -1 if k % 3 == 0 else 0) for k in range(n)], "module int, inst string, arg_no int, level int, ref int")
    flows = spark.createDataFrame([(0, f"c{k}", "return", k, "return") for k in range(n)], "module int, inst string, call_out string, fn long, out string")
    none = spark.createDataFrame([], "module int, inst string, out string, level int, ref int")
    written = []
    real = I.materialise
    monkeypatch.setattr(I, "materialise", lambda df, *a, **k: written.append(real(df, *a, **k)) or written[-1])
    facts = I.solve_calls(own, resolved(spark, calls, targets), actuals, flows, none)
    got = {(r.fn, r.level, r.ref) for r in I._as_summary(facts).collect() if r.fn < n}
    assert got == {(k, 4, -1) if k % 3 == 0 else (k, 3, 0) for k in range(n)}
    assert sum(t.count() for t in written) + facts.count() < 12 * n
    seeds = I.pointer_seeds(spark.createDataFrame([(0, 1, 0, True), (0, 1, 1, False)], "module int, fn long, arg_no int, is_pointer boolean"))
    assert [tuple(r) for r in seeds.collect()] == [(0, 1, "0", 3, 0)]
