"""Several facts per row, models without a return rule, and reports with odd names."""

from __future__ import annotations

import json

import pytest

from tidemark.operators import interproc as I
from tidemark.operators import report
from tidemark.operators import specialise as P
from tidemark.sources import models

ACTUALS = "module int, inst long, arg_no int, level int, ref int"


def test_an_actual_on_two_arguments(spark):
    calls = spark.createDataFrame([(0, 1, 10, 2)], "module int, fn long, inst long, callee long")
    functions = spark.createDataFrame([(0, 2, 3, False)], "module int, fn long, n_args int, is_vararg boolean")
    # Argument 0 depends on the caller's 0 and 1, argument 1 is DEP by one of its facts, argument 2 has none.
    actuals = spark.createDataFrame([(0, 10, 0, 3, 0), (0, 10, 0, 3, 1), (0, 10, 1, 3, 0), (0, 10, 1, 4, -1)], ACTUALS)
    t = P.call_templates(calls, actuals, functions)
    assert t.first().tpl == [[0, 1], [P.ONE], []]
    masks = {m: t.select(P.mask_under(t.tpl, P.F.lit(m)).alias("m")).first().m for m in ("00", "10", "01")}
    assert masks == {"00": "010", "10": "110", "01": "110"}
    assert t.select(P.mask_under(t.tpl).alias("m")).first().m == "110"


def test_actuals_are_numbers_where_they_fit(spark):
    """Few small arguments take one aggregation by call without collected sets; many or large ones give the same templates."""
    calls = spark.createDataFrame([(0, 1, 10, 2), (0, 1, 11, 2)], "module int, fn long, inst long, callee long")
    functions = spark.createDataFrame([(0, 2, 3, True)], "module int, fn long, n_args int, is_vararg boolean")
    few = [(0, 10, 0, 3, 2), (0, 10, 0, 3, 0), (0, 10, 2, 4, -1), (0, 10, 3, 1, -1)]
    want = {10: [[0, 2], [], [P.ONE], []], 11: [[], [], []]}
    for more in ([], [(0, 12, 70, 1, -1)], [(0, 12, 0, 3, 63)]):  # neither is a call of these
        t = P.call_templates(calls, spark.createDataFrame(few + more, ACTUALS), functions)
        assert {r.inst: r.tpl for r in t.collect()} == want
        assert ("ObjectHashAggregate" in t._jdf.queryExecution().executedPlan().toString()) == bool(more)
    facts = P.fold_facts(spark.createDataFrame([(0, 1, 0, 3, 62), (0, 1, 0, 3, 5), (0, 1, 0, 1, -1)], ACTUALS), ["inst"])
    assert [(r.level, r.refs) for r in facts.collect()] == [(3, [5, 62])]
    with pytest.raises(Exception, match="final label"):
        P.call_templates(calls, spark.createDataFrame([(0, 10, 0, 0, -1)], ACTUALS), functions).collect()


def test_variants_of_calls_that_pass_nothing_on_take_no_rounds(spark, monkeypatch):
    from tidemark.operators import fixpoint

    rounds = []
    add = fixpoint._Rounds.add
    monkeypatch.setattr(fixpoint._Rounds, "add", lambda self, df: (rounds.append(1), add(self, df))[1])
    # A ring of alternating masks, two skipped functions behind it, and one argument passed on by the second.
    chain = [(1, i, f"{i}", i + 1, [[P.ONE], []] if i % 2 else [[], [P.ONE]]) for i in range(8)]
    tail = [(1, 8, "8", 9, [[], []]), (1, 9, "9", 10, [[0], [P.ONE]]), (1, 20, "20", 21, [[], []])]
    tpl = spark.createDataFrame(chain + tail, "module int, fn long, inst string, callee long, tpl array<array<int>>")
    none = spark.createDataFrame([], "module int, inst string")
    skip = spark.createDataFrame([(1, 9), (1, 20)], "module int, fn long")
    got = {r.name for r in P.variants(tpl, none, skip).collect()}
    assert got == {f"{i + 1}{'10' if i % 2 else '01'}" for i in range(8)} | {"900", "1001"}
    assert len(rounds) == 3  # the calls themselves, what 9 calls, nothing more


def test_a_row_of_several_facts_counts_once(spark):
    rows = spark.createDataFrame(
        [(0, 2, 7, 3, 0), (0, 2, 7, 3, 1), (0, 2, 8, 1, -1), (0, 2, 9, 3, 1), (0, 2, 9, 4, -1)],
        "module int, fn long, inst long, level int, ref int",
    )
    variants = spark.createDataFrame([(0, 2, "10", "f10"), (0, 2, "00", "f00")], "module int, fn long, mask string, name string")
    got = {(r.mask, r.inst): r.level for r in P.variant_labels(variants, rows).collect()}
    assert got == {("10", 7): 4, ("10", 8): 1, ("10", 9): 4, ("00", 7): 1, ("00", 8): 1, ("00", 9): 4}
    counts = {(r.mask, r.level): r.n for r in P.variant_counts(variants, P.row_classes(rows)).collect()}
    assert counts == {("10", 4): 2, ("10", 1): 1, ("00", 4): 1, ("00", 1): 2}
    none = spark.createDataFrame([], "module int, fn long")
    stats = P.specialisation_stats(rows, variants, none).first()
    assert (stats.cloned_rows, stats.rows_after, stats.indep_after) == (6, 9, 4)


def test_a_name_without_return_rule_stays_an_input(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"functions": [
        {"name": "f", "deps": [{"0": ["1"]}]},
        {"name": "g", "deps": [{"return": ["indep"]}, {"1": ["dep"]}]},
        {"name": "h"},
    ]}))
    got = {(r.name, r.target): (r.level, r.arg_deps) for r in models.load_models(spark, str(path)).collect()}
    assert got == {("f", "0"): (3, [1]), ("f", "return"): (4, []), ("g", "return"): (1, []), ("g", "1"): (4, []), ("h", "return"): (4, [])}


def test_reports_are_valid_json(spark):
    rows = [("s", 'a"b\\c', "rows", 'n"1', 1.0), ("s", 'a"b\\c', "rows", "n2", 2.0), ("s", 'a"b\\c', "blocks", "n", 3.0), ("", "o", "", "n", 4.0), ("", "", "k", "n", 5.0)]
    long = spark.createDataFrame(rows, "section string, owner string, kind string, name string, value double")
    docs = {(r.section, r.owner): json.loads(r.doc) for r in report.report_json(long).collect()}
    assert docs == {
        ("s", 'a"b\\c'): {"s": {'a"b\\c': {"rows": {'n"1': 1.0, "n2": 2.0}, "blocks": {"n": 3.0}}}},
        ("", "o"): {"o": {"n": 4.0}},
        ("", ""): {"k": {"n": 5.0}},
    }


def _program(spark):
    from tidemark.operators.calls import Resolved

    names = [(0, 1, "main", False), (0, 2, "u", False), (0, 3, "s", False), (0, 4, "t", False), (0, 5, "ext", True)]
    functions = spark.createDataFrame([(*n, 1) for n in names], "module int, fn long, name string, is_declaration boolean, n_args int")
    calls = spark.createDataFrame(
        [(0, 1, 10, "direct", "fn:3"), (0, 3, 11, "direct", "fn:3"), (0, 2, 12, "direct", "fn:4")], "module int, fn long, inst long, how string, grp string"
    )
    targets = spark.createDataFrame([(0, "fn:3", 3), (0, "fn:4", 4)], "module int, grp string, target long")
    return functions, Resolved(calls, targets, calls.limit(0))


def test_functions_nobody_calls(spark):
    functions, resolved = _program(spark)
    hot = spark.createDataFrame([(0, 11)], "module int, inst long")  # the call of 3 by itself
    none = functions.select("module", "fn").limit(0)
    dep = {r.fn for r in I.dependent_functions(resolved, hot, none, functions).collect()}
    assert dep == {2, 4}  # 2 is never called, 4 is called by 2; main and the function that calls itself are not
    assert {r.fn for r in I.dependent_functions(resolved, hot, none).collect()} == set()
    called = {r.fn: r.called for r in I.call_determinism(resolved, hot, functions).collect()}
    assert called == {1: "no call", 2: "no call", 3: "dependent", 4: "independent", 5: "no call"}
    levels = {r.fn: (r.comp, r.level) for r in I.call_levels(resolved, functions).collect()}
    assert levels[5] == (5, 0) and levels[3][1] < levels[1][1] and set(levels) == {1, 2, 3, 4, 5}


def test_a_group_of_callers_and_targets_makes_no_pairs(spark, monkeypatch):
    from tidemark.operators import interproc
    from tidemark.operators.calls import Resolved

    n, written = 120, {}
    calls = spark.range(n).selectExpr("0 as module", "id as fn", "id as inst", "'type' as how", "'type:x' as grp")
    targets = spark.range(n).selectExpr("0 as module", "'type:x' as grp", f"id + {n} as target")
    functions = spark.range(2 * n).selectExpr("0 as module", "id as fn", "1 as n_args")
    actuals = spark.range(n).selectExpr("0 as module", "id as inst", "0 as arg_no", "3 as level", "0 as ref")
    keep = interproc.materialise

    def counted(df, name="table", path=None):
        out = keep(df, name, path)
        written[name] = out.count()
        return out

    monkeypatch.setattr(interproc, "materialise", counted)
    got = interproc.finalise_arguments(functions, Resolved(calls, targets, calls.limit(0)), actuals)
    assert got.count() == 2 * n  # the callers are called by nobody, so their arguments and, through them, all targets'
    assert written["arg_steps"] == 2 * n


def test_a_long_run_widens_in_few_rounds(spark, monkeypatch):
    from tidemark.operators import runs

    n, tables = 400, []
    keep = runs.materialise
    monkeypatch.setattr(runs, "materialise", lambda df, name="table", path=None: tables.append(name) or keep(df, name, path))
    # Every row is read by the next; one run at the end, another in the middle of the rows before it.
    uses = spark.range(n).selectExpr("1L as b", "id as producer", "id + 1 as consumer")
    found = spark.createDataFrame([(1, n, n), (1, 200, 201)], "b long, begin_idx long, end_idx long")
    got = {(r.begin_idx, r.end_idx) for r in runs.widen_runs(found, uses, ["b"]).collect()}
    assert got == {(0, n), (0, 201)}
    assert tables.count("widen") == 2


def test_function_tags_are_read_back(spark, tmp_path):
    from tidemark.sources import label_store

    functions = spark.createDataFrame([(0, 1, True, False), (0, 2, False, True), (0, 3, False, False)], "module int, fn long, is_extracted boolean, is_dep_fn boolean")
    status = spark.createDataFrame([(0, 3, 0, "indep")], "module int, fn long, block int, status string")
    rows = spark.createDataFrame([(0, 3, 0, 7, 1)], "module int, fn long, block int, inst long, level int")
    label_store.write_labels(functions, status, rows, str(tmp_path / "labels"))
    assert {r.fn: r.tag for r in label_store.read_function_tags(spark, str(tmp_path / "labels")).collect()} == {1: "extracted", 2: "dep", 3: "indep"}


def test_rows_of_no_known_level_are_affected(spark):
    from tidemark.operators import calls as C

    rows = spark.createDataFrame([(0, 1, 1, 3, 0), (0, 1, 2, 3, 1), (0, 1, 3, 1, None), (0, 1, 4, 2, None), (0, 1, 5, 0, None), (0, 1, 6, 4, None)], "module int, fn long, inst long, level int, arg int")
    labels = spark.createDataFrame([(0, 1, 0, 4), (0, 1, 1, 1)], "module int, fn long, arg_no int, level int")
    assert {r.inst for r in C.affected_by_args(rows, labels).collect()} == {1, 4, 5, 6}
