"""Rule tables on hand-made facts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import calls as C
from tidemark.operators import interproc as I
from tidemark.operators import memory as M
from tidemark.operators import runs
from tidemark.operators import specialise as P
from tidemark.sources import models


def test_elements(spark):
    """Constant index sets one element, an unknown index touches all, the whole is the merge."""
    w = [
        (1, "a", 0, 1, 4), (1, "a", 1, 2, 1), (1, "a", None, 3, 3), (1, "a", 0, 4, 1),
        (1, "b", None, 1, 4),
        (1, "c", 2, 1, 4), (1, "c", 2, 2, 1),
    ]
    df = spark.createDataFrame(w, "fn int, value string, elem int, idx int, level int")
    got = {(r.value, r.elem): r.level for r in M.element_labels(df, ["fn"]).collect()}
    assert got == {("a", 0): 1, ("a", 1): 3, ("a", -1): 3, ("b", -1): 4, ("c", 2): 1, ("c", -1): 1}


def test_aliases(spark):
    values = spark.createDataFrame([(1, v, 3) for v in "mnpq"], "fn int, value string, level int")
    writes = spark.createDataFrame([(1, "x", 1, False), (1, "y", 4, True)], "fn int, value string, level int, is_element boolean")
    aliases = [(1, "x", "m", "MUST"), (1, "x", "n", "MAY"), (1, "x", "p", "PARTIAL"), (1, "y", "q", "PARTIAL")]
    al = spark.createDataFrame(aliases, "fn int, a string, b string, kind string")
    got = {r.value: r.level for r in M.spread_to_aliases(values, writes, al, ["fn"]).collect()}
    assert got == {"m": 1, "n": 3, "p": 3, "q": 4}


def test_runs_and_transparent_rows(spark):
    # dep, transparent, dep, indep, dep, dep, transparent
    levels = [(4, False), (1, True), (4, False), (1, False), (4, False), (4, False), (4, True)]
    df = spark.createDataFrame([(1, i, lv, t) for i, (lv, t) in enumerate(levels)], "b int, idx int, level int, t boolean")
    got = runs.dependent_runs(df, ["b"], "idx", F.col("level") == 4, F.col("t"))
    assert sorted((r.begin_idx, r.end_idx) for r in got.collect()) == [(0, 2), (4, 5)]
    uses = spark.createDataFrame([(1, 3, 5), (1, 2, 9)], "b int, producer int, consumer int")
    wide = runs.widen_runs(got, uses, ["b"])
    assert sorted((r.begin_idx, r.end_idx) for r in wide.collect()) == [(0, 2), (3, 5)]
    merged = runs.merge_runs(wide, ["b"])
    assert [(r.begin_idx, r.end_idx) for r in merged.collect()] == [(0, 5)]


def test_slots_are_all_or_nothing(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", None, None, None, "T", 0), (1, 1, "b", None, None, None, "T", 8), (1, 1, "c", None, None, None, "T", 3),
         (1, 1, "d", None, None, "ft", "U", 0)],
        "module int, fn long, inst string, callee long, alias_of long, fn_type string, type_id string, slot_offset int",
    )
    types = spark.createDataFrame(
        [(1, "v1", "T", 16, 8, True), (1, "v2", "T", 16, 8, True), (1, "v3", "U", 16, 8, False)],
        "module int, vtable string, type_id string, offset int, elem_size int, is_constant boolean",
    )
    slots = spark.createDataFrame(
        [(1, "v1", 2, 10, False), (1, "v2", 2, 11, True), (1, "v1", 3, 12, False), (1, "v3", 2, 13, False)],
        "module int, vtable string, slot_no int, target long, is_pure boolean",
    )
    fns = spark.createDataFrame([(1, 20, "ft", False), (1, 21, "ft", True)], "module int, fn long, fn_type string, is_declaration boolean")
    r = C.resolve_calls(calls, fns, types, slots)
    got = {(x.inst, x.how, x.target) for x in r.calls.join(r.targets, ["module", "grp"]).collect()}
    # a: both tables have the slot, one is pure; b: v2 lacks it; c: does not divide; d: falls back to its type
    assert got == {("a", "slot", 10), ("d", "signature", 20)}
    assert {x.inst for x in r.unknown.collect()} == {"b", "c"}


def test_config_models(spark, tmp_path):
    doc = {"functions": [
        {"name": "scan", "deps": [{"0": ["1", "x"], "return": ["dep"], "odd": ["1"]}]},
        {"name": "hook", "callback_arguments": ["1", "no"]},
        {"name": "calm", "deps": [{"return": ["indep", "2"]}]},
        {"name": "printf", "deps": [{"return": ["indep"]}]},
    ]}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(doc, indent=1))
    got = {(r.name, r.target): (r.level, r.arg_deps, r.callbacks) for r in models.load_models(spark, str(path)).collect()}
    assert got == {
        ("scan", "0"): (L.ARG, [1], []),
        ("scan", "return"): (L.DEP, [], []),
        ("hook", "return"): (L.DEP, [], [1]),
        ("calm", "return"): (L.INDEP, [], []),
        ("printf", "return"): (L.INDEP, [], []),
    }
    built = models.builtin_models(spark)
    level = lambda how: {
        r.level for r in models.with_config(built, models.load_models(spark, str(path)), how)
        .where("name = 'printf' and target = 'return'").collect()
    }
    assert level("builtin_first") == {L.DEP}
    assert level("config_first") == {L.INDEP}


def test_builtin_models_keep_the_first_source(spark):
    m = models.builtin_models(spark)
    assert {r.source for r in m.where("name = 'memcpy'").collect()} == {"c"}
    assert m.where("name = 'memset'").count() == 2
    assert m.select("name").distinct().count() == 38 + 18 + 2


def _resolved(spark, calls):
    """Direct calls (fn, inst, callee)."""
    df = spark.createDataFrame([(1, f, i, "direct", f"fn:{c}") for f, i, c in calls], "module int, fn long, inst string, how string, grp string")
    tg = spark.createDataFrame(sorted({(1, f"fn:{c}", c) for _, _, c in calls}), "module int, grp string, target long")
    return C.Resolved(df, tg, df.where("false").select("module", "fn", "inst"))


def test_summaries_through_later_calls(spark):
    """A result handed to a later call goes through that callee's summary."""
    r = _resolved(spark, [(1, "i", 2), (1, "j", 3), (1, "k", 4)])
    own = spark.createDataFrame([(1, 2, "return", 3, 0), (1, 3, "return", 3, 1), (1, 4, "return", 4, -1)],
                                "module int, fn long, out string, level int, ref int")
    actual = spark.createDataFrame([(1, "i", 0, 3, 2), (1, "j", 0, 4, -1)], "module int, inst string, arg_no int, level int, ref int")
    flows = spark.createDataFrame([(1, "j", "return", 1, "return"), (1, "k", "return", 1, "0")],
                                  "module int, inst string, call_out string, fn long, out string")
    hand = spark.createDataFrame([(1, "i", "return", "j", 1)], "module int, inst string, call_out string, to_inst string, arg_no int")
    none = spark.createDataFrame([], "module int, inst string, out string, level int, ref int")
    got = I.function_summaries(own, r, actual, flows, none, hand).where("fn = 1")
    assert {(x.out, x.level, x.ref) for x in got.collect()} == {("return", 3, 2), ("0", 4, -1)}


def test_recursion_is_dependent(spark):
    r = _resolved(spark, [(1, "a", 1), (2, "b", 3), (3, "c", 2), (4, "d", 2)])
    assert {x.inst for x in I.recursive_calls(r).collect()} == {"a", "b", "c"}


def test_final_arguments(spark):
    r = _resolved(spark, [(1, "a", 2), (2, "b", 3), (5, "c", 4)])
    fns = spark.createDataFrame([(1, f, 1) for f in range(1, 6)], "module int, fn long, n_args int")
    act = spark.createDataFrame([(1, "a", 0, 3, 0), (1, "b", 0, 1, -1), (1, "c", 0, 1, -1)],
                                "module int, inst string, arg_no int, level int, ref int")
    got = {(x.fn, x.arg_no) for x in I.finalise_arguments(fns, r, act).collect()}
    assert got == {(1, 0), (5, 0), (2, 0)}


def test_variants_inside_variants(spark):
    tpl = spark.createDataFrame(
        [(1, 1, "a", 2, [[P.ONE], []]), (1, 2, "b", 3, [[0]]), (1, 2, "c", 4, [[1]]), (1, 9, "d", 3, [[]]), (1, 1, "e", 5, [])],
        "module int, fn long, inst string, callee long, tpl array<array<int>>",
    )
    none = spark.createDataFrame([], "module int, inst string")
    skip = spark.createDataFrame([(1, 9), (1, 2)], "module int, fn long")
    got = {r.name for r in P.variants(tpl, none, skip).collect()}
    # Inside 2 with mask 10: 3 gets 1 (the original serves), 4 gets 0.
    assert got == {"210", "40", "5_indep"}


def test_levels_and_masks(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,)], "level int")
    got = [r.n for r in df.orderBy("level").select(L.level_name(F.col("level")).alias("n")).collect()]
    assert got == list(L.LEVEL_NAMES.values())
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(L.percent_floor(F.lit(58), F.lit(67))) == 86
    assert pick(L.percent_floor(F.lit(85), F.lit(145))) == 58
    assert pick(L.percent_floor(F.lit(1), F.lit(0))) is None
    assert pick(L.mask_string(F.array(F.lit(1), F.lit(0)))) == "10"
