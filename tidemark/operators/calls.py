"""Call resolution, models and argument binding (J*).

A resolved call points to a *group* of targets: one function for a direct call, all functions of a
type for a call by signature, one table slot for a virtual call. Targets are listed once per group
and whatever concerns a group is merged before it is joined to calls, so a popular signature costs
calls + targets rows and never calls x targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import ARG, DEP, INDEP, UNKNOWN, VALUE
from tidemark.operators.ordered import OrderedRows
from tidemark.session import materialise

CALL = ["module", "inst"]
GROUP = ["module", "grp"]
FACT = ["arg_no", "level", "ref"]


def direct_group(fn) -> F.Column:
    return F.concat(F.lit("fn:"), fn.cast("string"))


def direct_target(grp) -> F.Column:
    return F.split(grp, ":", 2)[1].try_cast("long")


def _is_direct() -> F.Column:
    return F.col("grp").startswith("fn:")


def resolve_direct_calls(calls: DataFrame) -> DataFrame:
    """Named callee, else the target of a global alias."""
    target = F.coalesce("callee", "alias_of")
    how = F.when(F.col("callee").isNotNull(), "direct").otherwise("alias")
    return calls.where("callee is not null or alias_of is not null").select(
        "module", "fn", "inst", how.alias("how"), direct_group(target).alias("grp"), target.alias("target")
    )


def signature_targets(functions: DataFrame) -> DataFrame:
    """Candidates of a call by signature: every defined function of that type, (module, grp, target)."""
    return functions.where(~F.col("is_declaration")).select(
        "module", F.concat(F.lit("type:"), "fn_type").alias("grp"), F.col("fn").alias("target")
    )


def slot_targets(calls: DataFrame, vtable_types: DataFrame, vtable_slots: DataFrame) -> DataFrame:
    """Candidates of a virtual call, all or nothing, (module, grp, target).

    A slot group has no candidates if any table of the type is not constant, the offset does not
    divide, or the slot is missing; pure slots are skipped.
    """
    asked = calls.where("type_id is not null").select("module", "type_id", "slot_offset").distinct()
    place = F.col("offset") + F.col("slot_offset")
    even = place % F.col("elem_size") == 0
    tables = asked.join(vtable_types, ["module", "type_id"]).select(
        "module",
        _slot_group().alias("grp"),
        "vtable",
        (F.col("is_constant") & even).alias("fits"),
        F.when(even, F.floor(place / F.col("elem_size"))).cast("int").alias("slot_no"),
    )
    hits = tables.join(vtable_slots, ["module", "vtable", "slot_no"], "left")
    ok = F.col("fits") & F.col("target").isNotNull()
    sound = hits.groupBy(*GROUP).agg(F.bool_and(ok).alias("ok")).where("ok")
    return hits.where("not is_pure").join(sound, GROUP, "left_semi").select("module", "grp", "target").distinct()


def _slot_group():
    return F.concat_ws(":", F.lit("slot"), "type_id", F.col("slot_offset").cast("string"))


@dataclass
class Resolved:
    """``calls`` (module, fn, inst, how, grp), ``targets`` (module, grp, target), ``unknown`` calls."""

    calls: DataFrame
    targets: DataFrame
    unknown: DataFrame

    def edges(self) -> DataFrame:
        """Call graph with groups as nodes: (module, src, dst) of names ``fn:1`` and group names."""
        into = self.calls.select("module", direct_group(F.col("fn")).alias("src"), F.col("grp").alias("dst"))
        out = self.targets.where(~F.col("grp").startswith("fn:")).select(
            "module", F.col("grp").alias("src"), direct_group(F.col("target")).alias("dst")
        )
        return into.union(out).distinct()

    def with_targets(self, groups: DataFrame) -> DataFrame:
        """``groups`` (module, grp, ...) with each ``target``: direct groups name theirs, only shared ones are looked up."""
        named = groups.where(_is_direct()).withColumn("target", direct_target(F.col("grp")))
        listed = groups.where(~_is_direct()).join(self.targets.where(~_is_direct()).select(*GROUP, "target"), GROUP)
        return named.unionByName(listed.select(*named.columns))

    def external_calls(self, functions: DataFrame) -> DataFrame:
        """Calls with a declared-only target: (module, fn, inst, target, name)."""
        declared = functions.where("is_declaration").select("module", F.col("fn").alias("target"), "name")
        direct = self.calls.where(_is_direct()).withColumn("target", direct_target(F.col("grp"))).join(declared, ["module", "target"])
        hits = self.targets.where(~_is_direct()).join(declared, ["module", "target"])
        shared = self.calls.where(~_is_direct()).join(hits, GROUP)
        cols = ["module", "fn", "inst", "target", "name"]
        return direct.select(*cols).unionByName(shared.select(*cols))

    def unmodelled_calls(self, functions: DataFrame, models: DataFrame) -> DataFrame:
        return self.external_calls(functions).join(models.select("name").distinct(), "name", "left_anti")


def resolve_calls(calls: DataFrame, functions: DataFrame, vtable_types: DataFrame, vtable_slots: DataFrame) -> Resolved:
    """Direct, alias, slot, signature in this order; what finds no target is unknown.

    Calls and targets are used many times by whatever comes next, so both are written once.
    """
    direct = resolve_direct_calls(calls)
    slots = materialise(slot_targets(calls, vtable_types, vtable_slots), "slot_targets")
    types = signature_targets(functions)
    indirect = calls.where("callee is null and alias_of is null")
    known_slots = slots.select(*GROUP).distinct().withColumn("slot_ok", F.lit(True))
    known_types = types.select("module", F.col("grp").alias("tgrp")).distinct().withColumn("type_ok", F.lit(True))
    tried = (
        indirect.withColumn("grp", F.when(F.col("type_id").isNotNull(), _slot_group()))
        .withColumn("tgrp", F.concat(F.lit("type:"), "fn_type"))
        .join(known_slots, GROUP, "left")
        .join(known_types, ["module", "tgrp"], "left")
    )
    how = F.when(F.col("slot_ok"), "slot").when(F.col("type_ok"), "signature")
    group = F.when(F.col("slot_ok"), F.col("grp")).otherwise(F.col("tgrp"))
    tried = tried.select("module", "fn", "inst", how.alias("how"), group.alias("grp"))
    found = materialise(direct.drop("target").unionByName(tried), "resolved_calls")
    targets = direct.select("module", "grp", "target").distinct().unionByName(slots).unionByName(types)
    return Resolved(
        found.where("how is not null"),
        materialise(targets, "call_targets"),
        found.where("how is null").select("module", "fn", "inst"),
    )


def unmodelled_externals(resolved: Resolved, functions: DataFrame, models: DataFrame) -> DataFrame:
    """Names of called externals without a model, each once per module."""
    return resolved.unmodelled_calls(functions, models).select("module", "name").distinct()


def called_functions(resolved: Resolved) -> DataFrame:
    """Direct and resolved targets of all calls as one set, (module, target)."""
    used = resolved.calls.select(*GROUP).distinct()
    return resolved.targets.join(used, GROUP, "left_semi").select("module", "target").distinct()


def deterministic_only(resolved: Resolved, places: DataFrame) -> DataFrame:
    """Functions called from independent places and never from dependent ones, (module, target).

    ``places`` (module, inst, in_dep); the two kinds of place are merged per group before targets.
    """
    groups = resolved.calls.join(places, CALL).groupBy(*GROUP).agg(
        F.bool_or("in_dep").alias("dep"), F.bool_or(~F.col("in_dep")).alias("indep")
    )
    per_fn = groups.join(resolved.targets, GROUP).groupBy("module", "target").agg(
        F.bool_or("dep").alias("dep"), F.bool_or("indep").alias("indep")
    )
    return per_fn.where("indep and not dep").select("module", "target")


def apply_models(
    external_calls: DataFrame, actuals: DataFrame, models: DataFrame, pointer_args: DataFrame
) -> DataFrame:
    """Labels a call to an external leaves behind, long form (module, inst, out, level, ref).

    ``out`` is ``return`` or an argument number. Modelled: the model's level, or the labels of the
    listed arguments. Unmodelled: the return and every pointer argument are DEP. ``pointer_args``
    holds (module, inst, arg_no).
    """
    rules = models.select("name", F.col("target").alias("out"), F.col("level").alias("m_level"), "arg_deps")
    hit = external_calls.select(*CALL, "name").join(rules, "name", "left")
    fixed = hit.where(F.col("m_level") != ARG).select(*CALL, "out", F.col("m_level").alias("level"), F.lit(-1).alias("ref"))
    listed = hit.where(F.col("m_level") == ARG).select(*CALL, "out", F.explode("arg_deps").alias("arg_no"))
    merged = listed.join(actuals.select(*CALL, "arg_no", "level", "ref"), CALL + ["arg_no"]).select(
        *CALL, "out", "level", "ref"
    )
    bare = hit.where("m_level is null").select(*CALL)
    lost = bare.withColumn("out", F.lit("return")).union(
        pointer_args.join(bare, CALL, "left_semi").select(*CALL, F.col("arg_no").cast("string"))
    )
    lost = lost.select(*CALL, "out", F.lit(DEP).alias("level"), F.lit(-1).alias("ref"))
    return fixed.union(merged).union(lost).distinct()


def bind_arguments(
    resolved: Resolved, actuals: DataFrame, functions: DataFrame, global_actuals: DataFrame | None = None
) -> DataFrame:
    """Facts of actuals at the formals of every target, (module, fn, arg_no, level, ref, n).

    Equal facts are counted per group before a group is spread over its targets. Undefined labels
    and actuals beyond the formals are skipped. ``global_actuals`` (module, inst, arg_no, ref): actuals that
    are globals; one without a defined label depends on itself, VALUE{ref}.

    A direct group names its target; a shared one is spread as one row per target with its facts in an array. Rows meet
    the formals, are taken apart and summed where they lie, so that facts times targets are never exchanged.
    """
    if global_actuals is not None:
        actuals = _with_globals(actuals, global_actuals)
    # Sorts compare the first key by its first eight bytes: the row before the module, hashes before names.
    labelled = actuals.where(F.col("level") > UNKNOWN).select(*CALL, *FACT)
    count, fact = F.count(F.lit(1)).alias("n"), F.struct(*FACT, "n")
    own = F.when(_is_direct(), F.substring("grp", 4, 2**31 - 1)).cast(resolved.targets.schema["target"].dataType)
    named = resolved.calls.where(_is_direct()).select(*CALL, own.alias("target"))
    direct = labelled.join(named, CALL[::-1]).groupBy("module", "target", *FACT).agg(count)
    direct = direct.select("module", "target", F.array(fact).alias("facts"))
    by_group = resolved.calls.where(~_is_direct()).select(*CALL, "grp")
    shared = labelled.join(by_group, CALL[::-1]).groupBy(*GROUP, *FACT).agg(count)
    # Arrays hold 16 arguments by 128 references at most, however many facts a group has.
    chunk = [F.floor(F.col("arg_no") / 16).alias("_args"), F.floor((F.col("ref") + 1) / 128).alias("_refs")]
    shared = shared.groupBy(*GROUP, *chunk).agg(F.collect_list(fact).alias("facts"))
    key = F.xxhash64(*GROUP).alias("_key")
    listed = resolved.targets.where(~_is_direct()).select(key, *GROUP, "target")
    spread = shared.select(key, *GROUP, "facts").join(listed, ["_key", *GROUP]).select("module", "target", "facts")
    formals = functions.select("module", F.col("fn").alias("target"), "n_args")
    return (
        direct.union(spread)
        .join(formals, ["target", "module"])
        .select("module", F.col("target").alias("fn"), "n_args", F.inline("facts"))
        .where(F.col("arg_no") < F.col("n_args"))
        .groupBy("module", "fn", *FACT)
        .agg(F.sum("n").alias("n"))
    )


def _with_globals(actuals: DataFrame, global_actuals: DataFrame) -> DataFrame:
    """Defined labels, and VALUE{ref} for globals without one; dealt by call, as the join with calls wants them."""
    labelled = actuals.where(F.col("level") > UNKNOWN).select(*CALL, *FACT, F.lit(False).alias("_open"))
    open_ = global_actuals.select(*CALL, "arg_no", F.lit(VALUE).alias("level"), "ref", F.lit(True).alias("_open"))
    known = F.min("_open").over(Window.partitionBy(*CALL[::-1], "arg_no"))
    rows = labelled.unionByName(open_).repartition(*CALL[::-1]).withColumn("_first", known)
    return rows.where(F.col("_open") == F.col("_first")).select(*CALL, *FACT)


def merge_call_args(bound: DataFrame, callbacks: DataFrame | None = None) -> DataFrame:
    """A2: per callee and argument the merged facts over all call sites; callbacks have all DEP.

    Labels over the caller's own arguments are left to ``interproc.finalise_arguments``; merged on
    their own they count as DEP when the caller is not settled, which is the rule used here.
    """
    settled = F.when(F.col("level") > INDEP, DEP).otherwise(F.col("level"))
    if callbacks is not None:
        flag = callbacks.select("module", "fn").distinct().withColumn("_cb", F.lit(True))
        bound = bound.join(flag, ["module", "fn"], "left")
        settled = F.when(F.col("_cb"), DEP).otherwise(settled)
    return bound.groupBy("module", "fn", "arg_no").agg(F.max(settled).cast("int").alias("level"), F.sum("n").alias("n_sites"))


def merge_call_globals(resolved: Resolved, call_globals: DataFrame) -> DataFrame:
    """A3: per callee and global the greatest label over all call sites."""
    per_group = (
        call_globals.join(resolved.calls.select(*CALL, "grp"), CALL)
        .groupBy(*GROUP, "global")
        .agg(F.max("level").alias("level"))
    )
    return (
        per_group.join(resolved.targets, GROUP)
        .groupBy("module", F.col("target").alias("fn"), "global")
        .agg(F.max("level").alias("level"))
    )


def substitute_summary(summary: DataFrame, resolved: Resolved, actuals: DataFrame) -> DataFrame:
    """What callees leave behind, in the caller's terms, (module, inst, out, level, ref).

    ``summary`` is long form (module, fn, out, level, ref): DEP stays, an argument becomes the facts
    of the actual, missing actuals are ignored.
    """
    per_group = (
        summary.withColumnRenamed("fn", "target")
        .join(resolved.targets, ["module", "target"])
        .select(*GROUP, "out", "level", "ref")
        .distinct()
    )
    at_call = resolved.calls.select(*CALL, "grp").join(per_group, GROUP).drop("grp")
    kept = at_call.where(F.col("level") == DEP)
    open_ = at_call.where(F.col("level") == ARG).select(*CALL, "out", F.col("ref").alias("arg_no"))
    named = open_.join(actuals.where(F.col("level") > INDEP).select(*CALL, "arg_no", "level", "ref"), CALL + ["arg_no"])
    return kept.select(*CALL, "out", "level", "ref").union(named.select(*CALL, "out", "level", "ref")).distinct()


def affected_by_args(rows: DataFrame, arg_labels: DataFrame) -> DataFrame:
    """Rows at level ARG with at least one argument that is DEP, and all that are neither ARG nor INDEP.

    ``arg_labels`` (module, fn, arg_no, level).
    """
    hot = arg_labels.where(F.col("level") == DEP).select("module", "fn", F.col("arg_no").alias("arg"))
    through = rows.where(F.col("level") == ARG).join(hot, ["module", "fn", "arg"], "left_semi")
    return through.unionByName(rows.where(~F.col("level").isin(ARG, INDEP)).select(*through.columns))


def missing_globals(referenced: DataFrame, from_callers: DataFrame, initialisers: DataFrame) -> DataFrame:
    """Label of each referenced global: the callers', else the initialiser's, else INDEP."""
    return (
        referenced.join(from_callers.withColumnRenamed("level", "_c"), ["module", "fn", "global"], "left")
        .join(initialisers.withColumnRenamed("level", "_i"), ["module", "global"], "left")
        .select("module", "fn", "global", F.coalesce("_c", "_i", F.lit(INDEP)).cast("int").alias("level"))
    )


def callback_targets(uses: DataFrame, stores: DataFrame, keys: list[str]) -> DataFrame:
    """Functions that may reach a callback argument through a variable, (module, target).

    ``uses``: (keys, idx) where the variable is passed. ``stores``: (keys, idx, target, kind), target
    NULL for anything but a function, kind MUST or MAY. A store is seen by the next use unless a MUST
    store lies between; so each row only needs the next use and the next MUST store after it.
    """
    marks = stores.select(*keys, "idx", "target", (F.col("kind") == "MUST").alias("must"), F.lit(1).alias("order")).unionByName(
        uses.select(
            *keys, "idx", F.lit(None).cast(stores.schema["target"].dataType).alias("target"),
            F.lit(False).alias("must"), F.lit(0).alias("order"),
        )
    )
    # A use at a position reads before a store at the same position.
    ahead = OrderedRows(marks, keys, ["idx", "order"])
    ahead.max_before(F.when(F.col("order") == 0, -F.col("idx")), "_use", desc=True)
    ahead.max_before(F.when(F.col("must"), -F.col("idx")), "_must", desc=True)
    seen = F.col("_use").isNotNull() & (F.col("_must").isNull() | (-F.col("_use") <= -F.col("_must")))
    return ahead.result().where(F.col("target").isNotNull() & seen).select("module", "target").distinct()
