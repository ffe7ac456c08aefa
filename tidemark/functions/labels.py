"""Dependency levels and column expressions over labels.

A label is a level plus the arguments (and values) it depends on. Between steps labels are kept in
long form, one row per (node, level, ref): ``ref`` is the argument number at level ARG, the value id
at level VALUE and -1 otherwise. A node without rows is independent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five levels in their merge order.
UNKNOWN, INDEP, VALUE, ARG, DEP = 0, 1, 2, 3, 4
LEVEL_NAMES = {
    UNKNOWN: "unknown",
    INDEP: "input independent",
    VALUE: "value dependent",
    ARG: "argument dependent",
    DEP: "input dependent",
}


def level_name(level: Column) -> Column:
    """level as text."""
    names = F.create_map(*[F.lit(x) for kv in LEVEL_NAMES.items() for x in kv])
    return F.element_at(names, level.cast("int"))


def is_defined(level: Column) -> Column:
    return level > UNKNOWN


def is_indep(level: Column) -> Column:
    return level == INDEP


def is_arg_dep(level: Column) -> Column:
    return level == ARG


def is_dep(level: Column) -> Column:
    return level == DEP


def is_value_dep(level: Column, values: Column) -> Column:
    """VALUE level, or any value left in the set."""
    return (level == VALUE) | (F.size(values) > 0)


def is_only_global_value_dep(values: Column, is_global) -> Column:
    """Non-empty value set of globals only."""
    return (F.size(values) > 0) & F.forall(values, is_global)


def model_name(name: Column, demangled: Column, is_intrinsic: Column) -> Column:
    """name under which a library model is looked up."""
    full = F.coalesce(demangled, name)
    short = F.when(full.contains("memcpy"), F.lit("memcpy"))
    for word in ("memset", "declare"):
        short = short.when(full.contains(word), F.lit(word))
    return F.when(is_intrinsic, short.otherwise(full)).otherwise(full)


def mask_string(bits: Column) -> Column:
    """array of 0/1 as text, argument 0 first."""
    return F.array_join(F.transform(bits, lambda b: b.cast("string")), "")


def percent_floor(part: Column, total: Column) -> Column:
    """truncated whole-number share, NULL for an empty total."""
    return F.floor(F.try_divide(part * F.lit(100), total)).cast("long")


def share(part: Column, total: Column) -> Column:
    """Share in percent, NULL for an empty total."""
    return F.round(F.try_divide(part * F.lit(100.0), total), 4)


def is_external(fn_module: Column, module: Column, is_declaration: Column) -> Column:
    """declared only, or owned by another module."""
    return is_declaration | (fn_module != module)


def checksum_eligible(level: Column, opcode: Column, bits: Column, opcodes: list[str]) -> Column:
    """rows whose value is stable enough to be summed."""
    return (level < DEP) & opcode.isin(opcodes) & bits.isin(32, 64)


def module_stem(name: Column) -> Column:
    """module name up to the first dot."""
    return F.substring_index(name, ".", 1)


def row_rule(opcode: Column, kind: Column, is_conditional: Column, alloca_level: int = DEP) -> Column:
    """level a row starts with by its opcode and the kind of its operand.

    ``kind`` is const / function / arg / labelled / none. NULL means: take it from the operands.
    """
    constant = kind.isin("const", "function")
    return (
        F.when(opcode == "alloca", F.lit(alloca_level))
        .when((opcode == "br") & (~is_conditional | (kind == "const")), F.lit(INDEP))
        .when((opcode == "ret") & (constant | (kind == "none")), F.lit(INDEP))  # a function is a constant too
        .when((opcode == "store") & constant, F.lit(INDEP))
        .when((opcode == "store") & (kind == "arg"), F.lit(ARG))
        .when((opcode == "store") & (kind == "none"), F.lit(DEP))
        .when((opcode == "gep") & (kind == "none"), F.lit(DEP))
    )


def csv(values: Column) -> Column:
    """Sorted comma string of a set of integers."""
    return F.array_join(F.transform(F.array_sort(values), lambda v: v.cast("string")), ",")
