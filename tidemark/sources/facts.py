"""Fact tables on disk, partitioned by module."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES_AT_ONCE = 3

_FN = "module int, fn long"
SCHEMAS = {
    "functions": (
        f"{_FN}, name string, fn_type string, is_declaration boolean, n_args int, is_vararg boolean, "
        "is_intrinsic boolean, returns_void boolean, no_return boolean"
    ),
    "args": f"{_FN}, arg_no int, is_pointer boolean",
    "blocks": f"{_FN}, block int, n_rows long, is_entry boolean, is_exit boolean",
    "block_edges": f"{_FN}, src int, dst int",
    "instructions": (
        f"{_FN}, block int, idx long, inst long, opcode string, is_terminator boolean, "
        "is_conditional boolean, line int, level int, arg int"
    ),
    "operands": f"{_FN}, src long, dst long",
    "calls": (
        f"{_FN}, inst string, callee long, alias_of long, fn_type string, type_id string, slot_offset int"
    ),
    "call_args": f"{_FN}, inst string, arg_no int, level int, ref int",
    "aliases": f"{_FN}, a string, b string, kind string",
    "models": "module int, name string, target string, level int, arg_deps array<int>, callbacks array<int>, source string",
    "vtable_types": "module int, vtable string, type_id string, offset int, elem_size int, is_constant boolean",
    "vtable_slots": "module int, vtable string, slot_no int, target long, is_pure boolean",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def write_facts(facts: dict[str, DataFrame], path: str) -> None:
    """Write fact tables with their declared columns; a module filter later reads only its folder.

    Rows are dealt by ranges of module, function and row, so a large function is several files. Tables are written
    ``TABLES_AT_ONCE`` at a time, so that the last tasks of one leave no cores idle.
    """

    def write(name: str) -> None:
        cols = schema(name).fieldNames()
        order = [c for c in cols if c in ("module", "fn", "inst", "src", "block", "name", "vtable", "a")]
        facts[name].select(*cols).repartitionByRange(*order).write.partitionBy("module").parquet(f"{path}/{name}")

    if facts:
        in_thread = inheritable_thread_target(next(iter(facts.values())).sparkSession)
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            list(pool.map(in_thread(write), facts))


def load_facts(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Fact tables under ``path`` by name, with the declared schema (nothing is inferred)."""
    return {n: spark.read.schema(schema(n)).parquet(f"{path}/{n}") for n in names or SCHEMAS}
