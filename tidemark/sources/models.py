"""Models of library functions, as a table.

One row per (name, target): target is ``return`` or an argument number; level ARG goes with the
arguments it is merged from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import ARG, DEP, INDEP

MODEL_SCHEMA = "name string, target string, level int, arg_deps array<int>, callbacks array<int>, source string"
CONFIG_SCHEMA = (
    "functions array<struct<name: string, deps: array<map<string, array<string>>>, callback_arguments: array<string>>>"
)

# Return label of the C library functions; a tuple names the arguments it is merged from.
C_RETURNS = {
    "printf": DEP, "remove": DEP, "rename": DEP, "fflush": DEP, "fopen": DEP, "freopen": DEP, "fputc": DEP,
    "snprintf": DEP, "sscanf": DEP, "puts": DEP, "getenv": DEP, "system": DEP, "fprintf": DEP, "fseek": DEP,
    "ftell": DEP, "fread": DEP, "fclose": DEP,
    "malloc": INDEP, "calloc": INDEP, "memcpy": INDEP, "exit": INDEP, "free": INDEP, "qsort": INDEP,
    "rewind": INDEP,
    "atof": (0,), "atoi": (0,), "atol": (0,), "atoll": (0,), "abs": (0,), "labs": (0,), "strlen": (0,),
    "log": (0,), "operator new": (0,),
    "realloc": (0, 1), "strcmp": (0, 1), "strcpy": (1,), "strcat": (1,), "fwrite": (1, 2),
}

# Out-arguments of the C library functions and the arguments they are merged from.
C_OUTS = {
    "freopen": {2: (0, 1)}, "snprintf": {0: (1, 2)}, "memcpy": {0: (1, 2)}, "realloc": {0: (0, 1)},
    "fprintf": {0: (0, 1)}, "qsort": {0: (0, 1)}, "strcpy": {0: (1,)}, "strcat": {0: (1,)},
    "fseek": {0: (0, 1, 2)}, "ftell": {0: (0,)}, "rewind": {0: (0,)}, "fread": {0: (1, 2, 3), 3: (2, 3)},
    "fclose": {0: INDEP},
}

# String class methods by demangled name; argument 0 is the object.
STRING_METHODS = {
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::basic_string(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&)": (INDEP, {0: (1,)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::basic_string(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&, unsigned long, unsigned long, std::__1::allocator<char> const&)": (INDEP, {0: (1, 2, 3)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::~basic_string()": (INDEP, {}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::operator=(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&)": (INDEP, {0: (1,)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::operator=(char)": (INDEP, {0: (1,)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::assign(char const*)": (INDEP, {0: (1,)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::reserve(unsigned long)": (INDEP, {0: (1,)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::resize(unsigned long, char)": (INDEP, {0: (1, 2)}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::size() const": ((0,), {}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::length() const": ((0,), {}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::max_size() const": ((0,), {}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::capacity() const": ((0,), {}),
    "std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::empty() const": ((0,), {}),
    "std::__1::__basic_string_common<true>::__throw_length_error() const": (INDEP, {}),
    "std::__1::char_traits<char>::length(char const*)": ((0,), {}),
    "std::__1::char_traits<char>::copy(char*, char const*, unsigned long)": ((1, 2), {0: (1, 2)}),
    "std::__1::char_traits<char>::assign(char&, char const&)": (INDEP, {0: (1,)}),
    "std::__1::char_traits<char>::assign(char*, unsigned long, char)": (INDEP, {0: (1, 2)}),
}

# Compiler intrinsics.
INTRINSICS = {
    "memcpy": (INDEP, {0: (1, 2)}),
    "memset": (INDEP, {0: (1, 2)}),
    "declare": (INDEP, {}),
}


def _rows(name: str, ret, outs: dict, source: str):
    for target, dep in [("return", ret), *((str(k), v) for k, v in outs.items())]:
        level, args = (ARG, list(dep)) if isinstance(dep, tuple) else (dep, [])
        yield (name, target, level, args, [], source)


def builtin_models(spark: SparkSession) -> DataFrame:
    """S3: the fixed models; a name known to several sources keeps the first (C, string, intrinsic)."""
    rows = [r for n, ret in C_RETURNS.items() for r in _rows(n, ret, C_OUTS.get(n, {}), "c")]
    rows += [r for n, (ret, outs) in STRING_METHODS.items() for r in _rows(n, ret, outs, "string")]
    rows += [r for n, (ret, outs) in INTRINSICS.items() for r in _rows(n, ret, outs, "intrinsic")]
    return merge_models(spark.createDataFrame(rows, MODEL_SCHEMA), order=["c", "string", "intrinsic"])


def merge_models(models: DataFrame, order: list[str]) -> DataFrame:
    """Keep, per name, the rows of the source that comes first in ``order``."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    w = Window.partitionBy("name")
    return models.withColumn("_p", place).withColumn("_m", F.min("_p").over(w)).where("_p = _m").drop("_p", "_m")


def with_config(builtin: DataFrame, config: DataFrame, precedence: str = "builtin_first") -> DataFrame:
    """Built-in and configured models in one table (D4: built-ins win unless told otherwise)."""
    both = builtin.withColumn("source", F.lit("builtin")).unionByName(config.withColumn("source", F.lit("config")))
    order = ["builtin", "config"] if precedence == "builtin_first" else ["config", "builtin"]
    return merge_models(both, order)


def load_models(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Models from JSON configs (one document, or one per line with ``multi_line=False``).

    A number is an argument; ``dep`` / ``indep`` set the level and end the list. Keys that are not
    ``return`` or a number, and callbacks that are not numbers, are left out. Of equal names in one
    target the merged arguments are kept (D3: a numeric list means ARG).
    """
    docs = spark.read.option("multiLine", multi_line).schema(CONFIG_SCHEMA).json(path)
    fns = docs.select(F.explode("functions").alias("f")).select("f.name", "f.deps", "f.callback_arguments")
    numbers = lambda col: F.filter(F.transform(col, lambda v: v.try_cast("int")), lambda v: v.isNotNull())
    callbacks = F.coalesce(numbers(F.col("callback_arguments")), F.array().cast("array<int>"))
    targets = fns.select("name", callbacks.alias("callbacks"), F.explode_outer("deps").alias("d")).select(
        "name", "callbacks", F.explode_outer("d").alias("target", "items")
    )
    word = F.get(F.filter("items", lambda v: v.isin("dep", "indep")), F.lit(0))
    level = F.when(word == "dep", DEP).when(word == "indep", INDEP).otherwise(ARG)
    args = F.when(word.isNull(), F.array_sort(F.array_distinct(numbers(F.col("items")))))
    rows = targets.where("target = 'return' or try_cast(target as int) is not null").select(
        "name",
        "target",
        F.when(F.col("items").isNull(), DEP).otherwise(level).cast("int").alias("level"),
        F.coalesce(args, F.array().cast("array<int>")).alias("arg_deps"),
        "callbacks",
    )
    # A name whose return has no rule stays an input (D3).
    ruled = rows.where("target = 'return'").select("name")
    open_ = fns.select("name", callbacks.alias("callbacks")).distinct().join(ruled, "name", "left_anti")
    silent = open_.select(
        "name", F.lit("return").alias("target"), F.lit(DEP).alias("level"), F.array().cast("array<int>").alias("arg_deps"), "callbacks"
    )
    return rows.unionByName(silent).withColumn("source", F.lit("config"))


def write_models(models: DataFrame, path: str) -> None:
    """Write models as one JSON document per name."""
    items = F.when(F.col("level") == DEP, F.array(F.lit("dep"))).when(
        F.col("level") == INDEP, F.array(F.lit("indep"))
    ).otherwise(F.col("arg_deps").cast("array<string>"))
    # A name has one row per target, so the map is bounded by the number of arguments.
    deps = F.map_from_entries(F.collect_list(F.struct(F.col("target"), items)))
    fn = F.struct(
        F.col("name"),
        F.array(F.col("deps")).alias("deps"),
        F.col("callbacks").cast("array<string>").alias("callback_arguments"),
    )
    (
        models.groupBy("name", "callbacks").agg(deps.alias("deps"))
        .select(F.to_json(F.struct(F.array(fn).alias("functions"))).alias("value"))
        .write.text(path)
    )
