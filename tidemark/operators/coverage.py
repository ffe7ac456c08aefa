"""Counts and shares of labelled rows, blocks and functions (A*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import DEP, INDEP, csv, percent_floor, share

FN = ["module", "fn"]
BLOCK = ["module", "fn", "block"]


def _n(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def merge_labels(facts: DataFrame, keys: list[str]) -> DataFrame:
    """A1: greatest level and the union of arguments per key, from long-form facts.

    Sets are built from distinct elements, so a hot key shuffles one row per element and map task.
    """
    args = F.collect_set(F.when(F.col("ref") >= 0, F.col("ref")))
    return facts.groupBy(*keys).agg(F.max("level").alias("level"), csv(args).alias("args"))


def label_counts(labels: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """A4: dependent / independent / unknown rows per key and the truncated dependent share.

    ``times`` names a column that says for how many rows a row stands.
    """
    if times is None:
        many, rows = _n, F.count(F.lit(1))
    else:
        many, rows = lambda c: F.sum(F.when(c, F.col(times)).otherwise(0)), F.sum(times)
    counted = labels.groupBy(*keys).agg(
        many(F.col("level") == DEP).alias("n_dep"), many(F.col("level") == INDEP).alias("n_indep"), rows.alias("n_rows")
    )
    return counted.select(
        *keys,
        "n_dep",
        "n_indep",
        (F.col("n_rows") - F.col("n_dep") - F.col("n_indep")).alias("n_unknown"),
        "n_rows",
        percent_floor(F.col("n_dep"), F.col("n_rows")).alias("percent"),
    )


def block_status(rows: DataFrame, blocks: DataFrame, unreachable: DataFrame) -> DataFrame:
    """Per block: unreachable first, then dependent if it holds a dependent row."""
    per_block = rows.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _n(F.col("level") == INDEP).alias("n_indep_rows"),
        F.bool_or(F.col("level") == DEP).alias("is_dep"),
    )
    return (
        blocks.select(*BLOCK)
        .join(per_block, BLOCK, "left")
        .join(unreachable.select(*BLOCK, F.lit(True).alias("dead")), BLOCK, "left")
        .select(
            *BLOCK,
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("n_indep_rows", F.lit(0)).alias("n_indep_rows"),
            F.when(F.col("dead"), "unreachable").when(F.col("is_dep"), "dep").otherwise("indep").alias("status"),
        )
    )


def indep_coverage(status: DataFrame, functions: DataFrame) -> DataFrame:
    """A5: independent blocks and rows per function; a dependent function counts none."""
    dead = F.col("status") == "unreachable"
    alive_fn = ~F.col("is_dep_fn")
    per_fn = status.join(functions.select(*FN, "is_dep_fn"), FN).groupBy(*FN).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        _n(alive_fn & (F.col("status") == "indep")).alias("n_indep_blocks"),
        _n(dead).alias("n_dead_blocks"),
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.when(alive_fn & ~dead, F.col("n_indep_rows")).otherwise(0)).alias("n_indep_rows"),
        F.sum(F.when(dead, F.col("n_rows")).otherwise(0)).alias("n_dead_rows"),
    )
    return with_shares(per_fn)


def with_shares(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "block_share", share(F.col("n_indep_blocks"), F.col("n_blocks") - F.col("n_dead_blocks"))
    ).withColumn("row_share", share(F.col("n_indep_rows"), F.col("n_rows") - F.col("n_dead_rows")))


def dep_coverage(status: DataFrame, functions: DataFrame) -> DataFrame:
    """A dependent function counts all its blocks and rows, any other none."""
    dead = F.col("status") == "unreachable"
    per_fn = status.join(functions.select(*FN, "is_dep_fn"), FN).groupBy(*FN).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        _n(F.col("is_dep_fn")).alias("n_dep_blocks"),
        _n(dead).alias("n_dead_blocks"),
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.when(F.col("is_dep_fn"), F.col("n_rows")).otherwise(0)).alias("n_dep_rows"),
        F.sum(F.when(dead, F.col("n_rows")).otherwise(0)).alias("n_dead_rows"),
    )
    return per_fn.withColumn(
        "block_share", share(F.col("n_dep_blocks"), F.col("n_blocks") - F.col("n_dead_blocks"))
    ).withColumn("row_share", share(F.col("n_dep_rows"), F.col("n_rows") - F.col("n_dead_rows")))


def module_totals(per_fn: DataFrame) -> DataFrame:
    """Sums per module and over all modules; shares from the sums, not averaged."""
    counts = ["n_blocks", "n_indep_blocks", "n_dead_blocks", "n_rows", "n_indep_rows", "n_dead_rows"]
    sums = per_fn.rollup("module").agg(
        *[F.sum(c).alias(c) for c in counts], F.grouping_id().cast("int").alias("is_total")
    )
    return with_shares(sums)


def module_summary(labels: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows, independent rows and the number of dependent or extracted functions."""
    rows = labels.groupBy("module").agg(
        F.count(F.lit(1)).alias("n_rows"), _n(F.col("level") == INDEP).alias("n_indep")
    )
    fns = functions.groupBy("module").agg(_n(F.col("is_dep_fn") | F.col("is_extracted")).alias("n_dep_fns"))
    return rows.join(fns, "module")


def dependent_function_list(functions: DataFrame) -> DataFrame:
    """A8, the list: one row per dependent or extracted function."""
    return functions.where("is_dep_fn or is_extracted").select(*FN)


def module_size(functions: DataFrame, blocks: DataFrame, loops: DataFrame, instructions: DataFrame) -> DataFrame:
    """Functions, blocks, loops, rows and rows in loops; ``functions`` holds defined ones only.

    ``loops`` has one row per (block, loop).
    """
    own = functions.select(*FN)
    n_fns = own.groupBy("module").agg(F.count(F.lit(1)).alias("n_functions"))
    n_blocks = blocks.join(own, FN, "left_semi").groupBy("module").agg(F.count(F.lit(1)).alias("n_blocks"))
    heads = loops.select(*FN, "loop").distinct().join(own, FN, "left_semi")
    n_loops = heads.groupBy("module").agg(F.count(F.lit(1)).alias("n_loops"))
    in_loop = loops.select(*BLOCK).distinct().withColumn("looped", F.lit(True))
    rows = (
        instructions.join(own, FN, "left_semi")
        .groupBy(*BLOCK)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(in_loop, BLOCK, "left")
        .groupBy("module")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("looped"), F.col("n")).otherwise(0)).alias("n_loop_rows"),
        )
    )
    return (
        n_fns.join(n_blocks, "module", "left").join(n_loops, "module", "left").join(rows, "module", "left")
    ).fillna(0)


def unreachable_counts(instructions: DataFrame, unreachable: DataFrame) -> DataFrame:
    """A10: unreachable blocks and their rows per function."""
    per_block = instructions.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    return (
        unreachable.select(*BLOCK)
        .join(per_block, BLOCK, "left")
        .groupBy(*FN)
        .agg(F.count(F.lit(1)).alias("n_dead_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_dead_rows"))
    )


def callers_of(edges: DataFrame) -> DataFrame:
    """Direct callers, one row per (callee, caller), with the size of the set.

    Kept long: a function called from everywhere would not fit one array.
    """
    pairs = edges.select("module", F.col("dst").alias("fn"), F.col("src").alias("caller")).distinct()
    size = pairs.groupBy(*FN).agg(F.count(F.lit(1)).alias("n_callers"))
    return pairs.join(size, FN)


def coverage_before_after(before: DataFrame, after: DataFrame, names=("before", "after"), times: str | None = None) -> DataFrame:
    """Label counts per module in two named sections, side by side; ``times`` as in ``label_counts``."""
    both = label_counts(before, ["module"], times).withColumn("section", F.lit(names[0])).unionByName(
        label_counts(after, ["module"], times).withColumn("section", F.lit(names[1]))
    )
    return both.groupBy("module").pivot("section", list(names)).agg(
        F.first("n_dep").alias("n_dep"), F.first("n_rows").alias("n_rows"), F.first("percent").alias("percent")
    )
