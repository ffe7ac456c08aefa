"""Ordered rows: positions, dependent runs, widening and merging, running sums (W*)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import OrderedRows
from tidemark.session import materialise


def row_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """0-based position of a row in its block."""
    numbered = OrderedRows(rows, keys, order).row_number("_rn").result()
    return numbered.withColumn("row_index", (F.col("_rn") - 1).cast("long")).drop("_rn")


def dependent_runs(rows: DataFrame, keys: list[str], idx: str, dependent: Column, transparent: Column) -> DataFrame:
    """Maximal runs of dependent rows; transparent rows neither start, extend nor end one."""
    opaque = rows.where(~transparent).withColumn("_dep", dependent)
    broken = OrderedRows(opaque, keys, [idx]).running_sum(F.when(F.col("_dep"), 0).otherwise(1), "_island")
    return (
        broken.result()
        .where("_dep")
        .groupBy(*keys, "_island")
        .agg(
            F.min(idx).alias("begin_idx"),
            F.max(idx).alias("end_idx"),
            F.count(F.lit(1)).alias("n_dep_rows"),
        )
        .drop("_island")
    )


def drop_single_row_runs(runs: DataFrame) -> DataFrame:
    """F8: a run of one row is never taken out."""
    return runs.where("begin_idx < end_idx")


def run_size() -> Column:
    """Rows covered by a run, both ends counted."""
    return F.col("end_idx") - F.col("begin_idx") + 1


def widen_runs(runs: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """Pull in the row just before a run while some row of the run reads it.

    ``uses`` has one row per (keys, producer, consumer), both as positions. One round takes a run back over
    all rows in a row that it reads, as far as the begin of the run before it; only runs that reach that begin
    go on. So rounds count runs swallowed whole, not rows.
    """
    first_use = materialise(uses.groupBy(*keys, "producer").agg(F.min("consumer").alias("first_use")), "first_use")
    moving = materialise(runs.select(*keys, "begin_idx", "end_idx"), "runs")
    bound = first_use.count() + moving.count()
    done = None
    while True:
        begins = moving.select(*keys, "begin_idx").distinct()
        before = OrderedRows(begins, keys, ["begin_idx"], rows=bound).max_before(F.col("begin_idx"), "_floor").result()
        floors = before.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], F.col("begin_idx").alias("_fb"), "_floor")
        # Each producer belongs to the nearest begin after it; a begin at its own place does not count.
        marks = begins.select(*keys, F.col("begin_idx").alias("_at"), F.lit(0).alias("_kind"), (-F.col("begin_idx")).alias("_b"), F.lit(None).cast("long").alias("first_use"))
        reads = first_use.select(*keys, F.col("producer").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_b"), F.col("first_use").cast("long"))
        placed = OrderedRows(marks.union(reads), keys, ["_at", "_kind"], rows=bound).max_before(F.col("_b"), "_next", desc=True).result()
        placed = placed.where("_kind = 1 and _next is not null").select(*keys, (-F.col("_next")).alias("begin_idx"), (-F.col("_at")).alias("_back"), "first_use")
        read = moving.join(placed, keys + ["begin_idx"]).where("first_use <= end_idx")
        # Going back from the begin, the n-th row read is in the run if it stands n places before it.
        counted = OrderedRows(read.select(*keys, "begin_idx", "end_idx", "_back"), keys + ["begin_idx", "end_idx"], ["_back"]).row_number("_n").result()
        chain = counted.where("_n = begin_idx + _back").groupBy(*keys, "begin_idx", "end_idx").agg(F.max("_n").alias("_taken"))
        near = [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)]
        step = moving.join(chain, keys + ["begin_idx", "end_idx"], "left").join(floors, reduce(and_, near) & (F.col("begin_idx") == F.col("_fb")))
        moved = F.col("begin_idx") - F.coalesce("_taken", F.lit(0))
        step = step.select(*keys, moved.cast(moving.schema["begin_idx"].dataType).alias("begin_idx"), "end_idx", F.coalesce(moved == F.col("_floor"), F.lit(False)).alias("grows"))
        step = materialise(step, "widen")
        stopped = step.where("not grows").drop("grows")
        done = stopped if done is None else done.unionByName(stopped)
        moving = step.where("grows").drop("grows")
        if moving.isEmpty():
            return done


def trim_branch_ends(runs: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """A run ending in a branch gives up that row; ``branches`` holds (keys, idx)."""
    ends = branches.select(*keys, F.col("idx").alias("end_idx")).withColumn("_branch", F.lit(True))
    return (
        runs.join(ends, keys + ["end_idx"], "left")
        .withColumn("end_idx", F.col("end_idx") - F.when(F.col("_branch"), 1).otherwise(0))
        .where("begin_idx <= end_idx")
        .drop("_branch")
    )


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge runs of one block that overlap or touch."""
    spans = runs.groupBy(*keys, "begin_idx").agg(F.max("end_idx").alias("end_idx"))
    ordered = OrderedRows(spans, keys, ["begin_idx"]).max_before(F.col("end_idx"), "_reach")
    starts = F.when(F.col("begin_idx") <= F.col("_reach") + 1, 0).otherwise(1)
    ordered.df = ordered.df.withColumn("_start", starts)
    grouped = ordered.running_sum(F.col("_start"), "_group").result()
    return grouped.groupBy(*keys, "_group").agg(
        F.min("begin_idx").alias("begin_idx"), F.max("end_idx").alias("end_idx")
    ).drop("_group")


def first_n_per_key(rows: DataFrame, keys: list[str], order: list[str], n: int = 2) -> DataFrame:
    """At most ``n`` reports per key. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("report_no", F.row_number().over(w)).where(F.col("report_no") <= n)


def running_checksum(rows: DataFrame, value: str) -> DataFrame:
    """Running sum of eligible values at the end of each function, functions in order.

    Only the sum at the function's end is reported, so values are summed per function first and the
    running part sees one row per function. Sums wrap never: they are decimals.
    """
    per_fn = rows.groupBy("module", "fn").agg(
        F.sum(F.col(value).cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("n_rows")
    )
    total = OrderedRows(per_fn, ["module"], ["fn"]).running_sum(F.col("_sum"), "checksum").result()
    return total.select("module", "fn", "n_rows", F.col("checksum").cast("decimal(38,0)").alias("checksum"))
