"""Labels of stored values: aliases, elements, loads, argument operands, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import ARG, INDEP, VALUE, csv
from tidemark.operators.ordered import OrderedRows


def spread_to_aliases(values: DataFrame, writes: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Labels after writes: MUST aliases are overwritten, MAY aliases merged, PARTIAL merged only
    for element writes.

    ``values`` (keys, value, level), ``writes`` (keys, value, level, is_element), ``aliases`` (keys, a,
    b, kind). Writes of one step are unordered, so their labels merge.
    """
    offers = writes.withColumnRenamed("value", "a").join(aliases, keys + ["a"])
    offers = offers.where("kind in ('MUST', 'MAY') or (kind = 'PARTIAL' and is_element)")
    per_value = offers.groupBy(*keys, F.col("b").alias("value")).agg(
        F.max("level").alias("offered"), F.bool_or(F.col("kind") == "MUST").alias("must")
    )
    old = F.when(F.col("must"), F.lit(None)).otherwise(F.col("level"))
    return values.join(per_value, keys + ["value"], "left").select(
        *keys, "value", F.greatest(old, "offered").cast("int").alias("level")
    )


def element_labels(writes: DataFrame, keys: list[str]) -> DataFrame:
    """Labels per element after ordered writes, (keys, value, elem, level), elem -1 = the whole.

    A write with a constant index sets its element; one without merges into every element. So an
    element holds its last own write and all index-less writes after it; the whole is the merge.
    ``writes``: (keys, value, elem NULL or >= 0, idx, level).
    """
    at = keys + ["value"]
    own = writes.where("elem is not null").groupBy(*at, "elem").agg(
        F.max("idx").alias("idx"), F.max_by("level", "idx").alias("level")
    )
    loose = writes.where("elem is null").select(*at, F.lit(None).cast("int").alias("elem"), "idx", "level")
    both = OrderedRows(own.select(*at, "elem", "idx", "level").unionByName(loose), at, ["idx"])
    both.max_before(F.when(F.col("elem").isNull(), F.col("level")), "_later", desc=True)
    elements = both.result().where("elem is not null").select(
        *at, "elem", F.greatest("level", "_later").cast("int").alias("level")
    )
    rest = loose.select(*at, "level").unionByName(elements.select(*at, "level"))
    whole = rest.groupBy(*at).agg(F.max("level").cast("int").alias("level"))
    return elements.unionByName(whole.withColumn("elem", F.lit(-1)).select(*elements.columns))


def first_label(nodes: DataFrame, candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """Label of the first candidate that has any fact for a node; facts of one candidate merge.

    ``candidates`` are long form (keys, node, level, ref).
    """
    ranked = None
    for rank, facts in enumerate(candidates):
        part = facts.select(*keys, "node", F.lit(rank).alias("rank"), "level", "ref")
        ranked = part if ranked is None else ranked.unionByName(part)
    args = csv(F.collect_set(F.when(F.col("level") == ARG, F.col("ref"))))
    merged = ranked.groupBy(*keys, "node", "rank").agg(
        F.struct(F.max("level").alias("level"), F.when(F.max("level") == ARG, args).otherwise("").alias("args")).alias("label")
    )
    best = merged.groupBy(*keys, "node").agg(F.min_by(F.struct("label", "rank"), "rank").alias("b"))
    return nodes.join(best, keys + ["node"], "left").select(
        *nodes.columns, F.col("b.label.level").alias("level"), F.col("b.label.args").alias("args"), F.col("b.rank").alias("source")
    )


def load_labels(loads: DataFrame, candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """Label of a load: the first of pointer value, pointer row, referenced values, argument root,
    root value, root row; else it depends on its memory root as a value."""
    found = first_label(loads, candidates, keys)
    return found.withColumn("level", F.coalesce("level", F.lit(VALUE))).fillna({"args": "", "source": -1})


def argument_operands(operands: DataFrame, alias_args: DataFrame, keys: list[str]) -> DataFrame:
    """Arguments an operand stands for: itself if it is one, else all it may alias.

    ``operands`` (keys, node, ref, arg NULL unless the operand is one), ``alias_args`` (keys, ref, arg).
    """
    own = operands.where("arg is not null").select(*keys, "node", "arg")
    seen = operands.where("arg is null").drop("arg").join(alias_args, keys + ["ref"]).select(*keys, "node", "arg")
    return own.union(seen).distinct()


def label_set_difference(facts: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """U4: drop resolved values from value labels, (keys, node, level, n_values).

    ``facts`` (keys, node, value), ``resolved`` (keys, value). A label whose values are all resolved
    is INDEP.
    """
    open_ = facts.join(resolved.select(*keys, "value").distinct().withColumn("_r", F.lit(True)), keys + ["value"], "left")
    counted = open_.groupBy(*keys, "node").agg(F.count_if(F.col("_r").isNull()).alias("n_values"))
    return counted.select(
        *keys, "node", F.when(F.col("n_values") > 0, VALUE).otherwise(INDEP).cast("int").alias("level"), "n_values"
    )
