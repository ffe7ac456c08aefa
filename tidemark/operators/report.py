"""Reports: flat and nested statistics, locations, root causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_long(metrics: DataFrame, section: str, keys: list[str], names: list[str], kind: str) -> DataFrame:
    """One line per (section, function, kind, name); a name is the key columns joined by dots."""
    owner = F.concat_ws(".", *[F.col(k).cast("string") for k in keys])
    wide = metrics.select(owner.alias("owner"), *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(["owner"], names, "name", "value").select(
        F.lit(section).alias("section"), "owner", F.lit(kind).alias("kind"), "name", "value"
    )


def report_json(long: DataFrame) -> DataFrame:
    """One nested document per (section, owner); an empty section, owner or kind level is left out.

    The groups are bounded by the number of metric names, not by the data. Names are escaped by ``to_json``.
    """
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
    kinds = long.groupBy("section", "owner", "kind").agg(entries.alias("m"))
    plain = F.max_by("m", F.col("kind") == "").alias("plain")
    named = F.sort_array(F.collect_list(F.when(F.col("kind") != "", F.struct("kind", F.map_entries("m").alias("e")))))
    docs = kinds.groupBy("section", "owner").agg(plain, F.bool_or(F.col("kind") == "").alias("flat"), named.alias("named"))
    by_kind = F.map_from_entries(F.transform("named", lambda x: F.struct(x["kind"], F.map_from_entries(x["e"]))))
    some = F.size("named") > 0
    # Metrics without a kind stand beside the named kinds: two objects become one.
    one, two = F.to_json("plain"), F.to_json(by_kind)
    both = F.concat(F.expr("left(one, char_length(one) - 1)"), F.lit(","), F.expr("substring(two, 2, char_length(two))"))
    body = F.when(F.col("flat") & some, both).when(F.col("flat"), F.col("one")).otherwise(F.col("two"))

    def under(name: str, inner: Column) -> Column:
        """``inner`` as the value of key ``name``, which ``to_json`` escapes; an empty name adds no level."""
        key = F.to_json(F.create_map(F.col(name), F.lit(0)))
        return F.when(F.col(name) == "", inner).otherwise(F.concat(F.substring(key, F.lit(1), F.char_length(key) - 2), inner, F.lit("}")))

    whole = docs.withColumns({"one": one, "two": two}).withColumn("body", body)
    return whole.select("section", "owner", under("section", under("owner", F.col("body"))).alias("doc"))


def label_locations(labels: DataFrame) -> DataFrame:
    """Lines of dependent rows; a missing line is kept apart by ``missing_locations``."""
    return labels.where((F.col("level") == 4) & F.col("line").isNotNull()).select("module", "fn", "inst", "line")


def missing_locations(labels: DataFrame) -> DataFrame:
    """Dependent rows and how many of them have no location, per module."""
    return labels.where(F.col("level") == 4).groupBy("module").agg(
        F.count(F.lit(1)).alias("n_dep"), F.count_if(F.col("line").isNull()).alias("n_unlocated")
    )


def seed_records(*causes: tuple[DataFrame, str]) -> DataFrame:
    """Rows where dependence starts, with the cause; each (row, cause) once."""
    out = None
    for rows, cause in causes:
        part = rows.select("module", "fn", "inst", F.lit(cause).alias("cause"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
