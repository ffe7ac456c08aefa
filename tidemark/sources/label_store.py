"""The label cache at three grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import DEP, INDEP

FN = ["module", "fn"]
BLOCK = ["module", "fn", "block"]


def write_labels(functions: DataFrame, status: DataFrame, rows: DataFrame, path: str) -> None:
    """Function tags, block tags, and row tags of independent blocks only.

    ``status`` is the block table of ``coverage.block_status``.
    """
    fn_tag = F.when(F.col("is_extracted"), "extracted").when(F.col("is_dep_fn"), "dep").otherwise("indep")
    functions.select(*FN, fn_tag.alias("tag")).write.parquet(f"{path}/functions")
    status.select(*BLOCK, F.col("status").alias("tag")).write.parquet(f"{path}/blocks")
    row_tag = F.when(F.col("level") == DEP, "dep").when(F.col("level") == INDEP, "indep").otherwise("unknown")
    (
        rows.join(status.where("status = 'indep'"), BLOCK, "left_semi")
        .select(*FN, "inst", row_tag.alias("tag"))
        .write.parquet(f"{path}/rows")
    )


def read_labels(spark: SparkSession, path: str, instructions: DataFrame) -> DataFrame:
    """Row labels from the tags: the block decides first, a block without a tag is dependent."""
    block_tags = spark.read.schema("module int, fn long, block int, tag string").parquet(f"{path}/blocks")
    row_tags = spark.read.schema("module int, fn long, inst long, tag string").parquet(f"{path}/rows")
    return (
        instructions.select(*BLOCK, "inst")
        .join(block_tags.withColumnRenamed("tag", "block_tag"), BLOCK, "left")
        .join(row_tags.withColumnRenamed("tag", "row_tag"), FN + ["inst"], "left")
        .select(
            *BLOCK,
            "inst",
            F.when(F.col("block_tag") == "indep", F.coalesce("row_tag", F.lit("unknown")))
            .otherwise(F.coalesce("block_tag", F.lit("dep")))
            .alias("tag"),
        )
    )


def read_function_tags(spark: SparkSession, path: str) -> DataFrame:
    """(module, fn, tag) of functions: extracted, dep or indep."""
    return spark.read.schema("module int, fn long, tag string").parquet(f"{path}/functions")
