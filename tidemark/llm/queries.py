"""The operators as named queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embed, licenses, line_chunks, minhash, mixer, mixing, pieces, pii, quality, secrets, spelling, suffix, whitening
from tidemark.llm.common import table
from tidemark.llm.oracles import OP10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL for what SQL can express.
SQL = {"op10_quality_rules": OP10}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir))


@query
def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup(table(spark, sf_dir))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir))


@query
def op4_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir))
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS]
    named = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = F.expr(f"sha2(array_join({named.format("filter(spans, s -> s.kind <> 'guess')")}, ','), 256)")
    return found.select("doc_id", *n, base.alias("base_sha256"), F.expr(f"array_join({named.format('spans')}, ',')").alias("spans"), "log10_guesses")


@query
def op5_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir))


@query
def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_template_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir)).drop("spans")


@query
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixer.score(table(spark, sf_dir))


@query
def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir)).select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query
def op11_span_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir))
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    named = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = f"filter(spans, s -> s.kind in {pii.KINDS})"
    return found.select("doc_id", *n, F.expr(f"sha2({named.format(base)}, 256)").alias("base_sha256"), F.expr(named.format("spans")).alias("spans"))


@query
def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir))
