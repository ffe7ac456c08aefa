"""What several operators share: tables, words, rows kept whole, batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise  # noqa: F401  used by the operators

#: A word: a run of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What is run inside hands whole texts to Python in batches of no more than ``rows``, so that neither side holds many at once."""
    before = int(spark.conf.get(BATCH_CONF))
    spark.conf.set(BATCH_CONF, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` inside one struct, so that no name of theirs can clash with ours."""
    return docs.select(F.struct("*").alias("row"))


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns."""
    return docs.select(*[docs[n].alias(n) for n in names])


def ids_repeat(docs: DataFrame) -> bool:
    """Whether several rows have one doc_id, looked up over the ids alone."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def with_tie(docs: DataFrame, whole: bool = False, repeat: bool | None = None) -> DataFrame:
    """(doc_id, tie, text): ``tie`` tells rows with one doc_id apart, by a hash of their text; 0 if no id repeats.

    Whether any id repeats only decides whether the hash is needed. ``whole`` adds ``row``, a struct of all columns.
    """
    repeat = ids_repeat(docs) if repeat is None else repeat
    tie = F.xxhash64(docs["text"]) if repeat else F.lit(0).cast("long")
    more = [F.struct("*").alias("row")] if whole else []
    return docs.select(docs["doc_id"].alias("doc_id"), tie.alias("tie"), docs["text"].alias("text"), *more)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes, so that what a task holds doesn't hang on the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and the n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]
