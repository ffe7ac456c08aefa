"""Where intermediate tables live, and how a plan is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Files this many times smaller than a broadcast may be are taken for small without counting their rows.
LEAST_BYTES = 64
_local_dirs: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a scratch folder only for local masters."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_dirs[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The returned frame has no lineage but the files, so a lost executor costs a re-read, and the
    optimizer sees the true size when it picks a join.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return sized(spark.read.schema(df.schema).parquet(path))


def too_large(df: DataFrame, rows: int) -> bool:
    """Whether ``rows`` rows like those of ``df`` are more than a broadcast may hold by Spark's own size of a row."""
    limit = _broadcast_limit(df.sparkSession)
    return limit >= 0 and rows * (8 + df._jdf.schema().defaultSize()) > limit


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, read from files, so that it is not broadcast for being small as files only.

    Spark takes the bytes of the files for the size of a table. Columns of repeated numbers take a byte a row there but a hundred in
    the hash table that the driver builds of a broadcast. A table with more rows than a broadcast may hold (counted in the
    footers) gets an empty frame of unknown size added: its joins begin as shuffles, and their measured sizes decide.
    """
    spark, limit = df.sparkSession, _broadcast_limit(df.sparkSession)
    if limit < 0:
        return df
    if rows is None:
        files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if files * LEAST_BYTES < limit:
            return df
        # Of large files a few columns may still seem small.
        rows = df.count() if files <= limit else None
    if rows is not None and not too_large(df, rows):
        return df
    return df.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema))


def _broadcast_limit(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
