"""Ordered columns (row number, lag, running sum) that do not put one key into one task.

A plain window sorts a whole key in one task. Keys with more than ``limit`` rows are cut into value
ranges first; each range is a window of its own and a one-row-per-range summary carries the state
across the cuts.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

ROWS_PER_TASK = 20_000_000
LIMIT_CONF = "spark.tidemark.rowsPerTask"


class OrderedRows:
    """Rows of ``df`` in ``order`` inside ``keys``; each method adds one column to ``self.df``.

    ``order`` must be a total order inside a key; NULL keys are keys. Without ``rows``, a bound on the row
    count, ``df`` is written once, so that counting it does not run it twice. Cut or not, values and types
    are the same.
    """

    def __init__(
        self, df: DataFrame, keys: list[str], order: list[str], limit: int | None = None, rows: int | None = None
    ):
        spark = df.sparkSession
        self.keys, self.order = keys, order
        limit = limit or int(spark.conf.get(LIMIT_CONF, str(ROWS_PER_TASK)))
        if rows is None:
            df = materialise(df, "ordered_rows")
            rows = df.count()
        small = rows <= limit
        self.df, self.split = (df, False) if small else self._split(df, limit)

    def _split(self, df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
        hot = materialise(df.groupBy(*self.keys).count().where(F.col("count") > limit), "hot_keys")
        rows = hot.agg(F.sum("count")).first()[0]
        if not rows:
            return df, False
        hot = hot.drop("count")
        parts = 2 * math.ceil(rows / limit)
        # The range number must be the same in every later branch, so it is written down once.
        is_hot = self._same_keys(df, hot)
        ranged = materialise(
            df.join(hot, is_hot, "left_semi")
            .repartitionByRange(parts, *self.keys, *self.order)
            .withColumn("_range", F.spark_partition_id()),
            "hot_rows",
        )
        cold = df.join(hot, is_hot, "left_anti").withColumn("_range", F.lit(0))
        return cold.unionByName(ranged), True

    def _same_keys(self, a: DataFrame, b: DataFrame, more: tuple[str, ...] = ()) -> Column:
        """Equal keys, NULL with NULL."""
        return reduce(and_, [a[c].eqNullSafe(b[c]) for c in (*self.keys, *more)])

    def _window(self, desc: bool = False):
        cols = [F.col(c).desc() if desc else F.col(c).asc() for c in self.order]
        keys = self.keys + (["_range"] if self.split else [])
        return Window.partitionBy(*keys).orderBy(*cols)

    def _carried(self, summary: Column, carry, desc: bool = False) -> DataFrame:
        """Per (key, range): ``carry(window)`` over the summaries of the ranges before it."""
        order = F.col("_range").desc() if desc else F.col("_range").asc()
        w = Window.partitionBy(*self.keys).orderBy(order)
        per_range = self.df.groupBy(*self.keys, "_range").agg(summary.alias("_s"))
        return per_range.select(*self.keys, "_range", carry(w).alias("_c"))

    def _join_carry(self, local: DataFrame, carried: DataFrame, name: str, combine: Column) -> None:
        kind = local.schema["_l"].dataType
        names = {c: f"_k{i}" for i, c in enumerate([*self.keys, "_range"])}
        carried = carried.withColumnsRenamed(names)
        met = reduce(and_, [local[c].eqNullSafe(carried[k]) for c, k in names.items()])
        self.df = local.join(carried, met).withColumn(name, combine.cast(kind)).drop("_l", "_c", *names.values())

    @staticmethod
    def _before(w):
        return w.rowsBetween(Window.unboundedPreceding, -1)

    def row_number(self, name: str) -> "OrderedRows":
        """1-based position inside the key."""
        local = F.row_number().over(self._window()).cast("long")
        if not self.split:
            self.df = self.df.withColumn(name, local)
            return self
        carried = self._carried(
            F.count(F.lit(1)), lambda w: F.coalesce(F.sum("_s").over(self._before(w)), F.lit(0))
        )
        self._join_carry(self.df.withColumn("_l", local), carried, name, (F.col("_l") + F.col("_c")))
        return self

    def running_sum(self, value: Column, name: str) -> "OrderedRows":
        """Sum of ``value`` up to and including the row."""
        local = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            self.df = self.df.withColumn(name, local)
            return self
        carried = self._carried(F.sum(value), lambda w: F.sum("_s").over(self._before(w)))
        both = F.coalesce(F.col("_l") + F.col("_c"), F.col("_l"), F.col("_c"))
        self._join_carry(self.df.withColumn("_l", local), carried, name, both)
        return self

    def max_before(self, value: Column, name: str, desc: bool = False) -> "OrderedRows":
        """Greatest ``value`` of the rows before this one (after it, if ``desc``); NULL if none."""
        local = F.max(value).over(self._before(self._window(desc)))
        if not self.split:
            self.df = self.df.withColumn(name, local)
            return self
        carried = self._carried(F.max(value), lambda w: F.max("_s").over(self._before(w)), desc)
        self._join_carry(self.df.withColumn("_l", local), carried, name, F.greatest("_l", "_c"))
        return self

    def lag(self, column: str, name: str, lead: bool = False) -> "OrderedRows":
        """``column`` of the row before (after, if ``lead``); NULL at the start."""
        local = F.lag(column).over(self._window(desc=lead))
        if not self.split:
            self.df = self.df.withColumn(name, local)
            return self
        edge = F.min_by if lead else F.max_by
        order = F.struct(*self.order)
        summary = edge(F.struct(column), order)
        carried = self._carried(summary, lambda w: F.lag("_s").over(w), desc=lead)
        first = F.row_number().over(self._window(desc=lead)) == 1
        local_df = self.df.withColumn("_l", local).withColumn("_first", first)
        self._join_carry(
            local_df, carried, name, F.when(F.col("_first"), F.col(f"_c.{column}")).otherwise(F.col("_l"))
        )
        self.df = self.df.drop("_first")
        return self

    def lead(self, column: str, name: str) -> "OrderedRows":
        return self.lag(column, name, lead=True)

    def result(self) -> DataFrame:
        return self.df.drop("_range") if self.split else self.df
