"""Ordered columns with split keys must equal plain windows."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import OrderedRows


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    # Key 0 holds most rows, key 3 only one.
    data = [(0 if rnd.random() < 0.6 else rnd.randint(1, 2), i, rnd.randint(0, 50), f"v{i}") for i in range(300)]
    return spark.createDataFrame(data + [(3, 999, 1, "x")], "k int, o int, n int, s string").cache()


def test_split_equals_plain(rows):
    w = Window.partitionBy("k").orderBy("o")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("k").orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select(
        "k", "o",
        F.row_number().over(w).alias("rn"),
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"),
        F.lag("s").over(w).alias("lag"),
        F.lead("s").over(w).alias("lead"),
        F.max("n").over(before).alias("mb"),
        F.max("n").over(after).alias("ma"),
    )
    split = OrderedRows(rows, ["k"], ["o"], limit=20)
    assert split.split
    got = (
        split.row_number("rn").running_sum(F.col("n"), "sum").lag("s", "lag").lead("s", "lead")
        .max_before(F.col("n"), "mb").max_before(F.col("n"), "ma", desc=True).result().select(plain.columns)
    )
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


def test_cold_keys_stay_whole(rows):
    assert not OrderedRows(rows, ["k"], ["o"], limit=1000).split


def _all_columns(rows, limit):
    ordered = OrderedRows(rows, ["k", "j"], ["o"], limit=limit)
    out = (
        ordered.row_number("rn").running_sum(F.col("n"), "sum").running_sum(F.col("d"), "dec").lag("s", "lag")
        .lead("s", "lead").max_before(F.col("n"), "mb").max_before(F.col("n"), "ma", desc=True).result()
    )
    return ordered.split, out.select("k", "j", "o", "rn", "sum", "dec", "lag", "lead", "mb", "ma")


def test_null_keys_and_values_survive_the_cut(spark):
    rnd = random.Random(8)
    # The NULL key is hot; leading values of a key are NULL.
    data = [
        (None if i % 2 else rnd.choice([1, None]), rnd.choice([None, 5]) if i % 3 else None, i,
         None if i < 60 or i % 5 == 0 else rnd.randint(-9, 9), None if i % 7 == 0 else Decimal(i), None if i % 4 else f"v{i}")
        for i in range(240)
    ]
    rows = spark.createDataFrame(data, "k int, j int, o int, n int, d decimal(20,2), s string")
    plain_split, plain = _all_columns(rows, 10_000)
    split, cut = _all_columns(rows, 20)
    assert split and not plain_split
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert sorted(cut.collect(), key=str) == sorted(plain.collect(), key=str)
    assert cut.count() == len(data)
