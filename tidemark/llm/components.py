"""Connected components of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b) of longs: the smallest node reachable. Nodes without a link are not listed.

    Rounds of large and small stars: each hangs nodes on the smallest of their neighbourhood, so paths shorten by
    halves; a centre with many neighbours is one minimum, combined on the map side.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "links")
    while True:
        owners = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        inner = e.select(F.col("b").alias("a")).distinct()
        if owners.filter("n > 1").isEmpty() and owners.join(inner, "a", "left_semi").isEmpty():
            return e.selectExpr("a as node", "b as component").unionByName(e.selectExpr("b as node", "b as component").distinct())
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).selectExpr("b as a", "m as b").filter("a <> b").distinct()
        large = materialise(large, "large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = large.join(low, F.col("a") == F.col("u")).selectExpr("inline(array(struct(a as a, m as b), struct(b as a, m as b)))").filter("a <> b").distinct()
        e = materialise(hung, "links")
