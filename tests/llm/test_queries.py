"""Every query of the package runs over the smallest tables; those with SQL equal it."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries
from tests.check import compare, connect
from tidemark.llm.queries import QUERIES, SQL

ROWS = {name: "embeddings" if name.startswith("op6_") else "documents" for name in QUERIES}
#: Queries that return other than a row for each row.
OTHER = {"op12_block_whitening", "op13_spelling_tiles"}


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        ok, n, message = compare(df, connect(sf_dir), SQL[name])
        assert ok, message
    else:
        n = df.count()
    assert n > 0 if name in OTHER else n == spark.read.parquet(f"{sf_dir}/{ROWS[name]}.parquet").count()


def test_pipeline_runs(spark, sf_dir):
    out = queries()["pipeline"](spark, sf_dir)
    assert out.columns[0] == "doc_id" and out.filter("not round_trip").count() == 0 and out.count() > 0
