"""Every operator and stage on nulls, empty, long and repeated rows, on no rows, and beside columns of its own names."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.fixtures import DOCS, clashing, docs, edges, rows_of
from tidemark.llm import licenses, line_chunks, minhash, mixer, mixing, pieces, quality, secrets, suffix

OPERATORS = {
    "mixing": mixing.mix,
    "line_chunks": line_chunks.dedup,
    "pieces": pieces.encode,
    "secrets": secrets.scan,
    "suffix": suffix.digest,
    "licenses": licenses.scan,
    "mixer": mixer.score,
    "minhash": minhash.near_duplicates,
    "quality": quality.assess,
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    df = docs(spark, edges())
    plain = OPERATORS[name](df)
    got = rows_of(plain)
    assert len(got) == len(edges())
    assert rows_of(OPERATORS[name](clashing(df))) == got


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    out = OPERATORS[name](spark.createDataFrame([], DOCS))
    assert out.collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stage_edges(spark, name):
    df = clashing(docs(spark, edges()))
    out = STAGES[name](spark, df, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == df.columns
    assert len(out.collect()) <= 3 * len(edges())
    assert STAGES[name](spark, df.limit(0), "").collect() == []


def test_copies_and_nulls_have_their_results(spark):
    got = {(r.doc_id, r.n_removed) for r in suffix.digest(docs(spark, edges())).collect()}
    n = next(len(t) for i, t, *_ in edges() if i == 7)
    assert (6, 0) in got and (7, n) in got  # the later copy goes, the first stays
    assert (8, 0) in got  # equal rows are one document
    near = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, edges())).collect()]
    assert (7, 6, False) in near and (-3, -4, False) in near and (None, None, True) in near and (2, 2, True) in near
    words = {r.doc_id: r for r in licenses.scan(docs(spark, edges())).collect()}
    assert words[1].n_words == 0 and words[1].labels == "" and words[1].score == 0
    ids = {r.doc_id: r for r in pieces.encode(docs(spark, edges())).collect()}
    assert ids[1].ids is None and ids[2].ids == [] and ids[6].round_trip
