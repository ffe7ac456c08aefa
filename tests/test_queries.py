"""Registered queries against their SQL at the smallest scale.

The looping ones take long in one local JVM; set TIDEMARK_ALL=1 to run them here too, or use
``python tests/check.py 0.01``.
"""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from tests.check import compare, connect
from tidemark.queries import all_queries as queries
from tidemark.queries import all_sql as oracle_sql

LOOPS = {
    "g3_post_dominators", "g4_control_labels", "g5_block_effects", "g6_merge_at_joins", "g9_loop_membership",
    "g10_loop_taint", "g12_cut_vertices", "g13_region_between", "r1_region_inputs", "r2_region_is_closed",
    "r3_merge_regions", "a13_extraction_stats", "a9_module_size", "g7_scc", "g8_resolve_condensed", "c1_call_levels",
    "c2_function_summaries", "c3_finalise_arguments", "c5_dependent_functions", "c6_call_determinism", "e1_label_program",
    "e3_extract_program", "a5_indep_coverage", "a6_dep_coverage", "s4_label_store", "a14_coverage_before_after",
    "a12_specialisation_stats", "p3_variant_labels", "u3_referenced_globals", "g1_propagate", "g11_backward_roots",
}
NAMES = sorted(n for n in queries() if os.environ.get("TIDEMARK_ALL") or n not in LOOPS)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, con):
    ok, n, message = compare(queries()[name](spark, sf_dir), con, oracle_sql()[name])
    assert ok, message
    assert n > 0


def test_entry(spark):
    assert entry(spark).count() == 15
