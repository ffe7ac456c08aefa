"""Sessions whose instructions are written once."""

from __future__ import annotations

import threading

import pytest

from tidemark.sources import facts
from tidemark.sources.bindings import Sessions
from tidemark.sources.traces import Traces


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    return Sessions(spark, sf_dir), Sessions(spark, sf_dir, keep=True)


@pytest.mark.parametrize("name", ["instructions", "operands", "blocks", "block_edges", "events"])
def test_kept_tables_are_the_same_and_parse_nothing_again(both, name):
    plain, kept = (getattr(s, name) for s in both)
    cols = plain.columns
    assert kept.columns == cols and kept.count() > 0
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "Window" not in plan


@pytest.mark.parametrize("keep", [False, True])
def test_traces_have_their_modules_in_all_tables(spark, sf_dir, keep):
    t = Traces(spark, sf_dir, keep)
    for name in ("events", "instructions", "operands", "blocks", "block_edges"):
        rows = getattr(t, name)
        assert rows.where("module = fn % 2").count() == rows.count() > 0


def test_tables_are_written_beside_each_other_and_errors_are_raised(spark, tmp_path):
    seen = set()

    class Watched(dict):
        def __getitem__(self, key):
            seen.add(threading.current_thread().name)
            return super().__getitem__(key)

    rows = spark.createDataFrame([(0, 1, 0, True), (1, 1, 0, False)], "module int, fn long, arg_no int, is_pointer boolean")
    edges = spark.createDataFrame([(0, 1, 2, 3)], "module int, fn long, src int, dst int")
    facts.write_facts(Watched(args=rows, block_edges=edges), str(tmp_path / "f"))
    assert seen and threading.main_thread().name not in seen
    got = facts.load_facts(spark, str(tmp_path / "f"), ["args", "block_edges"])
    assert got["args"].count() == 2 and got["block_edges"].collect()[0].dst == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        facts.write_facts({"args": rows}, str(tmp_path / "f"))
