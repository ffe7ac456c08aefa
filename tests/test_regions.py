"""Merged regions, their six conditions, and rows counted once, on hand-written graphs."""

from __future__ import annotations

from tidemark.operators import control as K


def tables(spark, regions, rows, operands, edges):
    df = spark.createDataFrame
    return (
        df([(0, 1, s, t, b) for s, t, bs in regions for b in bs], "module int, fn long, start int, stop int, block int"),
        df([(0, 1, b, i, b * 10 + i) for b, n in rows.items() for i in range(n)], "module int, fn long, block int, idx long, inst long"),
        df([(0, 1, a, b) for a, b in operands], "module int, fn long, src long, dst long"),
        df([(0, 1, a, b) for a, b in edges], "module int, fn long, src int, dst int"),
    )


def test_merged_regions_start_and_stop(spark):
    """1 -> 4 and 4 -> 6 continue each other, 2 -> 4 lies in the first; 8 -> 9 stands alone."""
    regions, *_ = tables(spark, [(1, 4, [1, 2, 3]), (2, 4, [2]), (4, 6, [4, 5]), (8, 9, [8])], {}, [(1, 1)], [(1, 1)])
    merged = K.merge_regions(regions)
    got = {}
    for r in K.merged_bodies(regions, merged).collect():
        got.setdefault((r.start, r.stop), set()).add(r.block)
    assert got == {(1, 6): {1, 2, 3, 4, 5}, (8, 9): {8}}


def test_regions_on_a_cycle_take_the_smallest_start(spark):
    regions, *_ = tables(spark, [(1, 2, [1]), (2, 1, [2])], {}, [(1, 1)], [(1, 1)])
    got = {(r.start, r.stop, r.block) for r in K.merged_bodies(regions, K.merge_regions(regions)).collect()}
    assert got == {(1, -1, 1), (1, -1, 2)}


def test_each_condition_fails_alone(spark):
    """One region of blocks 2 and 3 between 1 and 4; each condition is broken by itself."""
    base = {"operands": [(10, 20), (20, 30)], "edges": [(1, 2), (2, 3), (3, 4)], "known": [10], "phis": [], "pads": [], "dead": []}
    cases = {
        "ok": {}, "n_escaping": {"operands": [(10, 20), (20, 40)]}, "n_jumps": {"edges": [(1, 2), (2, 3), (3, 4), (2, 5)]},
        "n_entries": {"edges": [(1, 2), (2, 3), (3, 4), (1, 3)]}, "n_unknown": {"known": []}, "n_phi": {"phis": [20]}, "n_landing": {"pads": [4]},
    }
    df = spark.createDataFrame
    for name, change in cases.items():
        c = base | change
        regions, rows, operands, edges = tables(spark, [(2, 4, [2, 3])], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}, c["operands"], c["edges"])
        r = K.region_is_closed(
            regions, rows, operands, edges, df([(0, 1, b) for b in c["dead"]], "module int, fn long, block int"),
            df([(0, 1, 2, o) for o in c["known"]], "module int, fn long, start int, operand long"),
            df([(0, 1, i) for i in c["phis"]], "module int, fn long, inst long"),
            df([(0, 1, b) for b in c["pads"]], "module int, fn long, block int"),
        ).collect()[0]
        failed = {n for n in cases if n != "ok" and r[n]}
        assert (failed, r.is_closed) == ((set(), True) if name == "ok" else ({name}, False)), name
    # An entry from a block that cannot be reached doesn't count.
    regions, rows, operands, edges = tables(spark, [(2, 4, [2, 3])], {1: 1, 2: 1, 3: 1, 4: 1}, base["operands"], [(1, 2), (2, 3), (3, 4), (7, 3)])
    assert K.region_is_closed(regions, rows, operands, edges, df([(0, 1, 7)], "module int, fn long, block int")).collect()[0].is_closed


def test_rows_of_overlapping_regions_and_runs_count_once(spark):
    regions, rows, _, _ = tables(spark, [(1, 4, [1, 2, 3]), (2, 4, [2, 3])], {1: 2, 2: 3, 3: 1, 4: 4}, [(1, 1)], [(1, 1)])
    df = spark.createDataFrame
    bodies = K.merged_bodies(regions, K.merge_regions(regions))
    closed = df([(0, 1, 1, True)], "module int, fn long, start int, is_closed boolean")
    runs = df([(0, 1, 2, 0, 1), (0, 1, 4, 1, 3)], "module int, fn long, block int, begin_idx long, end_idx long")
    blocks = df([(0, 1, b) for b in (1, 2, 3, 4)], "module int, fn long, block int")
    got = K.extraction_totals(bodies, closed, runs, rows, blocks).collect()
    assert [r.asDict() for r in got] == [{"module": 0, "n_regions": 1, "n_region_rows": 6, "n_functions": 1, "n_extracted": 0, "n_runs": 1, "n_run_rows": 3, "n_rows": 9}]
    whole = K.extraction_totals(bodies, closed, runs.limit(0), rows, blocks.where("block < 4")).collect()
    assert whole[0].n_extracted == 1
