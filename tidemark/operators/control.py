"""Control dependence (G4-G6, G10, G13, G14) and regions.

Rows, blocks and loops are nodes of one dependence graph named ``r:<row>``, ``b:<block>``,
``l:<loop>``; whatever a label flows through becomes an edge, and one ``graph.propagate`` over the
union settles data, control and loop effects together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions.labels import ARG, DEP
from tidemark.operators import small
from tidemark.operators.fixpoint import chase, closure, pace, relax
from tidemark.operators.graph import FN, along
from tidemark.session import materialise

BLOCK = ["module", "fn", "block"]


def row_node(col) -> F.Column:
    return F.concat(F.lit("r:"), F.col(col).cast("string"))


def block_node(col) -> F.Column:
    return F.concat(F.lit("b:"), F.col(col).cast("string"))


def loop_node(col) -> F.Column:
    return F.concat(F.lit("l:"), F.col(col).cast("string"))


def decided_blocks(blocks: DataFrame, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Blocks that run in any case: they post-dominate all their predecessors and the entry.

    ``tree``: see ``graph.post_dominator_tree``; one interval test per edge, no pairs of blocks.
    """
    entry = blocks.where("is_entry").select(*FN, F.col("block").alias("entry"))
    asked = edges.select(*FN, F.col("dst").alias("block"), F.col("src").alias("before"))
    asked = asked.union(
        blocks.select(*BLOCK).join(entry, FN).where("block <> entry").select(*BLOCK, F.col("entry").alias("before"))
    )
    over = asked.join(tree.select(*BLOCK, "first", "last"), BLOCK, "left").join(
        tree.select(*FN, F.col("block").alias("before"), F.col("first").alias("at")), FN + ["before"], "left"
    )
    failed = over.where("not coalesce(first < at and at <= last, false)").select(*BLOCK).distinct()
    return blocks.select(*BLOCK).join(failed, BLOCK, "left_anti")


def control_edges(blocks: DataFrame, edges: DataFrame, terminators: DataFrame, tree: DataFrame) -> DataFrame:
    """G4 as edges: a conditional terminator decides the successors that do not run in any case.

    ``terminators``: (module, fn, block, inst, is_conditional). Blocks that cannot be reached have no
    terminator label and so add nothing.
    """
    decided = decided_blocks(blocks, edges, tree).withColumnRenamed("block", "dst")
    open_edges = edges.join(decided, FN + ["dst"], "left_anti")
    branch = terminators.where("is_conditional").select(*FN, F.col("block").alias("src"), "inst")
    return open_edges.join(branch, FN + ["src"]).select(*FN, row_node("inst").alias("src"), block_node("dst").alias("dst"))


def control_labels(
    blocks: DataFrame, edges: DataFrame, terminators: DataFrame, tree: DataFrame, facts: DataFrame
) -> DataFrame:
    """Facts of blocks from the given facts of rows (module, fn, inst, level, ref).

    A predecessor without a terminator counts as ARG on no particular argument.
    """
    open_edges = control_edges(blocks, edges, terminators, tree)
    at = facts.select(*FN, row_node("inst").alias("src"), "level", "ref")
    known = open_edges.join(at, FN + ["src"]).select(*FN, F.expr("substring(dst, 3)").cast("int").alias("block"), "level", "ref")
    bare = edges.join(terminators.select(*FN, F.col("block").alias("src")), FN + ["src"], "left_anti")
    decided = decided_blocks(blocks, edges, tree)
    lost = bare.select(*FN, F.col("dst").alias("block")).join(decided, BLOCK, "left_anti").distinct()
    return known.union(lost.select(*BLOCK, F.lit(ARG), F.lit(-1))).distinct()


def block_effects(instructions: DataFrame) -> DataFrame:
    """G5 as edges: a block's label reaches all its rows."""
    return instructions.select(*FN, block_node("block").alias("src"), row_node("inst").alias("dst"))


def data_edges(operands: DataFrame) -> DataFrame:
    return operands.select(*FN, row_node("src").alias("src"), row_node("dst").alias("dst"))


def merge_at_joins(phis: DataFrame, edges: DataFrame, last_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, seeds) of merge rows: labels of incoming blocks and of the values they bring.

    ``phis`` (module, fn, block, inst), ``last_rows`` (module, fn, block, inst): the value a block
    hands on. A merge row that nothing reaches is DEP.
    """
    into = phis.join(edges.select(*FN, F.col("dst").alias("block"), F.col("src").alias("before")), BLOCK)
    blocks = into.select(*FN, block_node("before").alias("src"), row_node("inst").alias("dst"))
    brought = last_rows.select(*FN, F.col("block").alias("before"), F.col("inst").alias("value"))
    values = into.join(brought, FN + ["before"]).select(*FN, row_node("value").alias("src"), row_node("inst").alias("dst"))
    reached = into.select(*FN, "inst").distinct()
    alone = phis.select(*FN, "inst").join(reached, FN + ["inst"], "left_anti")
    seeds = alone.select(*FN, row_node("inst").alias("node"), F.lit(DEP).alias("level"), F.lit(-1).alias("ref"))
    return blocks.union(values).distinct(), seeds


def loop_taint(loops: DataFrame, terminators: DataFrame) -> DataFrame:
    """G10 as edges: conditional terminators of header, latch or exiting blocks decide the loop, the
    loop all its blocks."""
    deciding = loops.where("is_header or is_latch or is_exiting").select(*BLOCK, "loop")
    branch = terminators.where("is_conditional").select(*BLOCK, "inst")
    into = deciding.join(branch, BLOCK).select(*FN, row_node("inst").alias("src"), loop_node("loop").alias("dst"))
    out = loops.select(*FN, loop_node("loop").alias("src"), block_node("block").alias("dst"))
    return into.union(out)


def region_starts(blocks: DataFrame, terminators: DataFrame, dep_blocks: DataFrame, dep_rows: DataFrame) -> DataFrame:
    """Blocks that are dependent or whose terminator is."""
    ends = terminators.join(dep_rows.select(*FN, "inst"), FN + ["inst"], "left_semi").select(*BLOCK)
    return blocks.select(*BLOCK).join(dep_blocks.select(*BLOCK).union(ends).distinct(), BLOCK, "left_semi")


def region_stops(starts: DataFrame, blocks: DataFrame, dep_blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """Stop of the region of each start: the nearest post-dominator that is not dependent or is the last.

    ``tree``: see ``graph.post_dominator_tree``. Dependent blocks point to their parents; following these by
    pointer doubling ends at the nearest fit one, so tables hold one row per block.
    """
    last = blocks.where("is_exit").select(*FN, F.col("block").alias("last"))
    dep = dep_blocks.select(*BLOCK).distinct().join(last.withColumnRenamed("last", "block"), BLOCK, "left_anti")
    dep = materialise(dep, "unfit")
    links = tree.where("parent is not null").join(dep, BLOCK, "left_semi")
    links = links.select(*FN, F.col("block").alias("src"), F.col("parent").alias("dst"))
    block = links.schema["src"].dataType
    fields = [("src", block), ("end", block), ("steps", LongType())]
    ends = small.either([links], FN, small.ends, fields, lambda l: chase(l, FN))
    ends = ends.select(*FN, F.col("src").alias("parent"), "end")
    over = starts.select(*BLOCK).join(tree.select(*BLOCK, "parent"), BLOCK).join(ends, FN + ["parent"], "left")
    fit = over.select(*FN, F.col("block").alias("start"), F.coalesce("end", "parent").alias("block"))
    fit = fit.join(dep, BLOCK, "left_anti").select(*FN, F.col("start").alias("block"), F.col("block").alias("stop"))
    return (
        starts.select(*BLOCK).join(last, FN).join(fit, BLOCK, "left")
        .select(*FN, F.col("block").alias("start"), F.coalesce("stop", "last").alias("stop"))
    )


def region_between(stops: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, fn, start, stop, block): blocks from start up to, without, stop."""
    stops = stops.where("start <> stop").select(*FN, "start", "stop")
    fields = [(n, stops.schema["start"].dataType) for n in ("start", "stop", "block")]
    return small.either([stops, edges.select(*FN, "src", "dst")], FN, small.between, fields, _region_between)


def _region_between(stops: DataFrame, edges: DataFrame) -> DataFrame:
    speed = pace(edges, FN)
    edges = edges.select(*FN, F.col("src").alias("block"), F.col("dst").alias("_next"))
    seed = stops.select(*FN, "start", "stop", F.col("start").alias("block"))

    def step(delta: DataFrame) -> DataFrame:
        moved = delta.join(edges, BLOCK).where(F.col("_next") != F.col("stop"))
        return moved.select(*FN, "start", "stop", F.col("_next").alias("block"))

    return closure(seed, step, **speed)


def region_inputs(regions: DataFrame, instructions: DataFrame, operands: DataFrame) -> DataFrame:
    """Rows read by a region but made outside, (module, fn, start, operand).

    Storage rows (``is_storage``) used by rows of one region only move in and are no input.
    """
    place = instructions.select(*BLOCK, "inst")
    inside = regions.select(*FN, "start", "block").join(place, BLOCK).select(*FN, "start", "inst")
    read = inside.join(operands.select(*FN, F.col("dst").alias("inst"), F.col("src").alias("operand")), FN + ["inst"])
    outside = read.select(*FN, "start", "operand").distinct().join(
        inside.withColumnRenamed("inst", "operand"), FN + ["start", "operand"], "left_anti"
    )
    if "is_storage" not in instructions.columns:
        return outside
    storage = instructions.where("is_storage").select(*FN, F.col("inst").alias("operand"))
    # Readers of each storage row in all, against those in the region.
    all_reads = operands.groupBy(*FN, F.col("src").alias("operand")).agg(F.count(F.lit(1)).alias("n_all"))
    own_reads = read.groupBy(*FN, "start", "operand").agg(F.count(F.lit(1)).alias("n_own"))
    moves = (
        own_reads.join(storage, FN + ["operand"], "left_semi").join(all_reads, FN + ["operand"])
        .where("n_own = n_all").select(*FN, "start", "operand")
    )
    return outside.join(moves, FN + ["start", "operand"], "left_anti")


def region_is_closed(
    regions: DataFrame,
    instructions: DataFrame,
    operands: DataFrame,
    edges: DataFrame,
    unreachable: DataFrame,
    inputs: DataFrame | None = None,
    phis: DataFrame | None = None,
    landing_pads: DataFrame | None = None,
) -> DataFrame:
    """R2: (module, fn, start, n_escaping, n_jumps, n_entries[, n_unknown][, n_phi][, n_landing], is_closed).

    Escaping: a row inside is read outside. Jumps: an edge leaves to anything but the stop. Entries: a
    block other than the start has a predecessor outside that can be reached. Unknown: a row from outside
    is read that is none of ``inputs`` (module, fn, start, operand). Phi: a row inside reads one of ``phis``
    (module, fn, inst), whose value hangs on the way in. Landing: the stop is one of ``landing_pads`` (module, fn, block).
    """
    key = FN + ["start"]
    place = instructions.select(*BLOCK, "inst")
    inside = regions.select(*key, "block").join(place, BLOCK).select(*key, "inst")
    used = inside.join(operands.select(*FN, F.col("src").alias("inst"), F.col("dst").alias("reader")), FN + ["inst"])
    escaping = used.join(inside.withColumnRenamed("inst", "reader"), key + ["reader"], "left_anti")
    body = regions.select(*key, "stop", "block")
    out = body.join(edges.select(*FN, F.col("src").alias("block"), F.col("dst").alias("to")), BLOCK)
    jumps = out.where("to <> stop").join(body.select(*key, F.col("block").alias("to")), key + ["to"], "left_anti")
    live = edges.join(unreachable.select(*FN, F.col("block").alias("src")), FN + ["src"], "left_anti")
    into = body.where("block <> start").join(
        live.select(*FN, F.col("dst").alias("block"), F.col("src").alias("before")), BLOCK
    )
    entries = into.join(body.select(*key, F.col("block").alias("before")), key + ["before"], "left_anti")
    failures = [(escaping, "n_escaping"), (jumps, "n_jumps"), (entries, "n_entries")]
    reads = inside.join(operands.select(*FN, F.col("dst").alias("inst"), F.col("src").alias("operand")), FN + ["inst"])
    if inputs is not None:
        foreign = reads.select(*key, "operand").distinct()
        foreign = foreign.join(inside.withColumnRenamed("inst", "operand"), key + ["operand"], "left_anti")
        failures.append((foreign.join(inputs.select(*key, "operand"), key + ["operand"], "left_anti"), "n_unknown"))
    if phis is not None:
        failures.append((reads.join(phis.select(*FN, F.col("inst").alias("operand")), FN + ["operand"], "left_semi"), "n_phi"))
    if landing_pads is not None:
        stops = regions.select(*key, "stop").distinct().join(landing_pads.select(*FN, F.col("block").alias("stop")), FN + ["stop"], "left_semi")
        failures.append((stops, "n_landing"))
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    all_ = regions.select(*key).distinct()
    for df, name in failures:
        all_ = all_.join(count(df, name), key, "left")
    return all_.fillna(0).withColumn("is_closed", sum((F.col(n) for _, n in failures[1:]), F.col("n_escaping")) == 0)


def merge_regions(regions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Regions that share a block, or continue one into the other, become one, (module, fn, region, block).

    Connected parts of the graph of regions and blocks, so popular blocks cost one edge per region;
    a merged region is named by its smallest start.
    """
    own = regions.select(*FN, F.col("start").cast("long").alias("r"), "block")
    # A region that stops where another starts continues into it.
    next_ = regions.select(*FN, F.col("start").cast("long").alias("r"), F.col("stop").alias("start")).distinct()
    goes_on = next_.join(regions.select(*FN, "start").distinct(), FN + ["start"], "left_semi").select(
        *FN, "r", F.col("start").alias("block")
    )
    links = own.union(goes_on).distinct()
    region_name = F.concat(F.lit("s"), F.col("r").cast("string"))
    links = materialise(links.select(*FN, region_name.alias("a"), block_node("block").alias("b"), "r"), "region_links")
    both = links.select(*FN, F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.union(links.select(*FN, F.col("b"), F.col("a")))
    seed = links.select(*FN, F.col("a").alias("node"), F.col("r").alias("region"))
    fields = [(n, seed.schema[n].dataType) for n in ("node", "region")]
    rounds = lambda seed, both: relax(seed, along(both, FN), FN + ["node"], "region", hops=4)
    named = small.either([seed, both], FN, small.least, fields, rounds)
    own_named = own.withColumn("node", region_name).join(named, FN + ["node"])
    return own_named.select(*FN, "region", "block").distinct()


def extraction_stats(regions: DataFrame, closed: DataFrame, instructions: DataFrame) -> DataFrame:
    """Closed regions and the rows in them, per module."""
    key = FN + ["start"]
    rows = instructions.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    fit = closed.where("is_closed").select(*key)
    sized = regions.join(fit, key, "left_semi").join(rows, BLOCK).groupBy(*key).agg(F.sum("n").alias("n"))
    return sized.groupBy("module").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n").alias("n_rows"))


def merged_bodies(regions: DataFrame, merged: DataFrame) -> DataFrame:
    """R3 in the shape of regions, (module, fn, start, stop, block), to be tested again.

    A merged region starts where no other of its regions leads (the smallest such start, or the smallest of all on a
    cycle of regions) and stops at the smallest stop outside its blocks; with further ones R2 counts jumps. No stop outside: -1.
    """
    parts = regions.select(*FN, "start", "stop").distinct()
    of = parts.join(merged.select(*FN, "region", F.col("block").alias("start")), FN + ["start"])
    held = regions.groupBy(*FN, F.col("block").alias("start")).agg(F.count(F.lit(1)).alias("_times"))
    ends = parts.select(*FN, F.col("stop").alias("start")).distinct().withColumn("_end", F.lit(True))
    inner = merged.select(*FN, "region", F.col("block").alias("stop")).withColumn("_in", F.lit(True))
    seen = of.join(held, FN + ["start"]).join(ends, FN + ["start"], "left").join(inner, FN + ["region", "stop"], "left")
    first = F.min(F.when((F.col("_times") == 1) & F.col("_end").isNull(), F.col("start")))
    last = F.min(F.when(F.col("_in").isNull(), F.col("stop")))
    span = seen.groupBy(*FN, "region").agg(F.coalesce(first, F.min("start")).alias("start"), F.coalesce(last, F.lit(-1)).alias("stop"))
    return merged.join(span, FN + ["region"]).select(*FN, "start", "stop", "block")


def extraction_totals(bodies: DataFrame, closed: DataFrame, runs: DataFrame, instructions: DataFrame, blocks: DataFrame) -> DataFrame:
    """A13 over merged regions and runs, per module: every row once.

    Closed merged regions share no block; a run (module, fn, block, begin_idx, end_idx) inside one of them is part of it.
    ``n_extracted`` counts functions all of whose blocks are in one closed region.
    """
    kept = materialise(bodies.join(closed.where("is_closed").select(*FN, "start"), FN + ["start"], "left_semi"), "kept_bodies")
    rows = instructions.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    sized = kept.join(rows, BLOCK, "left").groupBy(*FN, "start").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_blocks"))
    whole = sized.join(blocks.groupBy(*FN).agg(F.count(F.lit(1)).alias("_all")), FN)
    regions = whole.groupBy("module").agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum("n").alias("n_region_rows"), F.countDistinct("fn").alias("n_functions"), F.count_if(F.col("n_blocks") == F.col("_all")).alias("n_extracted")
    )
    alone = runs.join(kept.select(*BLOCK), BLOCK, "left_anti")
    spans = alone.groupBy("module").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("end_idx") - F.col("begin_idx") + 1).alias("n_run_rows"))
    found = regions.join(spans, "module", "full_outer").fillna(0)
    names = ["n_regions", "n_region_rows", "n_functions", "n_extracted", "n_runs", "n_run_rows"]
    return found.select("module", *[F.col(n).cast("long").alias(n) for n in names], (F.col("n_region_rows") + F.col("n_run_rows")).cast("long").alias("n_rows"))
