"""Graph operators on edge tables (G*): ``keys`` name the graph a node belongs to.

Edges are ``(keys, src, dst)``. Facts are long-form labels ``(keys, node, level, ref)``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemark.functions.labels import ARG, DEP, INDEP, csv
from tidemark.operators import dominance, forest, small
from tidemark.operators.fixpoint import chase, closure, pace, relax, same, skip_links
from tidemark.session import materialise

FN = ["module", "fn"]


def along(edges: DataFrame, keys: list[str], node: str = "node"):
    """Step that moves the rows at ``src`` to ``dst``."""
    by_src = edges.select(*keys, F.col("src").alias(node), F.col("dst").alias("_next"))

    def step(delta: DataFrame) -> DataFrame:
        rest = [c for c in delta.columns if c not in keys + [node]]
        return delta.join(by_src, keys + [node]).select(*keys, F.col("_next").alias(node), *rest).select(*delta.columns)

    return step


def reachable(starts: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes reachable from ``starts`` (keys, node), the starts included."""
    return spread(starts.select(*keys, "node"), edges, keys)


def spread(seed: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``seed`` (keys, node, ...) carried along the edges to every node they reach."""
    cols = seed.columns
    rest = [c for c in seed.columns if c not in keys + ["node"]]
    seed, edges = seed.select(*keys, "node", *rest), edges.select(*keys, "src", "dst").distinct()
    fields = [(c, seed.schema[c].dataType) for c in ["node", *rest]]
    linear = partial(small.few_walks, rest)
    return small.either([seed, edges], keys, small.spread, fields, partial(_spread, keys), linear).select(*cols)


def _spread(keys: list[str], seed: DataFrame, edges: DataFrame, **known) -> DataFrame:
    edges = skip_links(edges, keys)
    return closure(seed, along(edges, keys), **known, **pace(edges, keys))


def unreachable_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks not reachable from the entry block."""
    entries = blocks.where("is_entry").select(*FN, F.col("block").alias("node"))
    live = reachable(entries, edges, FN).withColumnRenamed("node", "block")
    return blocks.select(*FN, "block").join(live, FN + ["block"], "left_anti")


def propagate(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """G1: facts of every node = its own seeds and the facts of what it depends on (src -> dst)."""
    facts = seeds.select(*keys, "node", "level", "ref")
    # A node at the top level takes no further facts.
    covered = (F.col("old.level") == DEP) | same(["level", "ref"])
    edges = edges.select(*keys, "src", "dst").distinct()
    fields = [(c, facts.schema[c].dataType) for c in ("node", "level", "ref")]
    rounds = partial(_spread, keys, by=keys + ["node"], covered=covered)
    return small.either([facts, edges], keys, partial(small.facts, DEP), fields, rounds, partial(small.few_walks, ["level", "ref"]))


def node_labels(nodes: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """One label per node: greatest level; argument list at level ARG. Nodes without facts are INDEP."""
    per_node = facts.groupBy(*keys, "node").agg(
        F.max("level").alias("level"), csv(F.collect_set(F.when(F.col("level") == ARG, F.col("ref")))).alias("args")
    )
    return nodes.select(*keys, "node").join(per_node, keys + ["node"], "left").select(
        *keys,
        "node",
        F.coalesce("level", F.lit(INDEP)).cast("int").alias("level"),
        F.when(F.col("level") == ARG, F.col("args")).otherwise("").alias("args"),
    )


def scc(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, comp), comp = smallest node of the component; nodes without edges are not listed.

    Each pass sends the smallest colour forward and backward at once. A node that meets its own
    colour both ways is in the component of that colour; edges between nodes of different colour
    pairs cannot lie on a cycle and are cut, so passes shrink fast.
    """
    node = edges.schema["src"].dataType
    edges = edges.select(*keys, "src", "dst").distinct()
    return small.either([edges], keys, small.components, [("node", node), ("comp", node)], partial(_scc, keys), linear=True)


def _scc(keys: list[str], edges: DataFrame) -> DataFrame:
    ends = lambda e: e.select(*keys, F.col("src").alias("node")).union(e.select(*keys, F.col("dst").alias("node")))
    nodes = ends(edges).distinct()
    left = materialise(_trim(edges, keys), "scc_left")
    found = None
    while not left.isEmpty():
        both = materialise(
            left.select(*keys, "src", "dst", F.lit(0).alias("way")).union(
                left.select(*keys, F.col("dst"), F.col("src"), F.lit(1))
            ),
            "scc_both",
        )
        # Hashed colours: along a chain of rising ids plain ids would improve once per step.
        color = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        start = both.select(*keys, F.col("src").alias("node"), "way").union(both.select(*keys, F.col("dst"), F.col("way")))
        seed = start.distinct().withColumn("color", color)
        colors = relax(seed, along(both, keys + ["way"]), keys + ["way", "node"], "color", **pace(left, keys))
        pair = materialise(
            colors.groupBy(*keys, "node").agg(
                F.max(F.when(F.col("way") == 0, F.col("color"))).alias("fw"),
                F.max(F.when(F.col("way") == 1, F.col("color"))).alias("bw"),
            ),
            "scc_pair",
        )
        met = pair.where("fw = bw").select(*keys, "node", F.col("fw.id").alias("root"))
        found = met if found is None else found.union(met)
        rest = pair.where("fw <> bw")
        side = lambda end: rest.select(
            *keys, F.col("node").alias(end), F.col("fw").alias(f"{end}_fw"), F.col("bw").alias(f"{end}_bw")
        )
        kept = left.join(side("src"), keys + ["src"]).join(side("dst"), keys + ["dst"])
        kept = kept.where("src_fw = dst_fw and src_bw = dst_bw").select(*keys, "src", "dst")
        left = materialise(_trim(kept, keys), "scc_left")
    if found is None:
        return nodes.withColumn("comp", F.col("node"))
    smallest = found.groupBy(*keys, "root").agg(F.min("node").alias("comp"))
    named = found.join(smallest, keys + ["root"]).select(*keys, "node", "comp")
    return nodes.join(named, keys + ["node"], "left").select(
        *keys, "node", F.coalesce("comp", "node").alias("comp")
    )


def _trim(edges: DataFrame, keys: list[str], times: int = 3) -> DataFrame:
    """Drop edges whose source has no edge in, or whose target has no edge out, a few times."""
    for _ in range(times):
        into = edges.select(*keys, F.col("dst").alias("src"))
        out = edges.select(*keys, F.col("src").alias("dst"))
        edges = materialise(edges.join(into, keys + ["src"], "left_semi").join(out, keys + ["dst"], "left_semi"), "trim")
    return edges


def condense(comps: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between different components."""
    side = lambda end: comps.select(*keys, F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    return (
        edges.join(side("src"), keys + ["src"])
        .join(side("dst"), keys + ["dst"])
        .where("src_comp <> dst_comp")
        .select(*keys, F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"))
        .distinct()
    )


def resolve_condensed(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Labels on the graph of components; members of a cycle share one label.

    What is left of a cycle that only depends on itself has no facts and so is independent.
    """
    comps = materialise(scc(edges, keys), "comps")
    comp_seeds = (
        seeds.join(comps, keys + ["node"], "left")
        .select(*keys, F.coalesce("comp", "node").alias("node"), "level", "ref")
        .distinct()
    )
    facts = propagate(comp_seeds, condense(comps, edges, keys), keys)
    members = facts.withColumnRenamed("node", "comp").join(comps, keys + ["comp"], "left")
    return members.select(*keys, F.coalesce("node", "comp").alias("node"), "level", "ref").distinct()


def levels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Longest distance to a leaf on the graph of components, (keys, node, comp, level).

    ``src`` calls ``dst``; leaves are level 0, so callees always come before callers. An optional
    column ``weight`` says how much an edge counts (0 for a hop that is only bookkeeping); an edge that
    leaves a cycle always counts.
    """
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1))
    edges = edges.select(*keys, "src", "dst", F.col("weight").cast("int").alias("weight"))
    node = edges.schema["src"].dataType
    fields = [("node", node), ("comp", node), ("level", IntegerType())]
    return small.either([edges], keys, small.heights, fields, partial(_levels, keys), linear=True)


def _levels(keys: list[str], edges: DataFrame) -> DataFrame:
    comps = materialise(scc(edges, keys), "comps")
    side = lambda end: comps.select(*keys, F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    cycles = comps.groupBy(*keys, F.col("comp").alias("src_comp")).count().where("count > 1")
    cycles = cycles.select(*keys, "src_comp", F.lit(1).alias("_cycle"))
    up = materialise(
        edges.join(side("src"), keys + ["src"])
        .join(side("dst"), keys + ["dst"])
        .where("src_comp <> dst_comp")
        .join(cycles, keys + ["src_comp"], "left")
        .groupBy(*keys, F.col("dst_comp").alias("node"), F.col("src_comp").alias("_next"))
        .agg(F.max(F.coalesce("_cycle", "weight")).alias("weight")),
        "level_dag",
    )
    seed = comps.select(*keys, F.col("comp").alias("node")).distinct().withColumn("level", F.lit(0))
    step = lambda delta: delta.join(up, keys + ["node"]).select(
        *keys, F.col("_next").alias("node"), (F.col("level") + F.col("weight")).cast("int").alias("level")
    )
    flat = up.select(*keys, F.col("node").alias("src"), F.col("_next").alias("dst"))
    depth = relax(seed, step, keys + ["node"], "level", best=F.max, **pace(flat, keys)).withColumnRenamed("node", "comp")
    return comps.join(depth, keys + ["comp"]).select(*keys, "node", "comp", "level")


def loops(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Outermost loop of a block with header, latch and exiting flags and the number of headers.

    A loop is a component with more than one block or a self edge, named by its smallest block. A
    loop entered in several places is one loop with several headers.
    """
    comps = materialise(scc(edges.select(*FN, "src", "dst"), FN), "comps")
    named = lambda end: comps.select(*FN, F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    tagged = materialise(edges.join(named("src"), FN + ["src"]).join(named("dst"), FN + ["dst"]), "tagged")
    inner = tagged.where("src_comp = dst_comp")
    heads = inner.select(*FN, F.col("src_comp").alias("loop")).distinct()
    members = comps.withColumnRenamed("comp", "loop").join(heads, FN + ["loop"], "left_semi")
    entered = tagged.where("src_comp <> dst_comp").select(*FN, F.col("dst").alias("node"))
    entry = blocks.where("is_entry").select(*FN, F.col("block").alias("node"))
    flag = lambda df, name: df.select(*FN, "node").distinct().withColumn(name, F.lit(True))
    headers = members.join(entered.union(entry).distinct(), FN + ["node"], "left_semi")
    headers = materialise(headers, "headers")
    latches = inner.join(headers.select(*FN, F.col("node").alias("dst")), FN + ["dst"], "left_semi").select(
        *FN, F.col("src").alias("node")
    )
    leaving = tagged.where("src_comp <> dst_comp").select(*FN, F.col("src").alias("node"))
    n_heads = headers.groupBy(*FN, "loop").agg(F.count(F.lit(1)).alias("n_headers"))
    out = members
    for df, name in ((headers, "is_header"), (latches, "is_latch"), (leaving, "is_exiting")):
        out = out.join(flag(df, name), FN + ["node"], "left")
    return out.join(n_heads, FN + ["loop"], "left").select(
        *FN,
        F.col("node").alias("block"),
        "loop",
        *[F.coalesce(n, F.lit(False)).alias(n) for n in ("is_header", "is_latch", "is_exiting")],
        F.coalesce("n_headers", F.lit(0)).alias("n_headers"),
    )


def dominators(root: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Strict dominators in pairs: (keys, node, dom, steps), steps = how far up the dominator tree; one root per graph."""
    parents = dominance.immediate_dominators(root, edges, keys)
    return dominance.ancestors(parents, keys).withColumnRenamed("above", "dom")


def _from_exits(blocks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, edges) of the reversed graph; several exits join in a virtual one, -1."""
    virtual = F.lit(-1).cast(edges.schema["src"].dataType)
    exits = blocks.where("is_exit").select(*FN, virtual.alias("src"), F.col("block").alias("dst"))
    back = edges.select(*FN, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return exits.select(*FN, F.col("src").alias("node")).distinct(), back.union(exits)


def post_dominator_tree(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """G3 as a tree: (module, fn, block, parent, first, last), ``parent`` the nearest strict post-dominator or NULL.

    One row per block that reaches an exit. ``x`` post-dominates ``y`` exactly if ``x.first < y.first <= x.last``.
    """
    tree = dominance.dominator_tree(*_from_exits(blocks, edges), FN).where("node <> -1")
    return tree.select(*FN, F.col("node").alias("block"), F.when(F.col("parent") != -1, F.col("parent")).alias("parent"), "first", "last")


def post_dominators(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Strict post-dominators in pairs (module, fn, block, pdom, steps); the nearest is one step away."""
    dom = dominators(*_from_exits(blocks, edges), FN).where("dom <> -1")
    return dom.select(*FN, F.col("node").alias("block"), F.col("dom").alias("pdom"), "steps")


def cut_vertices(edges: DataFrame, keys: list[str] = FN) -> DataFrame:
    """Nodes whose removal disconnects the undirected graph of ``edges``; see ``forest.cut_vertices``."""
    edges = edges.select(*keys, "src", "dst")
    return small.either([edges], keys, small.cuts, [("node", edges.schema["src"].dataType)], lambda e: forest.cut_vertices(e, keys))


def backward_roots(starts: DataFrame, operands: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, root): the roots a start reads, walking operands back and stopping at roots.

    ``operands`` are (src = producer, dst = consumer); ``roots`` (keys, node) stop the walk.
    """
    reads = operands.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    stop = materialise(roots.select(*keys, "node").distinct(), "roots")
    open_reads = materialise(reads.join(stop.withColumnRenamed("node", "src"), keys + ["src"], "left_anti"), "reads")
    seed = starts.select(*keys, F.col("node").alias("start"), "node")
    seen = spread(seed, open_reads, keys)
    return seen.join(stop, keys + ["node"], "left_semi").select(*keys, "start", F.col("node").alias("root"))


def memory_roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """Pointer -> the storage it stands for, (keys, node, root).

    ``links`` hold one (src = pointer, dst = what it is computed from) per pointer that is not a root.
    """
    return chase(links, keys).select(*keys, F.col("src").alias("node"), F.col("end").alias("root"))
