"""Queries over block, row and call graphs: G*, C*, U3, A9, R*."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.labels import DEP
from tidemark.operators import calls as C
from tidemark.operators import control as K
from tidemark.operators import coverage, graph
from tidemark.operators import interproc as I
from tidemark.queries.calls import (
    CALLBACK_SQL, GLOBALS_SQL, OWN_SQL, _MODELLED_SQL, global_labels, own_summaries, referenced, resolved_parts,
    session_callbacks,
)
from tidemark.queries.prelude import EVENTS, PARTS
from tidemark.queries.registry import query
from tidemark.session import materialise
from tidemark.sources.bindings import BLOCK, FN, Parts, Sessions


# ---- inside a function -----------------------------------------------------------------------

_LABELS_SQL = """SELECT e.module, e.fn, e.inst AS node, coalesce(max(f.level), 1) AS level,
      CASE WHEN max(f.level) = 3 THEN array_to_string(list_sort(list(DISTINCT f.ref)), ',') ELSE '' END AS args
      FROM ev e LEFT JOIN f ON f.node = e.inst GROUP BY ALL"""


@query(
    "g1_propagate",
    EVENTS
    + """, f(node, level, ref) AS (SELECT inst, level, coalesce(arg, -1) FROM ev WHERE level > 1
      UNION SELECT e.inst, f.level, f.ref FROM f JOIN ev e ON e.operand = f.node) """
    + _LABELS_SQL,
)
def g1(spark, sf):
    s = Sessions(spark, sf)
    facts = graph.propagate(s.seeds, s.operands, FN)
    return graph.node_labels(s.events.select(*FN, F.col("inst").alias("node")), facts, FN)


@query(
    "g2_unreachable_blocks",
    EVENTS
    + """SELECT module, fn, block FROM blk b
      WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.fn = b.fn AND r.block = b.block)""",
)
def g2(spark, sf):
    s = Sessions(spark, sf)
    return graph.unreachable_blocks(s.blocks, s.live_edges)


# Blocks that reach the exit without x; what cannot is post-dominated by x.
PDOM_SQL = """, ex AS (SELECT module, fn, block AS exit_ FROM blk WHERE is_exit),
    avoid(fn, x, node) AS (SELECT b.fn, b.block, e.exit_ FROM blk b JOIN ex e USING (fn) WHERE b.block <> e.exit_
      UNION SELECT a.fn, a.x, g.src FROM avoid a JOIN edge g ON g.fn = a.fn AND g.dst = a.node WHERE g.src <> a.x),
    pdom AS MATERIALIZED (SELECT b.module, b.fn, b.block, p.block AS pdom FROM blk b JOIN blk p ON p.fn = b.fn AND p.block <> b.block
      LEFT JOIN avoid a ON a.fn = b.fn AND a.x = p.block AND a.node = b.block WHERE a.node IS NULL),
    pdepth AS (SELECT module, fn, block, pdom, (SELECT count(*) FROM pdom q WHERE q.fn = p.fn AND q.block = p.pdom) AS above FROM pdom p)"""


@query("g3_post_dominators", EVENTS + PDOM_SQL + "SELECT module, fn, block, pdom FROM pdom")
def g3(spark, sf):
    s = Sessions(spark, sf)
    return graph.post_dominators(s.blocks, s.block_edges).drop("steps")


DECIDED_SQL = """, asked AS (SELECT module, fn, dst AS block, src AS before FROM edge
      UNION SELECT b.module, b.fn, b.block, e.entry FROM blk b JOIN ends e USING (module, fn) WHERE b.block <> e.entry),
    open_ AS MATERIALIZED (SELECT DISTINCT module, fn, block FROM asked a WHERE NOT EXISTS (
      SELECT 1 FROM pdom p WHERE p.fn = a.fn AND p.pdom = a.block AND p.block = a.before)),
    term AS MATERIALIZED (SELECT module, fn, block, inst, is_conditional, level, arg FROM ev WHERE is_terminator),
    cedges AS MATERIALIZED (SELECT g.module, g.fn, t.inst, g.dst AS block FROM edge g JOIN open_ o ON o.fn = g.fn AND o.block = g.dst
      JOIN term t ON t.fn = g.fn AND t.block = g.src AND t.is_conditional)"""


@query(
    "g4_control_labels",
    EVENTS
    + PDOM_SQL
    + DECIDED_SQL
    + """SELECT DISTINCT c.module, c.fn, c.block, e.level, coalesce(e.arg, -1) AS ref FROM cedges c JOIN ev e ON e.inst = c.inst
      WHERE e.level > 1""",
)
def g4(spark, sf):
    s = Sessions(spark, sf)
    terms = s.instructions.where("is_terminator")
    facts = s.seeds.withColumnRenamed("node", "inst")
    tree = materialise(graph.post_dominator_tree(s.blocks, s.block_edges), "pdom_tree")
    return K.control_labels(s.blocks, s.block_edges, terms, tree, facts)


def dependence_edges(s: Sessions, tree, phis=None, loops=None):
    """Union of data, control, block, join and loop edges of a session, and extra seeds."""
    rows = materialise(s.instructions, "rows")
    terms = rows.where("is_terminator")
    edges = K.data_edges(s.operands).union(K.block_effects(rows))
    edges = edges.union(K.control_edges(s.blocks, s.block_edges, terms, tree))
    seeds = s.seeds.withColumn("node", K.row_node("node"))
    if phis is not None:
        joins, extra = K.merge_at_joins(phis, s.block_edges, terms.select(*BLOCK, "inst"))
        edges, seeds = edges.union(joins), seeds.union(extra)
    if loops is not None:
        edges = edges.union(K.loop_taint(loops, terms))
    return edges, seeds


_FLOW_BASE_SQL = """, eff AS MATERIALIZED (SELECT operand AS src, inst AS dst FROM ev WHERE operand IS NOT NULL
      UNION ALL SELECT inst, -1 - (fn * 1000 + block) FROM cedges
      UNION ALL SELECT -1 - (fn * 1000 + block), inst FROM ev{more}),
    f(node, level, ref) AS (SELECT inst, level, coalesce(arg, -1) FROM ev WHERE level > 1 {seeds}
      UNION SELECT e.dst, f.level, f.ref FROM f JOIN eff e ON e.src = f.node) """


def _rows_of(s, edges, seeds):
    facts = graph.propagate(seeds, edges, FN)
    nodes = s.events.select(*FN, K.row_node("inst").alias("node"))
    return graph.node_labels(nodes, facts, FN).withColumn("node", F.substring("node", 3, 40).cast("long"))


@query("g5_block_effects", EVENTS + PDOM_SQL + DECIDED_SQL + _FLOW_BASE_SQL.format(more="", seeds="") + _LABELS_SQL)
def g5(spark, sf):
    s = Sessions(spark, sf)
    tree = materialise(graph.post_dominator_tree(s.blocks, s.block_edges), "pdom_tree")
    return _rows_of(s, *dependence_edges(s, tree))


_PHI_SQL = """ UNION ALL SELECT x.src, p.inst FROM (SELECT g.fn, g.dst, -1 - (g.fn * 1000 + g.src) AS src FROM edge g
        UNION ALL SELECT g.fn, g.dst, t.inst FROM edge g JOIN term t ON t.fn = g.fn AND t.block = g.src) x
      JOIN ev p ON p.fn = x.fn AND p.block = x.dst AND p.idx = 0 AND p.opcode = 'view'"""
_PHI_SEEDS = """UNION SELECT inst, 4, -1 FROM ev p WHERE idx = 0 AND opcode = 'view'
      AND NOT EXISTS (SELECT 1 FROM edge g WHERE g.fn = p.fn AND g.dst = p.block)"""


@query(
    "g6_merge_at_joins",
    EVENTS + PDOM_SQL + DECIDED_SQL + _FLOW_BASE_SQL.format(more=_PHI_SQL, seeds=_PHI_SEEDS) + _LABELS_SQL,
)
def g6(spark, sf):
    s = Sessions(spark, sf)
    tree = materialise(graph.post_dominator_tree(s.blocks, s.block_edges), "pdom_tree")
    phis = s.instructions.where("idx = 0 and opcode = 'view'").select(*BLOCK, "inst")
    return _rows_of(s, *dependence_edges(s, tree, phis=phis))


LOOP_SQL = """, bre(module, fn, a, b) AS (SELECT module, fn, src, dst FROM edge
      UNION SELECT r.module, r.fn, r.a, g.dst FROM bre r JOIN edge g ON g.fn = r.fn AND g.src = r.b),
    bloop AS MATERIALIZED (SELECT x.module, x.fn, x.a AS block, min(x.b) AS loop FROM bre x
      JOIN bre y ON y.fn = x.fn AND y.a = x.b AND y.b = x.a GROUP BY ALL),
    tag AS MATERIALIZED (SELECT g.*, s.loop AS sl, d.loop AS dl FROM edge g
      LEFT JOIN bloop s ON s.fn = g.fn AND s.block = g.src LEFT JOIN bloop d ON d.fn = g.fn AND d.block = g.dst),
    head AS MATERIALIZED (SELECT DISTINCT l.module, l.fn, l.block, l.loop FROM bloop l JOIN ends e USING (module, fn)
      WHERE l.block = e.entry OR EXISTS (SELECT 1 FROM tag t WHERE t.fn = l.fn AND t.dst = l.block AND t.sl IS DISTINCT FROM t.dl)),
    loops AS MATERIALIZED (SELECT l.module, l.fn, l.block, l.loop, h.block IS NOT NULL AS is_header,
      EXISTS (SELECT 1 FROM tag t JOIN head x ON x.fn = t.fn AND x.block = t.dst WHERE t.fn = l.fn AND t.src = l.block AND t.sl = t.dl) AS is_latch,
      EXISTS (SELECT 1 FROM tag t WHERE t.fn = l.fn AND t.src = l.block AND t.sl IS DISTINCT FROM t.dl) AS is_exiting,
      (SELECT count(*) FROM head x WHERE x.fn = l.fn AND x.loop = l.loop) AS n_headers
      FROM bloop l LEFT JOIN head h ON h.fn = l.fn AND h.block = l.block)"""


@query("g9_loop_membership", EVENTS + LOOP_SQL + "SELECT * FROM loops")
def g9(spark, sf):
    s = Sessions(spark, sf)
    return graph.loops(s.blocks, s.block_edges)


_TAINT_SQL = """ UNION ALL SELECT t.inst, -1000000000000 - (l.fn * 1000 + l.loop) FROM loops l JOIN term t ON t.fn = l.fn AND t.block = l.block
        AND t.is_conditional WHERE is_header OR is_latch OR is_exiting
      UNION ALL SELECT -1000000000000 - (fn * 1000 + loop), -1 - (fn * 1000 + block) FROM loops"""


@query(
    "g10_loop_taint",
    EVENTS + PDOM_SQL + DECIDED_SQL + LOOP_SQL + _FLOW_BASE_SQL.format(more=_TAINT_SQL, seeds="") + _LABELS_SQL,
)
def g10(spark, sf):
    s = Sessions(spark, sf)
    tree = materialise(graph.post_dominator_tree(s.blocks, s.block_edges), "pdom_tree")
    loops = materialise(graph.loops(s.blocks, s.block_edges), "loops")
    return _rows_of(s, *dependence_edges(s, tree, loops=loops))


@query(
    "g11_backward_roots",
    EVENTS
    + """, w(start, node) AS (SELECT inst, inst FROM ev WHERE is_terminator AND is_conditional
      UNION SELECT w.start, e.operand FROM w JOIN ev e ON e.inst = w.node WHERE e.value < 60 AND e.operand IS NOT NULL)
      SELECT e.module, e.fn, w.start, w.node AS root FROM w JOIN ev e ON e.inst = w.node WHERE e.value >= 60 OR e.operand IS NULL""",
)
def g11(spark, sf):
    s = Sessions(spark, sf)
    rows = materialise(s.instructions, "rows")
    starts = rows.where("is_terminator and is_conditional").select(*FN, F.col("inst").alias("node"))
    roots = rows.where("value >= 60 or operand is null").select(*FN, F.col("inst").alias("node"))
    reads = rows.where("operand is not null").select(*FN, F.col("operand").alias("src"), F.col("inst").alias("dst"))
    return graph.backward_roots(starts, reads, roots, FN)


@query(
    "g12_cut_vertices",
    EVENTS
    + """, ug AS MATERIALIZED (SELECT module, fn, src AS a, dst AS b FROM edge UNION SELECT module, fn, dst, src FROM edge),
      un AS MATERIALIZED (SELECT DISTINCT module, fn, a AS node FROM ug),
      w(fn, x, node) AS (SELECT u.fn, u.node, min(o.node) FROM un u JOIN un o ON o.fn = u.fn AND o.node <> u.node GROUP BY ALL
        UNION SELECT w.fn, w.x, g.b FROM w JOIN ug g ON g.fn = w.fn AND g.a = w.node WHERE g.b <> w.x)
      SELECT u.module, u.fn, u.node FROM un u JOIN (SELECT fn, x, count(*) AS n FROM w GROUP BY ALL) r ON r.fn = u.fn AND r.x = u.node
      WHERE r.n < (SELECT count(*) FROM un o WHERE o.fn = u.fn) - 1""",
)
def g12(spark, sf):
    return graph.cut_vertices(Sessions(spark, sf).block_edges)


_REGION_SQL = """, starts AS MATERIALIZED (SELECT DISTINCT b.module, b.fn, b.block FROM blk b WHERE EXISTS (
        SELECT 1 FROM hotblk h WHERE h.fn = b.fn AND h.block = b.block)
      OR EXISTS (SELECT 1 FROM ev e WHERE e.fn = b.fn AND e.block = b.block AND e.is_terminator AND e.level = 3 AND e.value >= 40)),
    stops AS MATERIALIZED (SELECT s.module, s.fn, s.block AS start, coalesce((SELECT p.pdom FROM pdepth p WHERE p.fn = s.fn AND p.block = s.block
        AND (p.pdom = e.exit_ OR NOT EXISTS (SELECT 1 FROM hotblk h WHERE h.fn = p.fn AND h.block = p.pdom))
        ORDER BY p.above DESC LIMIT 1), e.exit_) AS stop FROM starts s JOIN ends e USING (module, fn)),
    region(module, fn, start, stop, block) AS (SELECT module, fn, start, stop, start FROM stops WHERE start <> stop
      UNION SELECT r.module, r.fn, r.start, r.stop, g.dst FROM region r JOIN edge g ON g.fn = r.fn AND g.src = r.block WHERE g.dst <> r.stop)"""


@query("g14_region_starts", EVENTS + PDOM_SQL + _REGION_SQL + "SELECT * FROM starts")
def g14(spark, sf):
    return session_starts(Sessions(spark, sf))[0]


def session_starts(s: Sessions):
    rows = materialise(s.instructions, "rows")
    hot = rows.where(F.col("level") == DEP).select(*BLOCK).distinct()
    dep_rows = rows.where("level = 3 and value >= 40")
    return K.region_starts(s.blocks, rows.where("is_terminator"), hot, dep_rows), hot, rows


def session_regions(s: Sessions):
    starts, hot, rows = session_starts(s)
    tree = materialise(graph.post_dominator_tree(s.blocks, s.block_edges), "pdom_tree")
    stops = K.region_stops(starts, s.blocks, hot, tree)
    return materialise(K.region_between(stops, s.block_edges), "regions"), rows


@query("g13_region_between", EVENTS + PDOM_SQL + _REGION_SQL + "SELECT * FROM region")
def g13(spark, sf):
    return session_regions(Sessions(spark, sf))[0]


_INSIDE_SQL = """, inside AS MATERIALIZED (SELECT r.module, r.fn, r.start, e.inst, e.operand FROM region r
      JOIN ev e ON e.fn = r.fn AND e.block = r.block)"""


@query(
    "r1_region_inputs",
    EVENTS
    + PDOM_SQL
    + _REGION_SQL
    + _INSIDE_SQL
    + """SELECT DISTINCT i.module, i.fn, i.start, i.operand FROM inside i JOIN ev o ON o.inst = i.operand
      WHERE NOT EXISTS (SELECT 1 FROM inside j WHERE j.fn = i.fn AND j.start = i.start AND j.inst = i.operand)
      AND NOT (o.opcode = 'purchase' AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.operand = o.inst
        AND NOT EXISTS (SELECT 1 FROM inside j WHERE j.fn = i.fn AND j.start = i.start AND j.inst = c.inst)))""",
)
def r1(spark, sf):
    s = Sessions(spark, sf)
    regions, rows = session_regions(s)
    return K.region_inputs(regions, rows.withColumn("is_storage", F.col("opcode") == "purchase"), s.operands)


_CLOSED_SQL = (
    _INSIDE_SQL
    + """, closed AS (SELECT g.module, g.fn, g.start,
      (SELECT count(*) FROM inside i JOIN ev c ON c.operand = i.inst WHERE i.fn = g.fn AND i.start = g.start AND NOT EXISTS (
        SELECT 1 FROM inside j WHERE j.fn = g.fn AND j.start = g.start AND j.inst = c.inst)) AS n_escaping,
      (SELECT count(*) FROM region r JOIN edge x ON x.fn = r.fn AND x.src = r.block WHERE r.fn = g.fn AND r.start = g.start
        AND x.dst <> g.stop AND NOT EXISTS (SELECT 1 FROM region q WHERE q.fn = g.fn AND q.start = g.start AND q.block = x.dst)) AS n_jumps,
      (SELECT count(*) FROM region r JOIN edge x ON x.fn = r.fn AND x.dst = r.block JOIN reach v ON v.fn = x.fn AND v.block = x.src
        WHERE r.fn = g.fn AND r.start = g.start AND r.block <> g.start AND NOT EXISTS (
          SELECT 1 FROM region q WHERE q.fn = g.fn AND q.start = g.start AND q.block = x.src)) AS n_entries
      FROM (SELECT DISTINCT module, fn, start, stop FROM region) g)"""
)


@query(
    "r2_region_is_closed",
    EVENTS + PDOM_SQL + _REGION_SQL + _CLOSED_SQL + "SELECT *, n_escaping + n_jumps + n_entries = 0 AS is_closed FROM closed",
)
def r2(spark, sf):
    s = Sessions(spark, sf)
    regions, rows = session_regions(s)
    dead = materialise(graph.unreachable_blocks(s.blocks, s.live_edges), "dead")
    return K.region_is_closed(regions, rows, s.operands, s.block_edges, dead)


@query(
    "r3_merge_regions",
    EVENTS
    + PDOM_SQL
    + _REGION_SQL
    + """, lnk AS MATERIALIZED (SELECT DISTINCT fn, start, block FROM region
        UNION SELECT DISTINCT r.fn, r.start, r.stop FROM region r WHERE EXISTS (SELECT 1 FROM region q WHERE q.fn = r.fn AND q.start = r.stop)),
      cc(fn, start, other) AS (SELECT DISTINCT fn, start, start FROM region
        UNION SELECT c.fn, c.start, y.start FROM cc c JOIN lnk x ON x.fn = c.fn AND x.start = c.other
          JOIN lnk y ON y.fn = x.fn AND y.block = x.block)
      SELECT DISTINCT r.module, r.fn, CAST(n.region AS BIGINT) AS region, r.block FROM region r
      JOIN (SELECT fn, start, min(other) AS region FROM cc GROUP BY ALL) n ON n.fn = r.fn AND n.start = r.start""",
)
def r3(spark, sf):
    s = Sessions(spark, sf)
    regions, _ = session_regions(s)
    return K.merge_regions(regions, s.block_edges)


@query(
    "a13_extraction_stats",
    EVENTS
    + PDOM_SQL
    + _REGION_SQL
    + _CLOSED_SQL
    + """SELECT c.module, count(*) AS n_regions, sum((SELECT count(*) FROM inside i WHERE i.fn = c.fn AND i.start = c.start))::BIGINT AS n_rows
      FROM closed c WHERE n_escaping + n_jumps + n_entries = 0 GROUP BY ALL""",
)
def a13(spark, sf):
    s = Sessions(spark, sf)
    regions, rows = session_regions(s)
    dead = materialise(graph.unreachable_blocks(s.blocks, s.live_edges), "dead")
    closed = K.region_is_closed(regions, rows, s.operands, s.block_edges, dead)
    return K.extraction_stats(regions, closed, rows)


@query(
    "g15_memory_root",
    EVENTS
    + """, w(node, at_) AS (SELECT inst, operand FROM ev WHERE value < 60 AND operand IS NOT NULL
      UNION ALL SELECT w.node, e.operand FROM w JOIN ev e ON e.inst = w.at_ WHERE e.value < 60 AND e.operand IS NOT NULL)
      SELECT e.module, e.fn, w.node, w.at_ AS root FROM w JOIN ev e ON e.inst = w.at_ WHERE e.value >= 60 OR e.operand IS NULL""",
)
def g15(spark, sf):
    rows = Sessions(spark, sf).instructions.where("value < 60 and operand is not null")
    links = rows.select(*FN, F.col("inst").alias("src"), F.col("operand").alias("dst"))
    return graph.memory_roots(links, FN)


@query(
    "a9_module_size",
    EVENTS
    + LOOP_SQL
    + """SELECT module, (SELECT count(*) FROM fns f WHERE f.module = m.module) AS n_functions,
      (SELECT count(*) FROM blk b WHERE b.module = m.module) AS n_blocks,
      (SELECT count(*) FROM (SELECT DISTINCT module, fn, loop FROM loops) l WHERE l.module = m.module) AS n_loops,
      (SELECT count(*) FROM ev e WHERE e.module = m.module) AS n_rows,
      (SELECT count(*) FROM ev e JOIN loops l ON l.fn = e.fn AND l.block = e.block WHERE e.module = m.module) AS n_loop_rows
      FROM (SELECT DISTINCT module FROM ev) m""",
)
def a9(spark, sf):
    s = Sessions(spark, sf)
    loops = materialise(graph.loops(s.blocks, s.block_edges), "loops")
    return coverage.module_size(s.functions, s.blocks, loops, s.events)


# ---- one wide graph --------------------------------------------------------------------------

_PSCC_SQL = """, pre(module, a, b) AS (SELECT module, src, dst FROM pedge
      UNION SELECT r.module, r.a, e.dst FROM pre r JOIN pedge e ON e.module = r.module AND e.src = r.b),
    pnode AS (SELECT module, src AS node FROM pedge UNION SELECT module, dst FROM pedge),
    pcyc AS (SELECT x.module, x.a AS node, min(x.b) AS low FROM pre x JOIN pre y ON y.module = x.module AND y.a = x.b AND y.b = x.a GROUP BY ALL),
    pscc AS MATERIALIZED (SELECT n.module, n.node, coalesce(c.low, n.node) AS comp FROM pnode n LEFT JOIN pcyc c USING (module, node))"""


@query("g7_scc", PARTS + _PSCC_SQL + "SELECT * FROM pscc")
def g7(spark, sf):
    return graph.scc(Parts(spark, sf).edges, ["module"])


@query(
    "g8_resolve_condensed",
    PARTS
    + """, f(module, node) AS (SELECT module, fn FROM func WHERE p_size >= 45
      UNION SELECT f.module, e.dst FROM f JOIN pedge e ON e.module = f.module AND e.src = f.node)
      SELECT module, node, 4 AS level, -1 AS ref FROM f""",
)
def g8(spark, sf):
    p = Parts(spark, sf)
    return graph.resolve_condensed(p.seeds, p.edges, ["module"])


@query(
    "u3_referenced_globals",
    PARTS
    + GLOBALS_SQL
    + """, f(module, fn, global) AS (SELECT * FROM gref
      UNION SELECT f.module, e.src, f.global FROM f JOIN cedge e ON e.module = f.module AND e.dst = f.fn)
      SELECT * FROM f""",
)
def u3(spark, sf):
    p, r = resolved_parts(spark, sf)
    return I.reached_globals(referenced(p), r)


# ---- across functions ------------------------------------------------------------------------

CSCC_SQL = """, cre(module, a, b) AS (SELECT module, src, dst FROM cedge
      UNION SELECT r.module, r.a, e.dst FROM cre r JOIN cedge e ON e.module = r.module AND e.src = r.b),
    cnode AS (SELECT module, src AS node FROM cedge UNION SELECT module, dst FROM cedge),
    ccyc AS (SELECT x.module, x.a AS node, min(x.b) AS low FROM cre x JOIN cre y ON y.module = x.module AND y.a = x.b AND y.b = x.a GROUP BY ALL),
    cscc AS MATERIALIZED (SELECT n.module, n.node, coalesce(c.low, n.node) AS comp FROM cnode n LEFT JOIN ccyc c USING (module, node))"""


@query(
    "c1_call_levels",
    PARTS
    + CSCC_SQL
    + """, dag AS MATERIALIZED (SELECT DISTINCT e.module, d.comp AS low, s.comp AS up FROM cedge e JOIN cscc s ON s.module = e.module AND s.node = e.src
        JOIN cscc d ON d.module = e.module AND d.node = e.dst WHERE s.comp <> d.comp),
      lv(module, comp, level) AS (SELECT DISTINCT module, comp, 0 FROM cscc
        UNION SELECT l.module, d.up, l.level + 1 FROM lv l JOIN dag d ON d.module = l.module AND d.low = l.comp)
      SELECT c.module, c.node AS fn, c.comp, m.level FROM cscc c
      JOIN (SELECT module, comp, max(level) AS level FROM lv GROUP BY ALL) m USING (module, comp)
      UNION ALL SELECT module, fn, fn, 0 FROM func f WHERE NOT EXISTS (SELECT 1 FROM cscc c WHERE c.module = f.module AND c.node = f.fn)""",
)
def c1(spark, sf):
    p, r = resolved_parts(spark, sf)
    return I.call_levels(r, p.functions)


_SUMMARY_SQL = (
    OWN_SQL
    + CSCC_SQL
    + _MODELLED_SQL
    + """, rec AS MATERIALIZED (SELECT DISTINCT r.module, r.inst FROM resolved r JOIN cscc a ON a.module = r.module AND a.node = r.fn
        JOIN cscc b ON b.module = r.module AND b.node = r.target WHERE a.comp = b.comp),
      lost AS MATERIALIZED (SELECT module, inst FROM rec UNION SELECT module, inst FROM call c
        WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.module = c.module AND r.inst = c.inst)),
      fixed AS MATERIALIZED (SELECT module, inst, unnest(['return', '0']) AS out, 4 AS level, -1 AS ref FROM lost
        UNION SELECT * FROM xfact WHERE level > 1),
      flow AS MATERIALIZED (SELECT module, inst, l_partkey AS fn, 'return' AS out FROM callline WHERE l_quantity < 25
        UNION ALL SELECT module, inst, l_partkey, '0' FROM callline WHERE l_linestatus = 'F'),
      openc AS MATERIALIZED (SELECT r.module, r.inst, r.target FROM resolved r WHERE NOT EXISTS (
        SELECT 1 FROM fixed x WHERE x.module = r.module AND x.inst = r.inst)
        AND NOT EXISTS (SELECT 1 FROM ext x WHERE x.module = r.module AND x.inst = r.inst)),
      lift AS MATERIALIZED (SELECT DISTINCT o.module, o.target, w.out AS call_out, 4 AS lin, -1 AS rin, w.fn, w.out, 4 AS level, -1 AS ref
          FROM openc o JOIN flow w USING (module, inst)
        UNION SELECT DISTINCT o.module, o.target, w.out, 3, a.arg_no, w.fn, w.out, a.level, a.ref FROM openc o JOIN flow w USING (module, inst)
          JOIN callarg a USING (module, inst) WHERE a.level > 1),
      sm(module, fn, out, level, ref) AS (SELECT * FROM own
        UNION SELECT w.module, w.fn, w.out, x.level, x.ref FROM fixed x JOIN flow w USING (module, inst, out)
        UNION SELECT s.module, l.fn, l.out, l.level, l.ref FROM sm s JOIN lift l
          ON l.module = s.module AND l.target = s.fn AND l.call_out = s.out AND l.lin = s.level AND l.rin = s.ref)"""
)


def summaries(p: Parts, r: C.Resolved):
    lost = materialise(I.recursive_calls(r).union(r.unknown.select("module", "fn", "inst")), "lost_calls")
    outs = F.explode(F.array(F.lit("return"), F.lit("0")))
    top = lost.select("module", "inst", outs.alias("out"), F.lit(4).alias("level"), F.lit(-1).alias("ref"))
    ext = C.apply_models(r.external_calls(p.functions), p.call_args, p.models, p.call_args.where("arg_no < 2"))
    lines = p.call_lines
    own_fn = F.col("l_partkey").alias("fn")
    flow = lambda rows, out: rows.select("module", "inst", F.lit(out).alias("call_out"), own_fn, F.lit(out).alias("out"))
    flows = flow(lines.where("l_quantity < 25"), "return").union(flow(lines.where("l_linestatus = 'F'"), "0"))
    fixed = materialise(top.union(ext), "fixed_calls")
    return I.function_summaries(own_summaries(p), r, p.call_args, flows, fixed)


@query("c2_function_summaries", PARTS + _SUMMARY_SQL + "SELECT module, fn, out, level, ref FROM sm")
def c2(spark, sf):
    return summaries(*resolved_parts(spark, sf))


ARGS_SQL = (
    CALLBACK_SQL
    + """, formal AS MATERIALIZED (SELECT DISTINCT r.module, r.target AS fn, a.arg_no, a.level, CASE WHEN a.level = 3 THEN r.fn END AS caller, a.ref
        FROM resolved r JOIN callarg a ON a.module = r.module AND a.inst = r.inst JOIN func f ON f.module = r.module AND f.fn = r.target
        WHERE a.arg_no < f.n_args AND a.level > 1),
      da(module, fn, arg_no) AS (
        SELECT f.module, f.fn, unnest(range(f.n_args))::INTEGER FROM func f WHERE NOT EXISTS (
          SELECT 1 FROM resolved r WHERE r.module = f.module AND r.target = f.fn)
          OR EXISTS (SELECT 1 FROM cb WHERE cb.module = f.module AND cb.fn = f.fn)
        UNION SELECT module, fn, arg_no FROM formal WHERE level = 4
        UNION SELECT d.module, x.fn, x.arg_no FROM da d JOIN formal x ON x.module = d.module AND x.level = 3 AND x.caller = d.fn AND x.ref = d.arg_no)"""
)


@query("c3_finalise_arguments", PARTS + ARGS_SQL + "SELECT module, fn, arg_no FROM da")
def c3(spark, sf):
    p, r = resolved_parts(spark, sf)
    return I.finalise_arguments(p.functions, r, p.call_args, session_callbacks(p, r))


@query(
    "c4_finalise_globals",
    PARTS
    + GLOBALS_SQL
    + """SELECT s.module, s.l_partkey AS fn, s.inst, CASE WHEN s.l_quantity < 10 THEN coalesce(g.level, 1) ELSE 1 END AS level
      FROM succ s LEFT JOIN glabel g ON g.module = s.module AND g.fn = s.l_partkey AND g.global = s.l_returnflag""",
)
def c4(spark, sf):
    p, r = resolved_parts(spark, sf)
    level = F.when(F.col("l_quantity") < 10, 2).otherwise(1)
    rows = p.lines.select("module", F.col("l_partkey").alias("fn"), "inst", F.col("l_returnflag").alias("global"), level.alias("level"))
    return I.finalise_globals(rows, global_labels(p, r)).drop("global")


_HOTCALL_SQL = """, hot AS (SELECT r.module, r.target AS fn FROM resolved r JOIN callline c USING (module, inst) WHERE c.l_quantity >= 48)"""

# Functions that start dependent: called by another one in a dependent block, callbacks, and those nobody calls.
DEP_SEED_SQL = """, depseed AS (SELECT r.module, r.target AS fn FROM resolved r JOIN callline c USING (module, inst)
        WHERE c.l_quantity >= 48 AND r.target <> r.fn
      UNION SELECT module, fn FROM cb
      UNION SELECT f.module, f.fn FROM func f WHERE NOT f.is_declaration AND f.name <> 'main'
        AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.module = f.module AND r.target = f.fn))"""


def in_dep_block(p: Parts):
    return p.call_lines.where("l_quantity >= 48").select(*C.CALL)


@query(
    "c5_dependent_functions",
    PARTS
    + CALLBACK_SQL
    + DEP_SEED_SQL
    + """, d(module, fn) AS (SELECT * FROM depseed
      UNION SELECT e.module, e.dst FROM d JOIN cedge e ON e.module = d.module AND e.src = d.fn) SELECT module, fn FROM d""",
)
def c5(spark, sf):
    p, r = resolved_parts(spark, sf)
    return I.dependent_functions(r, in_dep_block(p), session_callbacks(p, r), p.functions)


@query(
    "c6_call_determinism",
    PARTS
    + _HOTCALL_SQL
    + """, d(module, fn) AS (SELECT * FROM hot UNION SELECT e.module, e.dst FROM d JOIN cedge e ON e.module = d.module AND e.src = d.fn)
      SELECT t.module, t.fn, CASE WHEN d.fn IS NULL THEN 'independent' ELSE 'dependent' END AS called
      FROM (SELECT DISTINCT module, target AS fn FROM resolved) t LEFT JOIN d USING (module, fn)
      UNION ALL SELECT module, fn, 'no call' FROM func f WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.module = f.module AND r.target = f.fn)""",
)
def c6(spark, sf):
    p, r = resolved_parts(spark, sf)
    return I.call_determinism(r, in_dep_block(p), p.functions, entry="main")
