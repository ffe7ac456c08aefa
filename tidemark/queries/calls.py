"""Queries over calls, models, aliases and elements: J*, U*, A2, A3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calls as C
from tidemark.operators import memory as M
from tidemark.queries.prelude import EVENTS, PARTS
from tidemark.queries.registry import query

from tidemark.session import materialise
from tidemark.sources.bindings import BLOCK, FN, Parts, Sessions


def resolved_parts(spark, sf):
    p = Parts(spark, sf)
    return p, C.resolve_calls(p.calls, p.functions, p.vtable_types, p.vtable_slots)


@query("j1_resolve_direct_calls", PARTS + "SELECT module, fn, inst, how, target FROM resolved WHERE how IN ('direct', 'alias')")
def j1(spark, sf):
    return C.resolve_direct_calls(Parts(spark, sf).calls).drop("grp")


@query(
    "j2_resolve_by_signature",
    PARTS
    + """SELECT c.module, c.inst, count(f.fn) AS n_targets, min(f.fn) AS first_target, max(f.fn) AS last_target
      FROM call c JOIN func f ON f.module = c.module AND f.fn_type = c.fn_type AND NOT f.is_declaration GROUP BY ALL""",
)
def j2(spark, sf):
    p = Parts(spark, sf)
    groups = C.signature_targets(p.functions).groupBy(*C.GROUP).agg(
        F.count(F.lit(1)).alias("n_targets"), F.min("target").alias("first_target"), F.max("target").alias("last_target")
    )
    asked = p.calls.where("fn_type is not null").select(*C.CALL, F.concat(F.lit("type:"), "fn_type").alias("grp"))
    return asked.join(groups, C.GROUP).drop("grp")


@query("j3_resolve_by_slot", PARTS + "SELECT module, 'slot:' || type_id || ':' || slot_offset AS grp, target FROM slottgt")
def j3(spark, sf):
    p = Parts(spark, sf)
    return C.slot_targets(p.calls, p.vtable_types, p.vtable_slots)


@query(
    "j4_resolve_calls",
    PARTS
    + """SELECT c.module, c.fn, c.inst, coalesce(min(r.how), 'unknown') AS how, count(r.target) AS n_targets
      FROM call c LEFT JOIN resolved r ON r.module = c.module AND r.inst = c.inst GROUP BY ALL""",
)
def j4(spark, sf):
    _, r = resolved_parts(spark, sf)
    sizes = r.targets.groupBy(*C.GROUP).agg(F.count(F.lit(1)).alias("n_targets"))
    known = r.calls.join(sizes, C.GROUP).drop("grp")
    return known.unionByName(r.unknown.select("*", F.lit("unknown").alias("how"), F.lit(0).cast("long").alias("n_targets")))


@query(
    "j5_unmodelled_externals",
    PARTS
    + """SELECT DISTINCT r.module, f.name FROM resolved r JOIN func f ON f.module = r.module AND f.fn = r.target
      WHERE f.is_declaration AND f.name NOT IN (SELECT name FROM model)""",
)
def j5(spark, sf):
    p, r = resolved_parts(spark, sf)
    return C.unmodelled_externals(r, p.functions, p.models)


_MODELLED_SQL = """, ext AS MATERIALIZED (SELECT r.module, r.fn, r.inst, f.name FROM resolved r
      JOIN func f ON f.module = r.module AND f.fn = r.target WHERE f.is_declaration),
    xfact AS (SELECT DISTINCT e.module, e.inst, m.target AS out, m.level, -1 AS ref FROM ext e JOIN model m USING (name) WHERE m.level <> 3
      UNION SELECT e.module, e.inst, m.target, a.level, a.ref FROM ext e JOIN model m USING (name)
        JOIN callarg a ON a.module = e.module AND a.inst = e.inst AND list_contains(m.arg_deps, a.arg_no) WHERE m.level = 3
      UNION SELECT module, inst, unnest(['return', '0', '1']), 4, -1 FROM ext WHERE name NOT IN (SELECT name FROM model))"""


@query("j6_apply_models", PARTS + _MODELLED_SQL + "SELECT module, inst, out, CAST(level AS INTEGER) AS level, ref FROM xfact")
def j6(spark, sf):
    p, r = resolved_parts(spark, sf)
    pointers = p.call_args.where("arg_no < 2")
    return C.apply_models(r.external_calls(p.functions), p.call_args, p.models, pointers)


_BOUND_SQL = """, bound AS MATERIALIZED (SELECT r.module, r.target AS fn, a.inst, a.arg_no, a.level, a.ref FROM resolved r
      JOIN callarg a ON a.module = r.module AND a.inst = r.inst JOIN func f ON f.module = r.module AND f.fn = r.target
      WHERE a.arg_no < f.n_args)"""


@query(
    "j7_bind_arguments",
    PARTS + _BOUND_SQL + "SELECT module, fn, arg_no, level, ref, count(*) AS n FROM bound GROUP BY ALL",
)
def j7(spark, sf):
    p, r = resolved_parts(spark, sf)
    return C.bind_arguments(r, p.call_args, p.functions)


@query(
    "j7_bind_globals",
    PARTS
    + """SELECT r.module, r.target AS fn, a.arg_no, CASE WHEN g.inst IS NOT NULL THEN 2 ELSE a.level END AS level,
      CASE WHEN g.inst IS NOT NULL THEN g.ref ELSE a.ref END AS ref, count(*) AS n
      FROM resolved r JOIN callarg a ON a.module = r.module AND a.inst = r.inst JOIN func f ON f.module = r.module AND f.fn = r.target
      LEFT JOIN (SELECT module, inst, 2 AS arg_no, ascii(l_returnflag) AS ref FROM callline WHERE l_quantity < 10 AND l_tax < 0.07) g
        ON g.module = a.module AND g.inst = a.inst AND g.arg_no = a.arg_no
      WHERE a.arg_no < f.n_args GROUP BY ALL""",
)
def j7_globals(spark, sf):
    """Argument 2 of small lines is a global without a label."""
    p, r = resolved_parts(spark, sf)
    small = F.expr("l_quantity < 10 and l_tax < 0.07")
    passed = p.call_lines.where(small).select("module", "inst", F.lit(2).alias("arg_no"), F.ascii("l_returnflag").alias("ref"))
    return C.bind_arguments(r, p.call_args_without(2, small), p.functions, passed)


def own_summaries(p: Parts):
    """Summaries of functions seen alone: what return and argument 0 depend on."""
    size = F.col("p_size")
    pick = lambda out, level, ref: F.struct(F.lit(out).alias("out"), F.lit(level).alias("level"), F.lit(ref).alias("ref"))
    none = F.array().cast("array<struct<out: string, level: int, ref: int>>")
    ret = (
        F.when(size >= 45, F.array(pick("return", 4, -1)))
        .when(size % 4 == 0, F.array(pick("return", 3, 0)))
        .when(size % 4 == 1, F.array(pick("return", 3, 2)))
        .when(size % 4 == 3, F.array(pick("return", 3, 1)))
        .otherwise(none)
    )
    out = F.when(size % 5 == 0, F.array(pick("0", 3, 1), pick("0", 3, 2))).otherwise(none)
    return p.functions.where(~F.col("is_declaration")).select("module", "fn", F.inline(F.concat(ret, out)))


OWN_SQL = """, own AS MATERIALIZED (SELECT module, fn, 'return' AS out, CASE WHEN p_size >= 45 THEN 4 ELSE 3 END AS level,
      CASE WHEN p_size >= 45 THEN -1 WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 2 ELSE 1 END AS ref
      FROM func WHERE NOT is_declaration AND (p_size >= 45 OR p_size % 4 <> 2)
      UNION ALL SELECT module, fn, '0', 3, unnest([1, 2]) FROM func WHERE NOT is_declaration AND p_size % 5 = 0)"""


@query(
    "j8_substitute_summary",
    PARTS
    + OWN_SQL
    + """SELECT DISTINCT r.module, r.inst, o.out, CASE WHEN o.level = 4 THEN 4 ELSE a.level END AS level,
      CASE WHEN o.level = 4 THEN -1 ELSE a.ref END AS ref
      FROM resolved r JOIN own o ON o.module = r.module AND o.fn = r.target
      LEFT JOIN callarg a ON a.module = r.module AND a.inst = r.inst AND a.arg_no = o.ref
      WHERE o.level = 4 OR a.level > 1""",
)
def j8(spark, sf):
    p, r = resolved_parts(spark, sf)
    return C.substitute_summary(own_summaries(p), r, p.call_args)


def session_aliases(s: Sessions):
    """Aliases between blocks that follow each other."""
    kind = F.element_at(F.array(F.lit("MUST"), F.lit("MAY"), F.lit("PARTIAL")), (F.col("src") + F.col("dst")) % 3 + 1)
    return s.block_edges.select(*FN, F.col("src").alias("a"), F.col("dst").alias("b"), kind.alias("kind"))


_VALUES_SQL = """, val AS (SELECT module, fn, block AS value, max(level) AS level FROM ev GROUP BY ALL),
    al AS (SELECT module, fn, src AS a, dst AS b, list_extract(['MUST', 'MAY', 'PARTIAL'], 1 + (src + dst) % 3) AS kind FROM edge)"""


@query(
    "j9_spread_to_aliases",
    EVENTS
    + _VALUES_SQL
    + """, offer AS (SELECT al.module, al.fn, al.b AS value, max(w.level) AS level, bool_or(kind = 'MUST') AS must
        FROM ev w JOIN al ON al.fn = w.fn AND al.a = w.block WHERE w.opcode IN ('purchase', 'error', 'signup')
        AND (kind <> 'PARTIAL' OR w.value < 20) GROUP BY ALL)
      SELECT v.module, v.fn, v.value, CASE WHEN o.must THEN o.level ELSE greatest(v.level, o.level) END AS level
      FROM val v LEFT JOIN offer o USING (module, fn, value)""",
)
def j9(spark, sf):
    s = Sessions(spark, sf)
    rows = s.events.select(*FN, F.col("block").alias("value"), "opcode", F.col("value").alias("v"), _level())
    values = rows.groupBy(*FN, "value").agg(F.max("level").alias("level"))
    writes = rows.where("opcode in ('purchase', 'error', 'signup')").select(
        *FN, "value", "level", (F.col("v") < 20).alias("is_element")
    )
    return M.spread_to_aliases(values, writes, session_aliases(s), FN)


def _level():
    from tidemark.sources.bindings import _seed_facts

    return _seed_facts()[0]


@query(
    "j10_element_labels",
    EVENTS
    + """, w AS (SELECT module, fn, block % 10 AS val, CASE WHEN value >= 20 THEN block % 4 END AS elem, pos, level FROM ev),
      own AS (SELECT module, fn, val, elem, max(pos) AS pos, max_by(level, pos) AS level FROM w WHERE elem IS NOT NULL GROUP BY ALL),
      el AS (SELECT o.module, o.fn, o.val, o.elem, greatest(o.level, (SELECT max(level) FROM w WHERE w.fn = o.fn AND w.val = o.val
        AND w.elem IS NULL AND w.pos > o.pos)) AS level FROM own o)
      SELECT module, fn, val AS value, elem, level FROM el
      UNION ALL SELECT module, fn, val, -1, max(level) FROM (SELECT module, fn, val, level FROM el
        UNION ALL SELECT module, fn, val, level FROM w WHERE elem IS NULL) GROUP BY ALL""",
)
def j10(spark, sf):
    rows = Sessions(spark, sf).instructions
    writes = rows.select(
        *FN,
        (F.col("block") % 10).alias("v"),
        F.when(F.col("value") >= 20, F.col("block") % 4).alias("elem"),
        F.col("pos").alias("idx"),
        "level",
    ).withColumnRenamed("v", "value")
    return M.element_labels(writes, FN)


@query(
    "j11_affected_by_args",
    EVENTS
    + """SELECT module, fn, inst, arg FROM ev e WHERE level NOT IN (1, 3) OR (level = 3 AND EXISTS (
      SELECT 1 FROM hotblk h WHERE h.fn = e.fn AND h.block % 3 = e.arg))""",
)
def j11(spark, sf):
    s = Sessions(spark, sf)
    args = s.seeds.where("level = 4").select(*FN, "node").join(
        s.events.select(*FN, F.col("inst").alias("node"), "block"), FN + ["node"]
    ).select(*FN, (F.col("block") % 3).cast("int").alias("arg_no"), F.lit(4).alias("level"))
    rows = s.events.select(*FN, "inst", _level(), F.when(F.col("opcode") == "signup", F.col("block") % 3).cast("int").alias("arg"))
    return C.affected_by_args(rows, args).select(*FN, "inst", "arg")


GLOBALS_SQL = """, cglob AS MATERIALIZED (SELECT module, inst, l_returnflag AS global,
        CASE WHEN l_discount >= 0.09 THEN 4 WHEN l_tax >= 0.07 THEN 3 ELSE 1 END AS level FROM callline),
      gmerge AS MATERIALIZED (SELECT r.module, r.target AS fn, g.global, max(g.level) AS level
        FROM resolved r JOIN cglob g ON g.module = r.module AND g.inst = r.inst GROUP BY ALL),
      gref AS MATERIALIZED (SELECT DISTINCT module, l_partkey AS fn, l_returnflag AS global FROM succ),
      glabel AS MATERIALIZED (SELECT r.module, r.fn, r.global, coalesce(m.level, CASE WHEN r.global = 'R' THEN 4 END, 1) AS level
        FROM gref r LEFT JOIN gmerge m USING (module, fn, global))"""


def call_globals(p: Parts):
    level = F.when(F.col("l_discount") >= 0.09, 4).when(F.col("l_tax") >= 0.07, 3).otherwise(1)
    return p.call_lines.select("module", "inst", F.col("l_returnflag").alias("global"), level.cast("int").alias("level"))


def referenced(p: Parts):
    return p.lines.select("module", F.col("l_partkey").alias("fn"), F.col("l_returnflag").alias("global")).distinct()


def global_labels(p: Parts, r):
    """Labels of referenced globals; only R has a dependent initialiser."""
    init = referenced(p).where("global = 'R'").select("module", "global").distinct().withColumn("level", F.lit(4))
    return C.missing_globals(referenced(p), C.merge_call_globals(r, call_globals(p)), init)


@query("a3_merge_call_globals", PARTS + GLOBALS_SQL + "SELECT * FROM gmerge")
def a3(spark, sf):
    p, r = resolved_parts(spark, sf)
    return C.merge_call_globals(r, call_globals(p))


@query("j12_missing_globals", PARTS + GLOBALS_SQL + "SELECT * FROM glabel")
def j12(spark, sf):
    return global_labels(*resolved_parts(spark, sf))


CALLBACK_SQL = """, cbuse AS MATERIALIZED (SELECT DISTINCT s.module, s.l_orderkey, s.pos FROM (SELECT *,
        CAST(split_part(inst, '-', 2) AS BIGINT) AS pos FROM succ) s JOIN resolved r ON r.module = s.module AND r.inst = s.inst
        JOIN func f ON f.module = r.module AND f.fn = r.target AND f.is_declaration
        JOIN model m ON m.name = f.name AND list_contains(m.callbacks, 1)),
      st AS MATERIALIZED (SELECT module, l_orderkey, CAST(split_part(inst, '-', 2) AS BIGINT) AS pos,
        CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS target, l_linestatus = 'F' AS must FROM succ),
      cb AS MATERIALIZED (SELECT DISTINCT s.module, s.target AS fn FROM st s JOIN cbuse u USING (module, l_orderkey)
        WHERE s.target IS NOT NULL AND u.pos > s.pos AND NOT EXISTS (SELECT 1 FROM st x WHERE x.l_orderkey = s.l_orderkey
          AND x.must AND x.pos > s.pos AND x.pos < u.pos))"""


def session_callbacks(p: Parts, r):
    """Callbacks: an order is a variable its lines store their part into, calls to rods read it."""
    takers = p.models.where(F.array_contains("callbacks", 1)).select("name").distinct()
    order = F.split("inst", "-")
    at = lambda df: df.withColumn("var", order[0].cast("long")).withColumn("idx", order[1].cast("long"))
    uses = at(r.external_calls(p.functions).join(takers, "name", "left_semi")).select("module", "var", "idx").distinct()
    stores = at(p.succession).select(
        "module", "var", "idx",
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("target"),
        F.when(F.col("l_linestatus") == "F", "MUST").otherwise("MAY").alias("kind"),
    )
    return C.callback_targets(uses, stores, ["module", "var"]).withColumnRenamed("target", "fn")


@query("j13_callback_targets", PARTS + CALLBACK_SQL + "SELECT * FROM cb")
def j13(spark, sf):
    return session_callbacks(*resolved_parts(spark, sf))


@query(
    "a2_merge_call_args",
    PARTS
    + _BOUND_SQL
    + CALLBACK_SQL
    + """SELECT b.module, b.fn, b.arg_no, max(CASE WHEN cb.fn IS NOT NULL OR b.level > 1 THEN 4 ELSE b.level END) AS level,
      count(*) AS n_sites FROM bound b LEFT JOIN cb USING (module, fn) GROUP BY ALL""",
)
def a2(spark, sf):
    p, r = resolved_parts(spark, sf)
    return C.merge_call_args(C.bind_arguments(r, p.call_args, p.functions), session_callbacks(p, r))


@query(
    "j14_load_labels",
    EVENTS
    + """, ld AS (SELECT * FROM ev WHERE opcode = 'view'),
      cand AS (
        SELECT l.inst, 0 AS rank, 3 AS level, v.arg FROM ld l JOIN ev v ON v.fn = l.fn AND v.block = l.block AND v.opcode = 'signup'
        UNION ALL SELECT l.inst, 1, o.level, NULL FROM ld l JOIN ev o ON o.inst = l.operand WHERE o.value >= 60
        UNION ALL SELECT l.inst, 2, x.level, x.arg FROM ld l JOIN edge e ON e.fn = l.fn AND e.src = l.block
          JOIN ev x ON x.fn = e.fn AND x.block = e.dst WHERE x.level > 1
        UNION ALL SELECT l.inst, 3, 3, l.block % 5 FROM ld l WHERE l.block % 5 < 2
        UNION ALL SELECT l.inst, 4, 4, NULL FROM ld l WHERE l.block % 5 = 2
        UNION ALL SELECT l.inst, 5, 1, NULL FROM ld l WHERE l.block % 5 = 3),
      m AS (SELECT inst, rank, max(level) AS level, CASE WHEN max(level) = 3 THEN
        array_to_string(list_sort(list(DISTINCT arg) FILTER (arg IS NOT NULL AND level = 3)), ',') ELSE '' END AS args FROM cand GROUP BY ALL),
      b AS (SELECT inst, min_by(level, rank) AS level, min_by(args, rank) AS args, min(rank) AS source FROM m GROUP BY ALL)
      SELECT l.module, l.fn, l.inst AS node, coalesce(b.level, 2) AS level, coalesce(b.args, '') AS args,
      coalesce(b.source, -1) AS source FROM ld l LEFT JOIN b USING (inst)""",
)
def j14(spark, sf):
    s = Sessions(spark, sf)
    rows = s.instructions
    loads = rows.where("opcode = 'view'").select(*FN, F.col("inst").alias("node"), "block", "operand")
    fact = lambda level, ref: [F.lit(level).cast("int").alias("level") if isinstance(level, int) else level, ref.cast("int").alias("ref")]
    cell = rows.select(*BLOCK, "level", F.coalesce("arg", F.lit(-1)).alias("ref"), "opcode")
    pointer = loads.join(cell.where("opcode = 'signup'"), BLOCK)
    producer = rows.where("value >= 60").select(*FN, F.col("inst").alias("operand"), "level", F.lit(-1).alias("ref"))
    refs = loads.join(s.block_edges.select(*FN, F.col("src").alias("block"), "dst"), BLOCK).join(
        cell.where("level > 1").withColumnRenamed("block", "dst"), FN + ["dst"]
    )
    root = F.col("block") % 5
    none = F.lit(-1)
    return M.load_labels(
        loads.select(*FN, "node"),
        [
            pointer,
            loads.join(producer, FN + ["operand"]),
            refs,
            loads.where(root < 2).select(*FN, "node", *fact(3, root)),
            loads.where(root == 2).select(*FN, "node", *fact(4, none)),
            loads.where(root == 3).select(*FN, "node", *fact(1, none)),
        ],
        FN,
    )


@query(
    "j15_argument_operands",
    EVENTS
    + """SELECT module, fn, inst AS node, arg FROM ev WHERE arg IS NOT NULL
      UNION SELECT e.module, e.fn, e.inst, x.dst % 3 FROM ev e JOIN edge x ON x.fn = e.fn AND x.src = e.block WHERE e.arg IS NULL""",
)
def j15(spark, sf):
    s = Sessions(spark, sf)
    ops = s.events.select(
        *FN, F.col("inst").alias("node"), F.col("block").alias("ref"),
        F.when(F.col("opcode") == "signup", F.col("block") % 3).cast("int").alias("arg"),
    )
    may = s.block_edges.select(*FN, F.col("src").alias("ref"), (F.col("dst") % 3).cast("int").alias("arg")).distinct()
    return M.argument_operands(ops, may, FN)


@query("u1_union_targets", PARTS + "SELECT DISTINCT module, target FROM resolved")
def u1(spark, sf):
    _, r = resolved_parts(spark, sf)
    return C.called_functions(r)


@query(
    "u2_deterministic_only",
    PARTS
    + """SELECT module, target FROM resolved r JOIN callline c USING (module, inst) WHERE l_quantity < 48
      EXCEPT SELECT module, target FROM resolved r JOIN callline c USING (module, inst) WHERE l_quantity >= 48""",
)
def u2(spark, sf):
    p, r = resolved_parts(spark, sf)
    place = p.call_lines.select(*C.CALL, (F.col("l_quantity") >= 48).alias("in_dep"))
    return C.deterministic_only(r, place)


@query(
    "u4_label_set_difference",
    EVENTS
    + """, f AS (SELECT DISTINCT module, fn, block AS node, opcode AS val FROM ev),
      r AS (SELECT DISTINCT module, fn, opcode AS val FROM ev WHERE value >= 100)
      SELECT f.module, f.fn, f.node, CASE WHEN count(*) FILTER (r.val IS NULL) > 0 THEN 2 ELSE 1 END AS level,
      count(*) FILTER (r.val IS NULL) AS n_values FROM f LEFT JOIN r USING (module, fn, val) GROUP BY ALL""",
)
def u4(spark, sf):
    e = Sessions(spark, sf).events
    facts = e.select(*FN, F.col("block").alias("node"), F.col("opcode").alias("value")).distinct()
    return M.label_set_difference(facts, e.where("value >= 100").select(*FN, F.col("opcode").alias("value")), FN)
