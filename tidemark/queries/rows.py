"""Queries over rows and labels: F*, A*, W*, S*, U*."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import coverage, report, runs
from tidemark.queries.prelude import EVENTS, PARTS
from tidemark.queries.registry import query
from tidemark.session import materialise, new_table_path
from tidemark.sources import facts, label_store, models
from tidemark.sources.bindings import BLOCK, FN, Parts, Sessions, table


# ---- sources and reports ---------------------------------------------------------------------


@query(
    "s1_load_facts",
    EVENTS
    + """SELECT module, count(*) AS n_rows, count(DISTINCT fn) AS n_functions, sum(inst)::BIGINT AS sum_inst,
      count(operand) AS n_operands FROM ev GROUP BY module""",
)
def s1(spark, sf):
    s, path = Sessions(spark, sf), new_table_path(spark, "facts")
    facts.write_facts({"instructions": s.instructions, "operands": s.operands}, path)
    t = facts.load_facts(spark, path, ["instructions", "operands"])
    rows = t["instructions"].groupBy("module").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("fn").alias("n_functions"),
        F.sum("inst").alias("sum_inst"),
    )
    ops = t["operands"].groupBy("module").agg(F.count(F.lit(1)).alias("n_operands"))
    return rows.join(ops, "module")


_ALL_FACTS_SQL = """, n AS (
      SELECT 'functions' AS name, module, count(*) AS n FROM func GROUP BY ALL
      UNION ALL SELECT 'args', module, sum(n_args) FROM func GROUP BY ALL
      UNION ALL SELECT 'calls', module, count(*) FROM call GROUP BY ALL
      UNION ALL SELECT 'call_args', module, count(*) FROM callarg GROUP BY ALL
      UNION ALL SELECT 'models', d.module, count(*) FROM (SELECT DISTINCT module, name FROM func WHERE is_declaration) d JOIN model ON model.name = d.name GROUP BY ALL
      UNION ALL SELECT 'vtable_types', module, count(*) FROM vtype GROUP BY ALL
      UNION ALL SELECT 'vtable_slots', module, count(*) FROM vslot GROUP BY ALL),
    ev0 AS (SELECT CAST(user_id % 10 AS INTEGER) AS module, user_id AS fn, CAST(json_extract_string(props, '$.k') AS INTEGER) AS block,
      event_id AS inst, event_type AS opcode, ts FROM events),
    sess AS (SELECT *, lead(block) OVER (PARTITION BY fn ORDER BY ts) AS next_block, lag(inst) OVER (PARTITION BY fn, opcode ORDER BY ts) AS operand FROM ev0),
    m AS (
      SELECT 'blocks' AS name, module, count(DISTINCT (fn, block)) AS n FROM sess GROUP BY module
      UNION ALL SELECT 'block_edges', module, count(DISTINCT (fn, block, next_block)) FROM sess WHERE next_block <> block GROUP BY module
      UNION ALL SELECT 'instructions', module, count(*) FROM sess GROUP BY module
      UNION ALL SELECT 'operands', module, count(operand) FROM sess GROUP BY module
      UNION ALL SELECT 'aliases', module, count(DISTINCT (fn, block, next_block)) FROM sess WHERE next_block <> block GROUP BY module)
    SELECT name, CAST(module AS INTEGER) AS module, CAST(n AS BIGINT) AS n_rows FROM (SELECT * FROM n UNION ALL SELECT * FROM m) WHERE n > 0"""


@query("s1_all_facts", PARTS + _ALL_FACTS_SQL)
def s1_all(spark, sf):
    """All twelve tables written and read back; rows of each by module."""
    s, p, path = Sessions(spark, sf, keep=True), Parts(spark, sf), new_table_path(spark, "facts")
    flags = {"is_intrinsic": F.lit(False), "returns_void": F.lit(False), "no_return": F.lit(False)}
    fns = p.functions.withColumns({k: v for k, v in flags.items() if k not in p.functions.columns})
    args = fns.select(*FN, F.explode(F.expr("sequence(0, n_args - 1)")).alias("arg_no")).withColumn("is_pointer", F.col("arg_no") == 0)
    edges = materialise(s.block_edges, "block_edges")
    pairs = edges.select(*FN, F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.lit("MAY").alias("kind"))
    names = p.functions.where("is_declaration").select("module", "name").distinct()  # models belong to modules that declare the function
    tables = {
        "functions": fns, "args": args, "blocks": s.blocks, "block_edges": edges, "instructions": s.instructions, "operands": s.operands,
        "calls": p.calls, "call_args": p.call_args, "aliases": pairs, "models": names.join(p.models, "name"), "vtable_types": p.vtable_types, "vtable_slots": p.vtable_slots,
    }
    facts.write_facts(tables, path)
    out = None
    for name, t in facts.load_facts(spark, path).items():
        part = t.groupBy("module").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "module", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s2_load_models",
    PARTS
    + """SELECT name, target, level, array_to_string(arg_deps, ',') AS arg_deps,
      array_to_string(callbacks, ',') AS callbacks FROM model""",
)
def s2(spark, sf):
    path = new_table_path(spark, "models")
    models.write_models(Parts(spark, sf).models, path)
    m = models.load_models(spark, path, multi_line=False)
    return m.select("name", "target", "level", L.csv(F.col("arg_deps")).alias("arg_deps"),
                    L.csv(F.col("callbacks")).alias("callbacks"))


# All names in alphabetical order, as the session key picks them.
MODEL_NAMES = sorted({*models.C_RETURNS, *models.STRING_METHODS, *models.INTRINSICS})

# Name, target, and what it is merged from.
_MODEL_SQL = """
 libm(name, target, ret) AS (VALUES
   ('printf', 'return', 'dep'),
   ('remove', 'return', 'dep'),
   ('rename', 'return', 'dep'),
   ('fflush', 'return', 'dep'),
   ('fopen', 'return', 'dep'),
   ('freopen', 'return', 'dep'),
   ('fputc', 'return', 'dep'),
   ('snprintf', 'return', 'dep'),
   ('sscanf', 'return', 'dep'),
   ('puts', 'return', 'dep'),
   ('getenv', 'return', 'dep'),
   ('system', 'return', 'dep'),
   ('fprintf', 'return', 'dep'),
   ('fseek', 'return', 'dep'),
   ('ftell', 'return', 'dep'),
   ('fread', 'return', 'dep'),
   ('fclose', 'return', 'dep'),
   ('malloc', 'return', 'indep'),
   ('calloc', 'return', 'indep'),
   ('memcpy', 'return', 'indep'),
   ('exit', 'return', 'indep'),
   ('free', 'return', 'indep'),
   ('qsort', 'return', 'indep'),
   ('rewind', 'return', 'indep'),
   ('memset', 'return', 'indep'),
   ('declare', 'return', 'indep'),
   ('atof', 'return', '0'),
   ('atoi', 'return', '0'),
   ('atol', 'return', '0'),
   ('atoll', 'return', '0'),
   ('abs', 'return', '0'),
   ('labs', 'return', '0'),
   ('strlen', 'return', '0'),
   ('log', 'return', '0'),
   ('operator new', 'return', '0'),
   ('realloc', 'return', '0,1'),
   ('strcmp', 'return', '0,1'),
   ('strcpy', 'return', '1'),
   ('strcat', 'return', '1'),
   ('fwrite', 'return', '1,2'),
   ('freopen', '2', '0,1'),
   ('snprintf', '0', '1,2'),
   ('memcpy', '0', '1,2'),
   ('realloc', '0', '0,1'),
   ('fprintf', '0', '0,1'),
   ('qsort', '0', '0,1'),
   ('strcpy', '0', '1'),
   ('strcat', '0', '1'),
   ('fseek', '0', '0,1,2'),
   ('ftell', '0', '0'),
   ('rewind', '0', '0'),
   ('fread', '0', '1,2,3'),
   ('fread', '3', '2,3'),
   ('fclose', '0', 'indep'),
   ('memset', '0', '1,2'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::basic_string(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::basic_string(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&)', '0', '1'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::basic_string(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&, unsigned long, unsigned long, std::__1::allocator<char> const&)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::basic_string(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&, unsigned long, unsigned long, std::__1::allocator<char> const&)', '0', '1,2,3'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::~basic_string()', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::operator=(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::operator=(std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> > const&)', '0', '1'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::operator=(char)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::operator=(char)', '0', '1'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::assign(char const*)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::assign(char const*)', '0', '1'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::reserve(unsigned long)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::reserve(unsigned long)', '0', '1'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::resize(unsigned long, char)', 'return', 'indep'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::resize(unsigned long, char)', '0', '1,2'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::size() const', 'return', '0'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::length() const', 'return', '0'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::max_size() const', 'return', '0'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::capacity() const', 'return', '0'),
   ('std::__1::basic_string<char, std::__1::char_traits<char>, std::__1::allocator<char> >::empty() const', 'return', '0'),
   ('std::__1::__basic_string_common<true>::__throw_length_error() const', 'return', 'indep'),
   ('std::__1::char_traits<char>::length(char const*)', 'return', '0'),
   ('std::__1::char_traits<char>::copy(char*, char const*, unsigned long)', 'return', '1,2'),
   ('std::__1::char_traits<char>::copy(char*, char const*, unsigned long)', '0', '1,2'),
   ('std::__1::char_traits<char>::assign(char&, char const&)', 'return', 'indep'),
   ('std::__1::char_traits<char>::assign(char&, char const&)', '0', '1'),
   ('std::__1::char_traits<char>::assign(char*, unsigned long, char)', 'return', 'indep'),
   ('std::__1::char_traits<char>::assign(char*, unsigned long, char)', '0', '1,2')),
 picked AS (SELECT list_extract((SELECT list_sort(list(DISTINCT name)) FROM libm), 1 + (block + fn) % 58) AS name FROM ev)
"""


@query(
    "s3_builtin_models",
    EVENTS
    + ","
    + _MODEL_SQL
    + """SELECT m.name, m.target, CASE ret WHEN 'dep' THEN 4 WHEN 'indep' THEN 1 ELSE 3 END AS level,
      CASE WHEN ret IN ('dep', 'indep') THEN '' ELSE ret END AS arg_deps, count(*) AS n_calls
      FROM picked p JOIN libm m ON m.name = p.name GROUP BY ALL""",
)
def s3(spark, sf):
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    picked = ((F.col("block") + F.col("fn")) % len(MODEL_NAMES) + 1).cast("int")
    called = Sessions(spark, sf).events.select(F.element_at(names, picked).alias("name"))
    per_name = called.groupBy("name").agg(F.count(F.lit(1)).alias("n_calls"))
    return per_name.join(models.builtin_models(spark), "name").select(
        "name", "target", "level", L.csv(F.col("arg_deps")).alias("arg_deps"), "n_calls"
    )


@query(
    "s4_label_store",
    EVENTS
    + """SELECT e.module, e.fn, e.block, e.inst,
      CASE WHEN NOT EXISTS (SELECT 1 FROM reach r WHERE r.fn = e.fn AND r.block = e.block) THEN 'unreachable'
           WHEN EXISTS (SELECT 1 FROM hotblk h WHERE h.fn = e.fn AND h.block = e.block) THEN 'dep'
           WHEN level = 1 THEN 'indep' WHEN level = 4 THEN 'dep' ELSE 'unknown' END AS tag
      FROM ev e""",
)
def s4(spark, sf):
    s, path = Sessions(spark, sf), new_table_path(spark, "labels")
    label_store.write_labels(s.functions, session_status(s), s.labels, path)
    return label_store.read_labels(spark, path, s.instructions)


@query(
    "s5_report_long",
    EVENTS
    + """, m AS (SELECT module, fn, count(*) FILTER (level = 4) AS n_dep, count(*) FILTER (level = 1) AS n_indep,
      count(*) AS n_rows FROM ev GROUP BY ALL)
      SELECT 'labels' AS section, module || '.' || fn AS owner, 'rows' AS kind, name, CAST(value AS DOUBLE) AS value
      FROM (UNPIVOT m ON n_dep, n_indep, n_rows INTO NAME name VALUE value)""",
)
def s5(spark, sf):
    counts = coverage.label_counts(Sessions(spark, sf).events.select(*FN, *_seed_level()), FN)
    return report.report_long(counts, "labels", FN, ["n_dep", "n_indep", "n_rows"], "rows")


@query(
    "s5_report_json",
    EVENTS
    + """SELECT 'labels' AS section, module || '.' || fn AS owner,
      '{"labels":{"' || module || '.' || fn || '":{"rows":{"n_dep":' || count(*) FILTER (level = 4) ||
      '.0,"n_indep":' || count(*) FILTER (level = 1) || '.0,"n_rows":' || count(*) || '.0}}}}' AS doc
      FROM ev GROUP BY module, fn""",
)
def s5_json(spark, sf):
    return report.report_json(s5(spark, sf))


@query("s6_label_locations", EVENTS + "SELECT module, fn, inst, line FROM ev WHERE level = 4 AND line IS NOT NULL")
def s6(spark, sf):
    return report.label_locations(Sessions(spark, sf).instructions)


@query(
    "s6_missing_locations",
    EVENTS
    + """SELECT module, count(*) AS n_dep, count(*) FILTER (line IS NULL) AS n_unlocated
      FROM ev WHERE level = 4 GROUP BY module""",
)
def s6_missing(spark, sf):
    return report.missing_locations(Sessions(spark, sf).instructions)


@query(
    "s7_seed_records",
    PARTS
    + """SELECT DISTINCT module, fn, inst, cause FROM (
      SELECT c.module, c.fn, c.inst, 'unknown target' AS cause FROM call c
      WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.module = c.module AND r.inst = c.inst)
      UNION ALL SELECT r.module, r.fn, r.inst, 'unmodelled external' FROM resolved r
      JOIN func f ON f.module = r.module AND f.fn = r.target AND f.is_declaration
      WHERE f.name NOT IN (SELECT name FROM model))""",
)
def s7(spark, sf):
    from tidemark.queries.calls import resolved_parts

    p, r = resolved_parts(spark, sf)
    return report.seed_records(
        (r.unknown, "unknown target"), (r.unmodelled_calls(p.functions, p.models), "unmodelled external")
    )


# ---- scalar functions ------------------------------------------------------------------------


def _seed_level():
    from tidemark.sources.bindings import _seed_facts

    return _seed_facts()


@query(
    "f1_external_functions",
    PARTS + "SELECT module, fn, name FROM func WHERE is_declaration OR module <> (fn % 25) * 10 + 1 + fn % 5",
)
def f1(spark, sf):
    owner = ((F.col("fn") % 25) * 10 + 1 + F.col("fn") % 5).cast("int")
    fns = Parts(spark, sf).functions
    return fns.where(L.is_external(owner, F.col("module"), F.col("is_declaration"))).select("module", "fn", "name")


@query(
    "f2_model_name",
    EVENTS
    + """, n AS (SELECT inst, CASE opcode WHEN 'click' THEN 'llvm.memcpy.p' || block WHEN 'view' THEN 'llvm.memset.i' || block
      WHEN 'purchase' THEN 'llvm.dbg.declare' ELSE 'llvm.' || opcode END AS name,
      CASE WHEN opcode = 'signup' THEN 'sign::up(' || block || ')' END AS demangled, block % 7 > 0 AS is_intrinsic FROM ev)
      SELECT inst, CASE WHEN NOT is_intrinsic THEN coalesce(demangled, name)
        WHEN coalesce(demangled, name) LIKE '%memcpy%' THEN 'memcpy' WHEN coalesce(demangled, name) LIKE '%memset%' THEN 'memset'
        WHEN coalesce(demangled, name) LIKE '%declare%' THEN 'declare' ELSE coalesce(demangled, name) END AS model_name FROM n""",
)
def f2(spark, sf):
    op, block = F.col("opcode"), F.col("block").cast("string")
    name = (
        F.when(op == "click", F.concat(F.lit("llvm.memcpy.p"), block))
        .when(op == "view", F.concat(F.lit("llvm.memset.i"), block))
        .when(op == "purchase", F.lit("llvm.dbg.declare"))
        .otherwise(F.concat(F.lit("llvm."), op))
    )
    demangled = F.when(op == "signup", F.concat(F.lit("sign::up("), block, F.lit(")")))
    return Sessions(spark, sf).events.select(
        "inst", L.model_name(name, demangled, F.col("block") % 7 > 0).alias("model_name")
    )


@query(
    "f3_level_predicates",
    EVENTS
    + """SELECT inst, level > 0 AS is_defined, level = 1 AS is_indep, level = 3 AS is_arg_dep, level = 4 AS is_dep,
      opcode = 'view' OR opcode = 'click' AS is_value_dep, opcode = 'view' AS only_globals FROM ev""",
)
def f3(spark, sf):
    level, _ = _seed_level()
    rows = Sessions(spark, sf).events.select("inst", "opcode", level)
    values = (
        F.when(F.col("opcode") == "view", F.array(F.lit("@g"), F.lit("@h")))
        .when(F.col("opcode") == "click", F.array(F.lit("@g"), F.lit("local")))
        .otherwise(F.array().cast("array<string>"))
    )
    lv = F.col("level")
    return rows.select(
        "inst",
        L.is_defined(lv).alias("is_defined"),
        L.is_indep(lv).alias("is_indep"),
        L.is_arg_dep(lv).alias("is_arg_dep"),
        L.is_dep(lv).alias("is_dep"),
        L.is_value_dep(lv, values).alias("is_value_dep"),
        L.is_only_global_value_dep(values, lambda v: v.startswith("@")).alias("only_globals"),
    )


@query(
    "f4_level_name",
    EVENTS
    + """SELECT CASE level WHEN 4 THEN 'input dependent' WHEN 3 THEN 'argument dependent' ELSE 'input independent' END
      AS level_name, count(*) AS n FROM ev GROUP BY 1""",
)
def f4(spark, sf):
    rows = Sessions(spark, sf).events.select(_seed_level()[0])
    return rows.groupBy(L.level_name(F.col("level")).alias("level_name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f5_mask_string",
    PARTS
    + """SELECT inst, string_agg(CASE WHEN level > 1 THEN '1' ELSE '0' END, '' ORDER BY arg_no) AS mask
      FROM callarg GROUP BY inst""",
)
def f5(spark, sf):
    bit = lambda no: F.max(F.when((F.col("arg_no") == no) & (F.col("level") > 1), 1).otherwise(0))
    return Parts(spark, sf).call_args.groupBy("inst").agg(
        L.mask_string(F.array(bit(0), bit(1), bit(2))).alias("mask")
    )


@query(
    "f6_percent_floor",
    EVENTS
    + """SELECT module, fn, CAST(floor(100 * count(*) FILTER (level > 1) / count(*)) AS BIGINT) AS percent
      FROM ev GROUP BY ALL""",
)
def f6(spark, sf):
    rows = Sessions(spark, sf).events.select(*FN, _seed_level()[0])
    return rows.groupBy(*FN).agg(
        L.percent_floor(F.count_if(F.col("level") > 1), F.count(F.lit(1))).alias("percent")
    )


_ELIGIBLE = ["purchase", "view"]


def _checksum_rows(spark, sf):
    bits = F.when(F.col("block") % 4 == 3, 8).when(F.col("block") % 4 == 2, 32).otherwise(64)
    rows = Sessions(spark, sf).events.select(*FN, "inst", "opcode", "block", _seed_level()[0])
    return rows.where(L.checksum_eligible(F.col("level"), F.col("opcode"), bits, _ELIGIBLE))


_ELIGIBLE_SQL = "level < 4 AND opcode IN ('purchase', 'view') AND block % 4 <> 3"


@query("f7_checksum_rows", EVENTS + f"SELECT module, fn, inst FROM ev WHERE {_ELIGIBLE_SQL}")
def f7(spark, sf):
    return _checksum_rows(spark, sf).select(*FN, "inst")


@query(
    "f9_module_stem",
    "SELECT split_part(url, '.', 1) AS stem, count(*) AS n FROM pages GROUP BY 1",
)
def f9(spark, sf):
    pages = table(spark, sf, "pages").select(L.module_stem(F.col("url")).alias("stem"))
    return pages.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


_RULE_SQL = """, r AS (SELECT inst, CASE opcode WHEN 'click' THEN 'br' WHEN 'view' THEN 'store' WHEN 'purchase' THEN 'gep'
      WHEN 'signup' THEN 'ret' ELSE 'alloca' END AS op,
      list_extract(['const', 'function', 'arg', 'labelled', 'none'], 1 + block % 5) AS kind,
      value >= 20 AS cond FROM ev)
      SELECT inst, CAST(CASE op WHEN 'alloca' THEN 4
        WHEN 'br' THEN CASE WHEN NOT cond OR kind = 'const' THEN 1 END
        WHEN 'ret' THEN CASE WHEN kind IN ('const', 'function', 'none') THEN 1 END
        WHEN 'store' THEN CASE kind WHEN 'const' THEN 1 WHEN 'function' THEN 1 WHEN 'arg' THEN 3 WHEN 'none' THEN 4 END
        WHEN 'gep' THEN CASE WHEN kind = 'none' THEN 4 END END AS INTEGER) AS rule_level FROM r"""


@query("f10_row_rules", EVENTS + _RULE_SQL)
def f10(spark, sf):
    names = F.create_map(*[F.lit(x) for x in (
        "click", "br", "view", "store", "purchase", "gep", "signup", "ret", "error", "alloca")])
    kinds = F.array(*[F.lit(x) for x in ("const", "function", "arg", "labelled", "none")])
    rows = Sessions(spark, sf).events
    return rows.select(
        "inst",
        L.row_rule(
            F.element_at(names, F.col("opcode")), F.element_at(kinds, F.col("block") % 5 + 1), F.col("value") >= 20
        ).cast("int").alias("rule_level"),
    )


# ---- coverage --------------------------------------------------------------------------------


def session_status(s: Sessions):
    """Block status with blocks cut off by failing ones."""
    from tidemark.operators.graph import unreachable_blocks

    rows = s.events.select(*BLOCK, _seed_level()[0])
    return coverage.block_status(rows, s.blocks, unreachable_blocks(s.blocks, s.live_edges))


_STATUS_SQL = """, st AS MATERIALIZED (SELECT b.module, b.fn, b.block, b.n_rows,
      (SELECT count(*) FROM ev e WHERE e.fn = b.fn AND e.block = b.block AND e.level = 1) AS n_indep_rows,
      CASE WHEN r.block IS NULL THEN 'unreachable' WHEN h.block IS NOT NULL THEN 'dep' ELSE 'indep' END AS status, f.is_dep_fn
      FROM blk b JOIN fns f USING (module, fn) LEFT JOIN reach r USING (module, fn, block)
      LEFT JOIN hotblk h USING (module, fn, block)),
    cov AS (SELECT module, fn, count(*) AS n_blocks, count(*) FILTER (NOT is_dep_fn AND status = 'indep') AS n_indep_blocks,
      count(*) FILTER (status = 'unreachable') AS n_dead_blocks, sum(n_rows)::BIGINT AS n_rows,
      sum(CASE WHEN NOT is_dep_fn AND status <> 'unreachable' THEN n_indep_rows ELSE 0 END)::BIGINT AS n_indep_rows,
      sum(CASE WHEN status = 'unreachable' THEN n_rows ELSE 0 END)::BIGINT AS n_dead_rows FROM st GROUP BY ALL)"""
_SHARES_SQL = """round(100.0::DOUBLE * n_indep_blocks / nullif(n_blocks - n_dead_blocks, 0), 4) AS block_share,
      round(100.0::DOUBLE * n_indep_rows / nullif(n_rows - n_dead_rows, 0), 4) AS row_share"""


@query(
    "a1_merge_labels",
    EVENTS
    + """SELECT module, fn, max(level) AS level,
      coalesce(array_to_string(list_sort(list(DISTINCT arg) FILTER (arg IS NOT NULL)), ','), '') AS args
      FROM ev WHERE level > 1 GROUP BY ALL""",
)
def a1(spark, sf):
    return coverage.merge_labels(Sessions(spark, sf).seeds, FN)


@query(
    "a4_label_counts",
    EVENTS
    + """SELECT module, fn, count(*) FILTER (level = 4) AS n_dep, count(*) FILTER (level = 1) AS n_indep,
      count(*) FILTER (level NOT IN (1, 4)) AS n_unknown, count(*) AS n_rows,
      CAST(floor(100 * count(*) FILTER (level = 4) / count(*)) AS BIGINT) AS percent FROM ev GROUP BY ALL""",
)
def a4(spark, sf):
    return coverage.label_counts(Sessions(spark, sf).events.select(*FN, _seed_level()[0]), FN)


@query("a5_indep_coverage", EVENTS + _STATUS_SQL + f"SELECT *, {_SHARES_SQL} FROM cov")
def a5(spark, sf):
    s = Sessions(spark, sf)
    return coverage.indep_coverage(session_status(s), s.functions)


@query(
    "a6_dep_coverage",
    EVENTS
    + _STATUS_SQL
    + """, d AS (SELECT module, fn, count(*) AS n_blocks, count(*) FILTER (is_dep_fn) AS n_dep_blocks,
      count(*) FILTER (status = 'unreachable') AS n_dead_blocks, sum(n_rows)::BIGINT AS n_rows,
      sum(CASE WHEN is_dep_fn THEN n_rows ELSE 0 END)::BIGINT AS n_dep_rows,
      sum(CASE WHEN status = 'unreachable' THEN n_rows ELSE 0 END)::BIGINT AS n_dead_rows FROM st GROUP BY ALL)
      SELECT *, round(100.0::DOUBLE * n_dep_blocks / nullif(n_blocks - n_dead_blocks, 0), 4) AS block_share,
      round(100.0::DOUBLE * n_dep_rows / nullif(n_rows - n_dead_rows, 0), 4) AS row_share FROM d""",
)
def a6(spark, sf):
    s = Sessions(spark, sf)
    return coverage.dep_coverage(session_status(s), s.functions)


@query(
    "a7_module_totals",
    EVENTS
    + _STATUS_SQL
    + f""", t AS (SELECT module, sum(n_blocks)::BIGINT AS n_blocks, sum(n_indep_blocks)::BIGINT AS n_indep_blocks,
      sum(n_dead_blocks)::BIGINT AS n_dead_blocks, sum(n_rows)::BIGINT AS n_rows, sum(n_indep_rows)::BIGINT AS n_indep_rows,
      sum(n_dead_rows)::BIGINT AS n_dead_rows, CAST(grouping(module) AS INTEGER) AS is_total FROM cov GROUP BY ROLLUP (module))
      SELECT *, {_SHARES_SQL} FROM t""",
)
def a7(spark, sf):
    return coverage.module_totals(a5(spark, sf))


@query(
    "a8_module_summary",
    EVENTS
    + """SELECT module, count(*) AS n_rows, count(*) FILTER (level = 1) AS n_indep,
      (SELECT count(*) FROM fns f WHERE f.module = ev.module AND (is_dep_fn OR is_extracted)) AS n_dep_fns
      FROM ev GROUP BY module""",
)
def a8(spark, sf):
    s = Sessions(spark, sf)
    return coverage.module_summary(s.events.select("module", _seed_level()[0]), s.functions)


@query("a8_dependent_function_list", EVENTS + "SELECT module, fn FROM fns WHERE is_dep_fn OR is_extracted")
def a8_list(spark, sf):
    return coverage.dependent_function_list(Sessions(spark, sf).functions)


@query(
    "a10_unreachable_counts",
    EVENTS
    + """SELECT module, fn, count(*) AS n_dead_blocks, sum(n_rows)::BIGINT AS n_dead_rows
      FROM blk b WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.fn = b.fn AND r.block = b.block) GROUP BY ALL""",
)
def a10(spark, sf):
    from tidemark.operators.graph import unreachable_blocks

    s = Sessions(spark, sf)
    return coverage.unreachable_counts(s.events, unreachable_blocks(s.blocks, s.live_edges))


@query(
    "a11_callers_of",
    PARTS
    + """SELECT module, dst AS fn, src AS caller, count(*) OVER (PARTITION BY module, dst) AS n_callers FROM pedge""",
)
def a11(spark, sf):
    return coverage.callers_of(Parts(spark, sf).edges)


# ---- ordered rows ----------------------------------------------------------------------------


@query("w1_row_index", EVENTS + "SELECT module, fn, block, inst, idx AS row_index FROM ev")
def w1(spark, sf):
    rows = Sessions(spark, sf).events.select(*BLOCK, "inst", "ts")
    return runs.row_index(rows, BLOCK, ["ts"]).drop("ts")


def session_runs(s: Sessions):
    """Dependent runs over a whole session; purchases are transparent."""
    rows = s.instructions.select(*FN, "pos", "level", "opcode")
    return runs.dependent_runs(rows, FN, "pos", F.col("level") >= L.ARG, F.col("opcode") == "purchase")


RUNS_SQL = """, isl AS (SELECT *, sum(CASE WHEN level >= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY fn ORDER BY pos) AS island
      FROM ev WHERE opcode <> 'purchase'),
    runs AS (SELECT module, fn, min(pos) AS begin_idx, max(pos) AS end_idx, count(*) AS n_dep_rows
      FROM isl WHERE level >= 3 GROUP BY module, fn, island)"""


@query("w2_dependent_runs", EVENTS + RUNS_SQL + "SELECT * FROM runs")
def w2(spark, sf):
    return session_runs(Sessions(spark, sf))


@query("f8_drop_single_row_runs", EVENTS + RUNS_SQL + "SELECT *, end_idx - begin_idx + 1 AS size FROM runs WHERE begin_idx < end_idx")
def f8(spark, sf):
    return runs.drop_single_row_runs(session_runs(Sessions(spark, sf))).withColumn("size", runs.run_size())


def session_uses(s: Sessions):
    """(producer, consumer) positions inside a session."""
    rows = s.instructions
    made = rows.select(*FN, F.col("inst").alias("operand"), F.col("pos").alias("producer"))
    read = rows.where("operand is not null").select(*FN, "operand", F.col("pos").alias("consumer"))
    return read.join(made, FN + ["operand"]).select(*FN, "producer", "consumer")


WIDEN_SQL = (
    RUNS_SQL
    + """, uses AS MATERIALIZED (SELECT c.module, c.fn, p.pos AS producer, min(c.pos) AS first_use
      FROM ev c JOIN ev p ON p.fn = c.fn AND p.inst = c.operand GROUP BY ALL),
    wide(module, fn, b, e, begin_idx) AS (SELECT module, fn, begin_idx, end_idx, begin_idx FROM runs
      UNION SELECT w.module, w.fn, w.b, w.e, w.begin_idx - 1 FROM wide w JOIN uses u
        ON u.fn = w.fn AND u.producer = w.begin_idx - 1 AND u.first_use <= w.e),
    widened AS (SELECT module, fn, e AS end_idx, min(begin_idx) AS begin_idx FROM wide GROUP BY module, fn, b, e)"""
)


@query("w3_widen_runs", EVENTS + WIDEN_SQL + "SELECT module, fn, begin_idx, end_idx FROM widened")
def w3(spark, sf):
    s = Sessions(spark, sf)
    return runs.widen_runs(session_runs(s), session_uses(s), FN)


@query(
    "w4_merge_runs",
    EVENTS
    + WIDEN_SQL
    + """, cut AS (SELECT w.module, w.fn, begin_idx,
        end_idx - CASE WHEN EXISTS (SELECT 1 FROM ev e WHERE e.fn = w.fn AND e.pos = w.end_idx AND is_terminator
          AND opcode = 'signup') THEN 1 ELSE 0 END AS end_idx FROM widened w),
      o AS (SELECT *, max(end_idx) OVER (PARTITION BY fn ORDER BY begin_idx, end_idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach_ FROM cut WHERE begin_idx <= end_idx),
      g AS (SELECT *, sum(CASE WHEN begin_idx <= reach_ + 1 THEN 0 ELSE 1 END)
          OVER (PARTITION BY fn ORDER BY begin_idx, end_idx) AS grp FROM o)
      SELECT module, fn, min(begin_idx) AS begin_idx, max(end_idx) AS end_idx FROM g GROUP BY module, fn, grp""",
)
def w4(spark, sf):
    s = Sessions(spark, sf)
    branches = s.instructions.where("is_terminator and opcode = 'signup'").select(*FN, F.col("pos").alias("idx"))
    wide = runs.widen_runs(session_runs(s), session_uses(s), FN)
    return runs.merge_runs(runs.trim_branch_ends(wide, branches, FN), FN)


@query(
    "w5_first_n_per_key",
    EVENTS
    + """SELECT module, fn, inst, report_no FROM (SELECT *, row_number() OVER (PARTITION BY module, fn ORDER BY ts) AS report_no
      FROM ev WHERE level > 1) WHERE report_no <= 2""",
)
def w5(spark, sf):
    rows = Sessions(spark, sf).events.select(*FN, "inst", "ts", _seed_level()[0]).where("level > 1")
    return runs.first_n_per_key(rows, FN, ["ts"]).select(*FN, "inst", F.col("report_no").cast("long").alias("report_no"))


@query(
    "w6_running_checksum",
    EVENTS
    + f"""SELECT module, fn, n_rows, CAST(checksum AS BIGINT) AS checksum FROM (
      SELECT module, fn, n_rows, sum(s) OVER (PARTITION BY module ORDER BY fn) AS checksum FROM (
      SELECT module, fn, count(*) AS n_rows, sum(inst) AS s FROM ev WHERE {_ELIGIBLE_SQL} GROUP BY ALL))""",
)
def w6(spark, sf):
    out = runs.running_checksum(_checksum_rows(spark, sf), "inst")
    return out.withColumn("checksum", F.col("checksum").cast("long"))
