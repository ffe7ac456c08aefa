"""SQL text of the fact bindings, put in front of the oracle queries."""

EVENTS = """WITH RECURSIVE ev0 AS (
  SELECT CAST(user_id % 10 AS INTEGER) AS module, user_id AS fn,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS block,
         event_id AS inst, event_type AS opcode, value, ts FROM events),
ev AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY fn ORDER BY ts) AS pos,
         row_number() OVER (PARTITION BY fn, block ORDER BY ts) - 1 AS idx,
         lead(block) OVER (PARTITION BY fn ORDER BY ts) AS next_block,
         lag(inst) OVER (PARTITION BY fn, opcode ORDER BY ts) AS operand,
         lead(inst) OVER (PARTITION BY fn, block ORDER BY ts) IS NULL AS is_terminator,
         opcode IN ('click', 'signup', 'error') AS is_conditional,
         CASE WHEN value >= 10 THEN block END AS line,
         CAST(CASE WHEN opcode = 'error' AND value > 150 THEN 4
                   WHEN opcode = 'signup' THEN 3 ELSE 1 END AS INTEGER) AS level,
         CAST(CASE WHEN opcode = 'signup' THEN block % 3 END AS INTEGER) AS arg
  FROM ev0),
ends AS (SELECT module, fn, min_by(block, ts) AS entry, max_by(block, ts) AS exit_ FROM ev0 GROUP BY ALL),
blk AS MATERIALIZED (
  SELECT b.module, b.fn, b.block, b.n_rows, b.block = e.entry AS is_entry, b.block = e.exit_ AS is_exit
  FROM (SELECT module, fn, block, count(*) AS n_rows FROM ev0 GROUP BY ALL) b JOIN ends e USING (module, fn)),
edge AS MATERIALIZED (
  SELECT DISTINCT module, fn, block AS src, next_block AS dst FROM ev WHERE next_block <> block),
live AS MATERIALIZED (
  SELECT * FROM edge e WHERE NOT EXISTS (
    SELECT 1 FROM ev0 x WHERE x.opcode = 'error' AND x.fn = e.fn AND x.block = e.src)),
hotblk AS (SELECT DISTINCT module, fn, block FROM ev WHERE level = 4),
fns AS (
  SELECT e.module, e.fn,
         EXISTS (SELECT 1 FROM hotblk h WHERE h.fn = e.fn AND h.block = e.entry) AS is_dep_fn,
         EXISTS (SELECT 1 FROM hotblk h WHERE h.fn = e.fn AND h.block = e.exit_) AS is_extracted
  FROM ends e),
reach(module, fn, block) AS (
  SELECT module, fn, block FROM blk WHERE is_entry
  UNION SELECT l.module, l.fn, l.dst FROM reach r JOIN live l ON l.fn = r.fn AND l.src = r.block)
"""

PARTS = """WITH RECURSIVE succ AS MATERIALIZED (
  SELECT CAST(c_nationkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS module,
         l_orderkey, l_partkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
         lead(l_partkey) OVER w AS next_part,
         l_orderkey || '-' || row_number() OVER w AS inst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
pedge AS MATERIALIZED (
  SELECT DISTINCT module, l_partkey AS src, next_part AS dst FROM succ WHERE next_part <> l_partkey),
func AS MATERIALIZED (
  SELECT module, fn, p_name AS name, p_brand || '/' || p_type || '/' || p_size % 5 AS fn_type,
         p_brand, p_type, p_size, CAST(p_size % 2 + 2 AS INTEGER) AS n_args, p_size % 3 = 0 AS is_vararg, p_size <= 5 AS is_declaration
  FROM (SELECT DISTINCT module, l_partkey AS fn FROM succ) JOIN part ON fn = p_partkey),
ownline AS MATERIALIZED (SELECT s.* FROM succ s JOIN part c ON c.p_partkey = s.l_partkey AND c.p_size > 5),
callline AS (
  SELECT s.*, t.p_brand || '/' || t.p_type || '/' || t.p_size % 5 AS t_fn_type, t.p_type, t.p_size AS size,
         CASE WHEN l_tax < 0.02 AND l_linestatus = 'F' THEN 'signature'
              WHEN l_tax < 0.02 AND l_linestatus = 'O' THEN 'slot'
              WHEN l_returnflag = 'A' AND l_tax >= 0.07 THEN 'alias' ELSE 'direct' END AS how
  FROM succ s JOIN part c ON c.p_partkey = s.l_partkey AND c.p_size > 5
              JOIN part t ON t.p_partkey = s.next_part),
call AS MATERIALIZED (
  SELECT module, l_partkey AS fn, inst, how,
         CASE WHEN how = 'direct' THEN next_part END AS callee,
         CASE WHEN how = 'alias' THEN next_part END AS alias_of,
         CASE WHEN how = 'signature' THEN t_fn_type END AS fn_type,
         CASE WHEN how = 'slot' THEN p_type END AS type_id,
         CASE WHEN how = 'slot' THEN 8 * (size % 5) + CASE WHEN size = 50 THEN 4 ELSE 0 END END AS slot_offset
  FROM callline),
callarg AS MATERIALIZED (
  SELECT module, l_partkey AS fn, inst, 0 AS arg_no,
         CASE WHEN l_quantity >= 40 THEN 4 ELSE 1 END AS level, -1 AS ref FROM callline
  UNION ALL SELECT module, l_partkey, inst, 1, CASE WHEN l_discount >= 0.09 THEN 4 ELSE 1 END, -1 FROM callline
  UNION ALL SELECT module, l_partkey, inst, 2, CASE WHEN l_tax >= 0.07 THEN 3 ELSE 1 END,
                   CASE WHEN l_tax >= 0.07 THEN 2 ELSE -1 END FROM callline),
vt AS (
  SELECT module, p_type || '/' || CASE WHEN p_brand < 'Brand#2' THEN 'a' ELSE 'b' END AS vtable,
         p_type AS type_id, fn, p_size, is_declaration FROM func),
vtype AS MATERIALIZED (
  SELECT DISTINCT module, vtable, type_id, type_id <> (SELECT min(p_type) FROM part) AS is_constant FROM vt),
vslot AS MATERIALIZED (
  SELECT module, vtable, p_size % 4 + 2 AS slot_no, min(fn) AS target, min_by(is_declaration, fn) AS is_pure
  FROM vt GROUP BY ALL),
mname AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 5 AND p_name NOT LIKE '%gizmo%'),
model AS MATERIALIZED (
  SELECT name, 'return' AS target,
         CASE length(name) % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 1 END AS level,
         CASE WHEN length(name) % 3 = 0 THEN [0, 1] ELSE CAST([] AS INTEGER[]) END AS arg_deps,
         CASE WHEN name LIKE '%rod' THEN [1] ELSE CAST([] AS INTEGER[]) END AS callbacks FROM mname
  UNION ALL SELECT name, '0', 3, [1, 2], CAST([] AS INTEGER[]) FROM mname WHERE name LIKE '%gear'),
slotgrp AS MATERIALIZED (
  SELECT c.module, c.type_id, c.slot_offset,
         bool_and(coalesce(t.is_constant AND (16 + c.slot_offset) % 8 = 0 AND s.target IS NOT NULL, false)) AS ok,
         count(CASE WHEN NOT s.is_pure THEN 1 END) AS n
  FROM (SELECT DISTINCT module, type_id, slot_offset FROM call WHERE how = 'slot') c
  LEFT JOIN vtype t USING (module, type_id)
  LEFT JOIN vslot s ON s.module = t.module AND s.vtable = t.vtable AND s.slot_no = (16 + c.slot_offset) // 8
  GROUP BY ALL),
slottgt AS MATERIALIZED (
  SELECT DISTINCT g.module, g.type_id, g.slot_offset, s.target
  FROM slotgrp g JOIN vtype t USING (module, type_id)
  JOIN vslot s ON s.module = t.module AND s.vtable = t.vtable AND s.slot_no = (16 + g.slot_offset) // 8
  WHERE g.ok AND g.n > 0 AND NOT s.is_pure),
resolved AS MATERIALIZED (
  SELECT module, fn, inst, 'direct' AS how, callee AS target FROM call WHERE callee IS NOT NULL
  UNION ALL SELECT module, fn, inst, 'alias', alias_of FROM call WHERE alias_of IS NOT NULL
  UNION ALL SELECT c.module, c.fn, c.inst, 'slot', s.target FROM call c JOIN slottgt s USING (module, type_id, slot_offset)
  UNION ALL SELECT c.module, c.fn, c.inst, 'signature', f.fn FROM call c JOIN func f
    ON f.module = c.module AND f.fn_type = c.fn_type AND NOT f.is_declaration),
cedge AS MATERIALIZED (SELECT DISTINCT module, fn AS src, target AS dst FROM resolved)
"""
