"""Small graphs whole, large ones in rounds.

Most functions are small: what takes a fixpoint many rounds over all of them is a short walk in each. Graphs (``keys``) of
at most ``spark.tidemark.smallGraph`` rows in all their tables are collected, one row per graph, and solved where that row
lies; the tables move once. Where a solver's work follows the rows (``linear``), graphs up to ``spark.tidemark.wholeGraph``
rows are solved whole too, but each is a group of its own whose rows are shuffled as they are. Graphs above it, and rows with a
NULL key, go through the rounds, so no graph of any size has to fit one task. All ways give the same rows.

The solvers take lists of tuples, one list per table, and yield tuples. A NULL node is reached but leads nowhere, as in a join.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import materialise

#: Rows, in all tables together, up to which a graph is solved whole.
SMALL_CONF = "spark.tidemark.smallGraph"
SMALL = 1000
#: The same for solvers whose work follows the rows; where only ``SMALL_CONF`` is set, it holds for them too. A random graph
#: of a million rows took 0.3 (spread) to 0.7 GB (heights) of a Python process.
WHOLE_CONF = "spark.tidemark.wholeGraph"
WHOLE = 1_000_000
#: Values that seeds may carry for a walk from each of them to count as linear.
WALKS = 16
#: Graphs turned into Python values at a time, and rows given back at a time.
GRAPHS, ROWS = 256, 20_000

Solver = Callable[..., Iterable[tuple]]
# Executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def either(
    tables: list[DataFrame],
    keys: list[str],
    solve: Solver,
    fields: list[tuple],
    rounds: Callable[..., DataFrame],
    linear: bool | Callable[..., bool] = False,
) -> DataFrame:
    """``solve`` on small graphs, ``rounds(*tables)`` on the large ones: (keys, fields).

    ``tables`` start with ``keys``, the other columns make the tuples; ``fields`` are the names and types of what comes out.
    ``linear`` (of the first table, if it can be called) says that the work of ``solve`` follows the rows.
    """
    spark = tables[0].sparkSession
    limit = int(spark.conf.get(SMALL_CONF, None) or SMALL)
    whole = int(spark.conf.get(WHOLE_CONF, None) or (limit if spark.conf.get(SMALL_CONF, None) else WHOLE))
    tables = [materialise(t, "graphs") for t in tables]
    names = reduce(DataFrame.union, [t.select(*keys) for t in tables])
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    sizes = materialise(names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    if linear and callable(linear):
        linear = sizes.where(F.col("_n") > limit).limit(1).count() > 0 and linear(tables[0])
    rows = F.col("_n")
    kind = F.when(no_key | (rows > (max(limit, whole) if linear else limit)), "large").when(rows > limit, "single").otherwise("small")
    sizes = sizes.select(*keys, kind.alias("_kind"))
    kinds = [r[0] for r in sizes.select("_kind").distinct().collect()] or ["small"]
    schema = StructType([tables[0].schema[k] for k in keys])
    for name, type_ in fields:
        schema = schema.add(name, type_)
    ways = {
        "small": lambda *t: _whole(t, keys, solve, schema),
        "single": lambda *t: _single(t, keys, solve, schema),
        "large": lambda *t: rounds(*t).select(*schema.names),
    }
    if len(kinds) == 1:
        return ways[kinds[0]](*tables)

    def part(table: DataFrame, kind: str) -> DataFrame:
        same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
        return table.alias("t").join(sizes.where(F.col("_kind") == kind).alias("l"), same, "left_semi")

    return reduce(DataFrame.union, [ways[k](*[materialise(part(t, k), k) for t in tables]) for k in sorted(kinds)])


def few_walks(rest: list[str], seed: DataFrame) -> bool:
    """Seeds carry few enough values in the columns ``rest`` for a walk from each of them."""
    return not rest or seed.select(*rest).distinct().limit(WALKS + 1).count() <= WALKS


def _single(tables: Iterable[DataFrame], keys: list[str], solve: Solver, schema: StructType) -> DataFrame:
    """One group per graph: rows of all tables in one, a struct per table."""
    tables = list(tables)
    parts = [t.select(*keys, F.lit(i).alias("_i"), F.struct(*[c for c in t.columns if c not in keys]).alias(f"_t{i}")) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    n_tables, arrow = len(tables), to_arrow_schema(schema)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = {}, [[] for _ in range(n_tables)]
        # Equal values are one object each.
        values = lambda column: [names.setdefault(v, v) for v in column.to_pylist()] if pa.types.is_string(column.type) else column.to_pylist()
        for batch in batches:
            for i, rows_ in enumerate(lists):
                mine = batch.filter(pc.equal(batch.column("_i"), i)).column(f"_t{i}")
                rows_ += zip(*[values(c) for c in mine.flatten()])
        head = tuple(k.as_py() for k in key)
        found, pack = [], lambda rows_: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_), arrow)], schema=arrow)
        for row in solve(*lists):
            found.append(head + row)
            if len(found) == ROWS:
                yield pack(found)
                found = []
        if found:
            yield pack(found)

    return materialise(rows.groupBy(*keys).applyInArrow(run, schema), "solved")


def _whole(tables: Iterable[DataFrame], keys: list[str], solve: Solver, schema: StructType) -> DataFrame:
    packed = None
    for i, t in enumerate(tables):
        rest = [c for c in t.columns if c not in keys]
        lists = t.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(f"_t{i}"))
        packed = lists if packed is None else packed.join(lists, keys, "full_outer")
    n_keys, arrow = len(keys), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        for batch in batches:
            for at in range(0, batch.num_rows, GRAPHS):
                piece = batch.slice(at, GRAPHS)
                names = zip(*[c.to_pylist() for c in piece.columns[:n_keys]])
                found = []
                for key, *lists in zip(names, *[_tuples(c) for c in piece.columns[n_keys:]]):
                    for row in solve(*lists):
                        found.append(key + row)
                        if len(found) == ROWS:
                            yield pack(found)
                            found = []
                if found:
                    yield pack(found)

    return materialise(packed.select(*keys, *[f"_t{i}" for i in range(len(tables))]).mapInArrow(run, schema), "solved")


def _tuples(column: pa.Array) -> Iterator[list[tuple]]:
    rows = list(zip(*[f.to_pylist() for f in column.flatten().flatten()]))
    at = 0
    for n in column.value_lengths().to_pylist():
        yield rows[at : at + (n or 0)]
        at += n or 0


def _next(edges: list[tuple]) -> dict:
    out = defaultdict(list)
    for a, b in edges:
        if a is not None:
            out[a].append(b)
    return out


def spread(seeds: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """Seeds (node, ...) and, for each value of the rest, all nodes that its seeds reach."""
    out, groups = _next(edges), defaultdict(list)
    for node, *rest in seeds:
        groups[tuple(rest)].append(node)
    for rest, open_ in groups.items():
        for node in walk(open_, out):
            yield (node, *rest)


def walk(starts: list, out: dict, stop=None) -> set:
    seen, open_ = set(starts), list(dict.fromkeys(starts))
    while open_:
        for b in out.get(open_.pop(), ()):
            if b not in seen and (stop is None or (b is not None and b != stop)):
                seen.add(b)
                open_.append(b)
    return seen


def facts(top: int, seeds: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """Seeds (node, level, ref) carried along; a node of level ``top`` takes no further facts but its own."""
    out, groups, own = _next(edges), defaultdict(list), set(seeds)
    for node, level, ref in own:
        groups[level, ref].append(node)
    full = set()
    for level, ref in sorted(groups, key=lambda g: g[0] != top):
        # What goes on from a full node goes to full nodes only.
        reached = walk(groups[level, ref], out)
        for node in reached:
            if node not in full or (node, level, ref) in own:
                yield node, level, ref
        if level == top:
            full |= reached


def least(seeds: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """(node, value): the least value of the seeds (node, value) that reach it."""
    out, seen = _next(edges), set()
    for node, value in sorted((s for s in seeds if s[1] is not None), key=lambda s: s[1]):
        open_ = [] if node in seen else [node]
        seen.add(node)
        while open_:
            at = open_.pop()
            yield at, value
            for b in out.get(at, ()):
                if b not in seen:
                    seen.add(b)
                    open_.append(b)


def ends(links: list[tuple]) -> Iterator[tuple]:
    """(src, end, steps) of single links; what runs into a cycle has no end."""
    to, known = dict(links), {}
    for src, _ in links:
        path, at = [], src
        while at in to and at not in known:
            known[at] = None  # on the path, or on a cycle
            path.append(at)
            at = to[at]
        end = known[at] if at in known else (at, 0)
        for node in reversed(path):
            end = known[node] = end and (end[0], end[1] + 1)
        if known.get(src):
            yield (src, *known[src])


def components(edges: list[tuple]) -> Iterator[tuple]:
    """(node, least node of its strongly connected component)."""
    out, index, low, stack = _next(edges), {}, {}, []
    held = set()
    for start in dict.fromkeys(n for e in edges for n in e):
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        held.add(start)
        open_ = [(start, iter(out.get(start, ())))]
        while open_:
            at, more = open_[-1]
            for b in more:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    held.add(b)
                    open_.append((b, iter(out.get(b, ()))))
                    break
                if b in held:
                    low[at] = min(low[at], index[b])
            else:
                open_.pop()
                if open_:
                    low[open_[-1][0]] = min(low[open_[-1][0]], low[at])
                if low[at] == index[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(stack.pop())
                        held.discard(members[-1])
                    comp = min(members) if len(members) > 1 else at
                    for node in members:
                        yield node, comp


def heights(edges: list[tuple]) -> Iterator[tuple]:
    """(node, comp, level) of edges (src, dst, weight): greatest weight of a path to a leaf on the graph of components; an edge
    that leaves a cycle weighs 1."""
    edges = [e for e in edges if e[0] is not None and e[1] is not None]
    out, comp, level = defaultdict(list), {}, {}
    for a, b, weight in edges:
        out[a].append((b, weight))
    members = []

    def settle() -> None:
        high = 0
        for node in members:
            for b, weight in out.get(node, ()):
                if comp[b] != comp[node]:
                    high = max(high, level[comp[b]] + (1 if len(members) > 1 else weight))
        level[comp[members[0]]] = high

    # Components come after those they lead to.
    for node, name in components([e[:2] for e in edges]):
        if members and comp[members[0]] != name:
            settle()
            members.clear()
        comp[node] = name
        members.append(node)
    if members:
        settle()
    for node, name in comp.items():
        yield node, name, level[name]


def follow(seeds: list[tuple], links: list[tuple]) -> Iterator[tuple]:
    """Rows that ``seeds`` reach by links, the columns of a link being those of its start and then those of its end."""
    out, n = defaultdict(list), len(links[0]) // 2 if links else 0
    for link in links:
        if None not in link[:n]:
            out[link[:n]].append(link[n:])
    yield from walk(seeds, out)


def summaries(seeds: list[tuple], into: list[tuple], lift: list[tuple]) -> Iterator[tuple]:
    """Facts (kind, id, slot, level, ref): those of functions (``out``) go to groups as they are (``into``: id, grp), those of
    groups (``grp``) become what ``lift`` (id, slot, level, ref, and the fact made of it) says."""
    groups, up = _next(into), defaultdict(list)
    for row in lift:
        if None not in row[:4]:
            up[row[:4]].append(row[4:])
    seen, open_ = set(seeds), list(dict.fromkeys(seeds))
    while open_:
        fact = open_.pop()
        yield fact
        if fact[0] == "grp":
            new = up.get(fact[1:], ())
        else:
            new = [("grp", g, *fact[2:]) for g in groups.get(fact[1], ())]
        for other in new:
            if other not in seen:
                seen.add(other)
                open_.append(other)


def call_facts(
    top: int, arg: int, seeds: list[tuple], into: list[tuple], calls: list[tuple], flows: list[tuple], arg_flows: list[tuple]
) -> Iterator[tuple]:
    """Facts (kind, id, slot, level, ref) of functions (``out``), groups (``grp``), calls (``res``) and actuals (``arg``).

    ``into`` (function, grp), ``calls`` (inst, grp), ``flows`` (inst, slot, function, slot), ``arg_flows`` (inst, slot, inst, slot).
    A group's fact of level ``arg`` asks for the actual that its ref names, at each of its calls; level ``top`` goes on as it is.
    """
    groups, of_call, of_group = _next(into), _next(calls), _next([c[::-1] for c in calls])
    ups, ons = defaultdict(list), defaultdict(list)
    for table, out in ((flows, ups), (arg_flows, ons)):
        for a, slot, b, to in table:
            if a is not None and slot is not None:
                out[a, slot].append((b, to))
    actuals, asked = defaultdict(list), defaultdict(list)
    seen, open_ = set(seeds), list(dict.fromkeys(seeds))
    while open_:
        fact = open_.pop()
        yield fact
        kind, id_, slot, level, ref = fact
        new = []
        if kind == "out":
            new = [("grp", g, slot, level, ref) for g in groups.get(id_, ())]
        elif kind == "grp" and level == top:
            new = [("res", c, slot, level, ref) for c in of_group.get(id_, ())]
        elif kind == "grp" and level == arg and ref is not None:
            asked[id_, str(ref)].append(slot)
            new = [("res", c, slot, *a) for c in of_group.get(id_, ()) for a in actuals.get((c, str(ref)), ())]
        elif kind == "arg":
            actuals[id_, slot].append((level, ref))
            new = [("res", id_, s, level, ref) for g in of_call.get(id_, ()) for s in asked.get((g, slot), ())]
        elif kind == "res":
            new = [("out", b, to, level, ref) for b, to in ups.get((id_, slot), ())]
            new += [("arg", b, to, level, ref) for b, to in ons.get((id_, slot), ())]
        for other in new:
            if other not in seen:
                seen.add(other)
                open_.append(other)


def parents(roots: list[tuple], edges: list[tuple]) -> dict:
    """Node -> nearest strict dominator, None for the root, by passes over the nodes in reverse postorder."""
    out, into = _next(edges), defaultdict(list)
    root = roots[0][0] if roots else None
    if root is None:
        return {}
    order, seen = [], {root}
    open_ = [(root, iter(out.get(root, ())))]
    while open_:
        at, more = open_[-1]
        for b in more:
            into[b].append(at)
            if b not in seen and b is not None:
                seen.add(b)
                open_.append((b, iter(out.get(b, ()))))
                break
        else:
            open_.pop()
            order.append(at)
    rank = {node: i for i, node in enumerate(order)}
    above, changed = {root: root}, True
    while changed:
        changed = False
        for node in reversed(order[:-1]):
            new = None
            for p in into[node]:
                if p in above:
                    a = p
                    while new is not None and a != new:
                        if rank[a] < rank[new]:
                            a = above[a]
                        else:
                            new = above[new]
                    new = a
            if above.get(node) != new:
                above[node], changed = new, True
    above[root] = None
    return above


def immediate_dominators(roots: list[tuple], edges: list[tuple]) -> Iterable[tuple]:
    """(node, nearest strict dominator)."""
    return parents(roots, edges).items()


def dominator_tree(roots: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """(node, parent, first, last) with intervals: below a node are those whose first lies in its own."""
    above = parents(roots, edges)
    below = defaultdict(list)
    for node, parent in above.items():
        if parent is not None:
            below[parent].append(node)
    n, open_ = 0, [(r, None, False) for r in above if above[r] is None]
    first = {}
    while open_:
        node, parent, done = open_.pop()
        if done:
            yield node, parent, first[node], n
            continue
        n += 1
        first[node] = n
        open_.append((node, parent, True))
        open_ += [(b, node, False) for b in below[node]]


def ancestors(tree: list[tuple]) -> Iterator[tuple]:
    """(node, above, steps) for all pairs of a tree of (node, parent)."""
    above = {node: parent for node, parent in tree if parent is not None}
    for node in above:
        at, steps = above.get(node), 1
        while at is not None:
            yield node, at, steps
            at, steps = above.get(at), steps + 1


def between(stops: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """(start, stop, block): blocks from start up to, without, stop."""
    out = _next(edges)
    for start, stop in dict.fromkeys(stops):
        for block in walk([start], out, stop):
            yield start, stop, block


def cuts(edges: list[tuple]) -> Iterator[tuple]:
    """Nodes whose removal takes a part of the undirected graph apart."""
    out = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out[a].add(b)
            out[b].add(a)
    index, low = {}, {}
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        branches, found = 0, set()
        open_ = [(start, None, iter(out[start]))]
        while open_:
            at, parent, more = open_[-1]
            for b in more:
                if b not in index:
                    index[b] = low[b] = len(index)
                    open_.append((b, at, iter(out[b])))
                    break
                if b != parent:
                    low[at] = min(low[at], index[b])
            else:
                open_.pop()
                if parent == start:
                    branches += 1
                elif parent is not None and low[at] >= index[parent]:
                    found.add(parent)
                if parent is not None:
                    low[parent] = min(low[parent], low[at])
        for node in found | ({start} if branches > 1 else set()):
            yield (node,)
