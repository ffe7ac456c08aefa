"""Least fixpoints over DataFrames.

Rounds are semi-naive: a round joins only the rows found by the round before. Every round is written
as a table of its own in the shared folder and never rewritten, so the plan stays short and a lost
executor re-reads files. What is known already is taken out of new rows where it lies: rows of late
rounds are few and broadcast on their true size, all earlier ones stand in buckets, so that a round
moves new rows only. Small deltas are broadcast by the optimizer on their true size, large ones shuffle
with skew handling.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise, new_table_path, sized, too_large

Step = Callable[[DataFrame], DataFrame]
#: Fewer edges that could form a chain are not worth links of their own.
LEAST_CHAIN = 100
#: Rows of late rounds that stay outside the buckets.
RECENT_CONF = "spark.tidemark.recentRows"
RECENT_ROWS = 200_000


def same(names: list[str]) -> Column:
    """Rows ``new`` and ``old`` agree in ``names``, NULL with NULL.

    Written so that only the hash of a row is a key of the join: it is what the buckets hang on.
    """
    both = lambda n: F.col(f"new.{n}").isNull() & F.col(f"old.{n}").isNull()
    return reduce(Column.__and__, [F.coalesce(F.col(f"new.{n}") == F.col(f"old.{n}"), both(n)) for n in names])


class _Rounds:
    """Append-only table, one folder per round, and an index of it that stays where it is.

    ``by`` are the columns whose hash tells rows apart. Rounds are kept as they are until they hold
    more than ``spark.tidemark.recentRows`` rows; then they become a table in buckets of that hash,
    together with all such tables that are no larger. So there are at most log2 of them, a row is
    bucketed again at most log2 times, and new rows meet the buckets without an exchange of these.
    """

    def __init__(self, df: DataFrame, name: str, by: list[str], tidy: Step):
        self.spark, self.schema, self.by, self.tidy = df.sparkSession, df.schema, by, tidy
        self.root, self.paths = new_table_path(self.spark, name), []
        self.recent, self.recent_rows = [], 0
        self.settled = []  # (table, rows), largest first
        self.last_rows = self.rows = 0
        self.limit = int(self.spark.conf.get(RECENT_CONF, str(RECENT_ROWS)))
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> _Rounds:
        return self

    def __exit__(self, *_) -> None:
        for table, _rows in self.settled:
            self._forget(table)

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(*self.by))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/round-{len(self.paths):05d}"
        delta = materialise(df, path=path)
        self.paths.append(path)
        self.last_rows = delta.count()
        self.rows += self.last_rows
        if self.last_rows:
            self.recent.append(path)
            self.recent_rows += self.last_rows
        if self.recent_rows > self.limit:
            self._settle()
        return delta

    def _settle(self) -> None:
        rows, parts, old = self.recent_rows, [self._read(self.recent)], []
        while self.settled and self.settled[-1][1] <= rows:
            table, n = self.settled.pop()
            old.append(table)
            parts.append(self.spark.table(table).drop("_h"))
            rows += n
        table = f"tidemark_known_{uuid.uuid4().hex}"
        merged = self._keyed(self.tidy(reduce(DataFrame.unionByName, parts)))
        # One file per bucket, in the shared folder.
        writer = merged.repartition(self.buckets, "_h").write.bucketBy(self.buckets, "_h")
        writer.option("path", f"{self.root}/{table}").saveAsTable(table)
        self.settled.append((table, rows))
        self.recent, self.recent_rows = [], 0
        for name in old:
            self._forget(name)

    def new(self, found: DataFrame, covered: Column) -> DataFrame:
        """Rows of ``found`` that no known row with their hash ``covered``s; sides are ``new`` and ``old``."""
        # Hashes of the same number differ between types.
        types = {f.name: f.dataType for f in self.schema if f.dataType.simpleString() != found.schema[f.name].dataType.simpleString()}
        left = self._keyed(found.withColumns({n: F.col(n).cast(t) for n, t in types.items()})).alias("new")
        # Buckets are joined where they are, never broadcast, unless they are small in memory too.
        tables = [(self.spark.table(t), n) for t, n in self.settled]
        known = [t.hint("merge") if too_large(t, n) else t for t, n in tables]
        if self.recent:
            known.append(self._keyed(self._read(self.recent)))
        for old in known:
            left = left.join(old.alias("old"), (F.col("new._h") == F.col("old._h")) & covered, "left_anti").alias("new")
        return left.drop("_h")

    def all(self) -> DataFrame:
        return sized(self._read(self.paths), self.rows)


def pace(edges: DataFrame, keys: list[str]) -> dict[str, int]:
    """How many hops a round may take, and how many of them without removing duplicates.

    Measured, not guessed: the number of two- and three-hop walks bounds the rows that hops without
    duplicate removal can make. Thin graphs run three hops in one stage; a graph with a hub that has
    many edges in and out gets duplicates removed at every hop.
    """
    out = edges.groupBy(*keys, F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("_out"))
    into = edges.groupBy(*keys, F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("_in"))
    walks = edges.join(out, keys + ["dst"]).join(into, keys + ["src"], "left")
    before = F.coalesce("_in", F.lit(0)).cast("double")
    two, three = walks.agg(F.sum(F.col("_out").cast("double")), F.sum(before * F.col("_out"))).first()
    n = edges.count()
    if (three or 0) <= 8 * n and (two or 0) <= 4 * n:
        return {"hops": 3, "stride": 3}
    if (two or 0) <= 4 * n:
        return {"hops": 2, "stride": 2}
    return {"hops": 2, "stride": 1}


def skip_links(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` and, for each graph of ``keys`` that is (nearly) a forest, links over 2, 4, 8, ... nodes of a chain.

    The links are implied by the edges, so reachability stays the same, but a chain of n nodes is
    crossed in log2(n) rounds instead of n: one endless chain cannot hold up the loop. Building them
    takes log2(n) joins that shrink with the chains still open. Graphs where less than 95% of the
    edges are the only one into their node get no links; there plain rounds are cheaper. Each graph is judged by
    itself; one of fewer than ``LEAST_CHAIN`` such edges is crossed soon enough without.
    """
    return weighted_links(edges, keys).drop("weight")


def weighted_links(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``skip_links`` with ``weight``, the number of edges a link stands for."""
    edges = edges.select(*keys, "src", "dst")
    single = edges.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("src"))
    judged = single.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.count_if(F.col("_n") == 1).alias("_alone"))
    thin = materialise(judged.where(f"_alone >= 0.95 * _all and _alone >= {LEAST_CHAIN}").select(*keys, "_alone"), "thin")
    alone = thin.agg(F.max("_alone")).first()[0]
    if not alone:
        return edges.withColumn("weight", F.lit(1))
    links = single.where("_n = 1 and src <> dst").join(thin.select(*keys), keys, "left_semi").select(*keys, "src", "dst")
    links = materialise(links, "links")
    found, length = edges.withColumn("weight", F.lit(1)), 1
    # A closed ring never runs out of links; past all nodes it has been crossed.
    while length <= alone:
        far = links.select(*keys, "src", F.col("dst").alias("_mid"))
        near = links.select(*keys, F.col("src").alias("_mid"), "dst")
        links = materialise(far.join(near, keys + ["_mid"]).where("src <> dst").select(*keys, "src", "dst"), "links")
        if links.isEmpty():
            break
        length *= 2
        found = found.union(links.withColumn("weight", F.lit(length)))
    return found


def _hops(step: Step, delta: DataFrame, hops: int, stride: int, tidy: Step) -> DataFrame:
    """All rows within ``hops`` steps of ``delta``, duplicates removed every ``stride`` steps."""
    front, found = delta, None
    for i in range(1, hops + 1):
        front = step(front)
        if i % stride == 0 and i < hops:
            front = tidy(front)
        found = front if found is None else found.union(front)
    return found


def closure(
    seed: DataFrame,
    step: Step,
    hops: int = 1,
    stride: int = 1,
    by: list[str] | None = None,
    covered: Column | None = None,
    with_known: bool = False,
) -> DataFrame:
    """Smallest set of rows that holds ``seed`` and everything ``step`` makes of its rows.

    ``hops`` and ``stride``: see ``pace``. A new row adds nothing if a known one is equal to it; with
    ``by`` and ``covered``, if a known row with the same values of ``by`` fulfils the condition, in which the two are
    called ``new`` and ``old`` (it must hold for equal rows).
    A step that joins found rows with each other asks for ``step(delta, known)`` through
    ``with_known`` and takes one hop per round.
    """
    cols = seed.columns
    by, covered = by or cols, same(cols) if covered is None else same(by) & covered
    unique = lambda d: d.distinct()
    with _Rounds(seed, "closure", by, lambda d: d) as rounds:
        delta = rounds.add(seed.distinct())
        while rounds.last_rows:
            if with_known:
                found = step(delta, rounds.all()).select(*cols)
            else:
                found = _hops(lambda d: step(d).select(*cols), delta, hops, stride, unique)
            delta = rounds.add(rounds.new(unique(found), covered))
        return rounds.all()


def relax(
    seed: DataFrame, step: Step, keys: list[str], value: str, hops: int = 1, stride: int = 1, best=F.min
) -> DataFrame:
    """Best ``value`` per key, where ``step`` offers values to other keys."""
    cols = keys + [value]
    pick = lambda df: df.groupBy(*keys).agg(best(value).alias(value))
    offered, had = F.col(f"new.{value}"), F.col(f"old.{value}")
    covered = same(keys) & (had <= offered if best is F.min else had >= offered)
    seed = seed.select(*cols)
    with _Rounds(seed, "relax", keys, pick) as rounds:
        delta = rounds.add(pick(seed))
        while rounds.last_rows:
            found = _hops(lambda d: step(d).select(*cols), delta, hops, stride, pick)
            delta = rounds.add(rounds.new(pick(found).where(F.col(value).isNotNull()), covered))
        return pick(rounds.all())


def chase(links: DataFrame, keys: list[str]) -> DataFrame:
    """Follow single links ``src -> dst`` to their end by pointer doubling: (keys, src, end, steps).

    Each ``src`` has at most one link. A chain of n links takes log2(n) rounds. Nodes that run into a
    cycle have no end and are left out.
    """
    at = materialise(links.select(*keys, "src", F.col("dst").alias("end"), F.lit(1).cast("long").alias("steps")), "chase")
    done = None
    moving_before = None
    while True:
        hop = at.select(*keys, F.col("src").alias("end"), F.col("end").alias("_end2"), F.col("steps").alias("_s2"))
        moved = at.join(hop, keys + ["end"], "left").select(
            *keys,
            "src",
            F.coalesce("_end2", "end").alias("end"),
            (F.col("steps") + F.coalesce("_s2", F.lit(0))).alias("steps"),
            F.col("_end2").isNotNull().alias("_moving"),
        )
        moved = materialise(moved, "chase")
        n, moving, longest = moved.agg(
            F.count(F.lit(1)), F.count_if("_moving"), F.max(F.when(F.col("_moving"), F.col("steps")))
        ).first()
        if not moving:
            return moved.drop("_moving")
        if longest > 2 * n:  # longer than any simple chain: on a cycle
            return moved.where("not _moving").drop("_moving")
        at = moved.drop("_moving")
