"""Mixing sources to target weights by the cube method.

Every source has a target in words; target / source size is the ratio each of its documents is taken at: whole
copies first, the fraction left is an inclusion probability. The cube method rounds these probabilities: it moves
the point of all probabilities along directions that keep both totals (documents, words) until each
coordinate is 0 or 1. With two totals any three undecided documents give such a direction, so a flight holds three
at a time and leaves two at most.

Flights run within blocks of at most about ``BLOCK`` documents of one source, dealt by a hash of the id, so a hot source is
many blocks. What each leaves undecided flies again in blocks of ``FAN`` blocks, and so on, until one block for each source
is left. Its last two documents are the landing problem: the rounding nearest in words is taken, and one exchange of two
documents of that block meets what is still amiss. Only id, source and size are shuffled, never texts.

Chance comes from hashes of ids and ``seed``: reruns agree. Null text: size 0. Null source: a source of its own, last in
order. Sources of size 0: taken 0. Repeated rows are documents of their own; rows with equal id and size are
interchangeable. Empty table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slim, word_count

BLOCK, FAN, MOST = 4096, 256, 3
EPS = 1e-9


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size) rows.

    Weights repeat ``cycle`` over the sources in code point order, null last. A target above ``most`` times its
    source's size stops there; the excess is shared again by weight until none is above.
    """
    totals = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    # Position in code point order without one sorted task: row number in its range, plus the rows of earlier ranges.
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = materialise(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.selectExpr("*", "shiftright(_m, 33) as _part", "_m & 8589934591 as _at")
    before = ordered.groupBy("_part").count().selectExpr("_part as _p", "sum(count) over (order by _part rows between unbounded preceding and 1 preceding) as _before")
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = ordered.join(before, F.col("_part") == F.col("_p")).withColumn("weight", F.get(weights, F.pmod(F.col("_at") + F.coalesce("_before", F.lit(0)), F.lit(len(cycle))).cast("int")))
    ranked = materialise(ranked.select("source", "source_size", "n_docs", "weight"), "ranked")
    # The level at which weights times level, stopped at each source's most, share everything: it only rises.
    level = 0.0
    while True:
        row = ranked.selectExpr(
            "sum(source_size) as total",
            f"sum(case when weight * {level!r}D > {most} * source_size then {most} * source_size end) as stopped",
            f"sum(case when weight * {level!r}D > {most} * source_size then 0 else weight end) as open",
        ).first()
        if not row.total or not row.open:
            break
        now = (row.total - (row.stopped or 0)) / row.open
        if now <= level:
            break
        level = now
    return ranked.withColumn("target", F.least(F.expr(f"weight * {level!r}D"), F.expr(f"cast({most} * source_size as double)")))


def _draw(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each id."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def fly(p: np.ndarray, z: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Probabilities ``p`` after a flight that keeps sum(p) and sum(p * z): all but two at most are 0 or 1."""
    p = p.astype(np.float64).copy()
    held: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        d = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
        if d == (0, 0, 0):
            d = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, v in zip(held, d):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if u[k] * (up + down) < down else -down
        left = []
        for i, v in zip(held, d):
            p[i] += step * v
            if EPS < p[i] < 1 - EPS:
                left.append(i)
            else:
                p[i] = round(p[i])
        held = left
    return p


def land(p: np.ndarray, z: np.ndarray, u: float) -> np.ndarray:
    """Decides what a last flight left: of the roundings that keep the count to within one, the nearest in words.

    What is still amiss in words is then met by one exchange: a document taken goes for one left out, the pair whose
    difference in size comes nearest. The count stays.
    """
    p = p.copy()
    open_ = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    if not open_:
        return p
    want, n = float((p[open_] * z[open_]).sum()), float(p[open_].sum())
    best = None
    for bits in range(1 << len(open_)):
        on = [i for j, i in enumerate(open_) if bits >> j & 1]
        if not np.floor(n + EPS) <= len(on) <= np.ceil(n - EPS):
            continue
        off = (abs(sum(float(z[i]) for i in on) - want), (bits * 0.618 + u) % 1)
        if best is None or off < best[0]:
            best = (off, on)
    p[open_] = 0
    p[best[1]] = 1
    miss = want - sum(float(z[i]) for i in best[1])
    ins, outs = np.flatnonzero(p > 0.5), np.flatnonzero(p < 0.5)
    if abs(miss) >= 1 and len(ins) and len(outs):
        outs = outs[np.argsort(z[outs], kind="stable")]
        to = z[ins] + miss
        k = np.searchsorted(z[outs], to)
        pairs = [np.clip(k + d, 0, len(outs) - 1) for d in (-1, 0)]
        far = np.stack([np.abs(z[outs[x]] - to) for x in pairs])
        side, i = np.unravel_index(np.argmin(far), far.shape)
        if far[side, i] < abs(miss):
            p[ins[i]], p[outs[pairs[side][i]]] = 0, 1
    return p


def _flights(seed: int, last: bool):
    def run(block: pa.Table) -> pa.Table:
        at = np.lexsort([block[c].to_numpy() for c in ("p", "size", "r")])
        block = block.take(pa.array(at))
        z, u = block["size"].to_numpy().astype(np.float64), _draw(block["r"].to_numpy(), seed)
        p = fly(block["p"].to_numpy(), z, u)
        if last:
            p = land(p, z, float(u[-1]) if len(u) else 0.0)
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix(docs: DataFrame, seed: int = 1, most: int = MOST, block: int = BLOCK, fan: int = FAN, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken, one row for each row of ``docs``."""
    sizes = materialise(slim(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, cycle, most).select(F.col("source").alias("_s"), "source_size", "n_docs", "target")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"_rate": rate, "base": F.floor(rate)})
    rows = rows.withColumn("base", F.when(F.col("_rate") - F.col("base") > 1 - EPS, F.col("base") + 1).otherwise(F.col("base")))
    rows = rows.withColumn("p", F.greatest(F.col("_rate") - F.col("base"), F.lit(0.0))).drop("_rate")
    # Block numbers: as many as the source needs.
    rows = rows.withColumns({"r": F.xxhash64("doc_id", F.lit(seed)), "blocks": F.ceil(F.col("n_docs") / block).cast("long")})
    rows = rows.withColumn("b", F.pmod(F.shiftright("r", 7), "blocks")).drop("n_docs")
    names = ["doc_id", "source", "size", "source_size", "target", "base", "blocks", "r", "b", "p"]
    rows = rows.select(*names)
    schema = rows.schema
    most_blocks = rows.agg(F.max("blocks")).first()[0]
    done = []
    open_ = rows
    level = 0
    while most_blocks is not None:
        last = most_blocks <= 1
        flown = materialise(open_.groupBy("source", "b").applyInArrow(_flights(seed * 1000 + level, last), schema), f"flight{level}")
        undecided = F.expr(f"p > {EPS} and p < 1 - {EPS}")
        done.append(flown if last else flown.filter(~undecided))
        if last:
            break
        open_ = flown.filter(undecided).withColumn("b", F.floor(F.col("b") / fan).cast("long"))
        most_blocks = -(-most_blocks // fan)
        level += 1
    out = done[0] if done else rows
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def keep(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` as the mix takes them: a document taken n times is n rows, one taken no time is gone. All columns stay."""
    key = ["_d", "_s", "_z"]
    taken = mix(docs, seed).filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"))
    taken = materialise(taken.agg(F.sum("copies").alias("_n"), F.count("*").alias("_k")), "taken")
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("_d"), docs["source"].alias("_s"), word_count(docs["text"]).alias("_z"))
    # Texts are dealt by id at every size, so that small and large tables run alike.
    met = rows.join(taken.hint("merge"), F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_src")) & (F.col("_z") == F.col("_size")))
    times = F.col("_n")
    if not taken.filter("_k > 1").isEmpty():  # rows alike share what they are taken
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row.text")))
        met = met.withColumn("_nth", nth)
        times = F.expr("_n div _k + case when _nth <= _n % _k then 1 else 0 end")
    return met.select("row", times.alias("_times")).filter("_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("row.*")
