"""MinHash near-dedup with tensored banding.

A document is the set of its distinct word shingles (64-bit hashes). Equal sets collapse to their smallest doc_id. Two
collections of ``SIDE`` half keys, each of ``HALF`` minhashes, are computed; every pair (left, right) is one table, so
SIDE * SIDE tables of 2 * HALF minhashes cost 2 * SIDE * HALF minhashes. A pair at the threshold meets with
probability (1 - (1 - t^HALF)^SIDE)^2, 0.99998 for t = 0.8. A half key that one document alone has can't make a
table key that two have, so halves are counted first and only shared ones are paired.

In every bucket the member whose half keys are shared most (the middle of a group of copies) is the pivot; the others
are verified against it on their full sets. A bucket whose members are not one component yet goes on: its pairs
across components are verified too, unless a prefix filter (exact for the threshold) rules a link out. So no group
makes all its pairs, and no candidate is skipped unseen.

Null or empty text, or no words: empty set, linked with nothing. Null doc_id: never linked, component null, kept.
Repeated doc_id: each row has the component of its own set; sets whose smallest doc_id is the same are one node.
Empty table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing as H
from tidemark.llm.common import materialise, slim, text_batches, text_bytes
from tidemark.llm.components import components

SIDE, HALF = 16, 3


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    raw = H.LOWER[raw]
    start, end, text = H.words(raw, off)
    out = [np.zeros(0, np.uint64)] * (len(off) - 1)
    if not len(start):
        return out
    h = H.stretch(H.prefix(raw), start, end)
    n = np.bincount(text, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    odd = np.uint64(0xA0761D6478BD642F)
    rolled = h.copy()
    for j in range(1, k):
        rolled[: len(h) - j] = rolled[: len(h) - j] * odd + h[j:] if len(h) > j else rolled[:0]
    rolled = H.mix(rolled)
    for d in np.flatnonzero(n):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            out[d] = np.unique(rolled[a : b - k + 1])
        else:
            x = np.uint64(b - a)
            for v in h[a:b]:
                x = H.mix(np.array([x * odd + v], np.uint64))[0]
            out[d] = np.array([x], np.uint64)
    return out


def _signatures(k: int, side: int, half: int, seed: int = 7):
    rng = np.random.default_rng(seed)
    n = 2 * side * half
    mul = rng.integers(1, 2**63, n, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 2**63, n, dtype=np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in text_batches(batches):
                sets = shingle_sets(*text_bytes(batch.column(1)), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                has = np.flatnonzero(sizes)
                keys = np.zeros((len(has), 2 * side), np.uint64)
                if len(has):
                    flat, at = np.concatenate([sets[i] for i in has]), np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
                    for j in range(n):
                        low = np.minimum.reduceat(flat * mul[j] + add[j], at)
                        keys[:, j // half] = H.mix(keys[:, j // half] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(j // half + 1))
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[1:][has] = 2 * side
                halves = pa.ListArray.from_arrays(np.cumsum(ends).astype(np.int32), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(marks, pa.binary()), halves], names=["doc_id", "n_shingles", "mark", "halves"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in text_batches(batches):
                sets = shingle_sets(*text_bytes(batch.column(1)), k)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["id", "members"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = np.concatenate([x, y])
            both.sort()
            found.append((len(x), len(y), int((both[1:] == both[:-1]).sum())))
        found = np.array(found, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, i]) for i in range(3)]], names=["x", "y", "nx", "ny", "common"])


def _verify(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(x, y, nx, ny, common) of pairs (x, y), by their full sets."""
    a, b = sets.select(F.col("id").alias("_a"), F.col("members").alias("xs")), sets.select(F.col("id").alias("_b"), F.col("members").alias("ys"))
    met = pairs.join(a, F.col("x") == F.col("_a")).join(b, F.col("y") == F.col("_b")).select("x", "y", "xs", "ys")
    return materialise(met.mapInArrow(_overlaps, "x long, y long, nx long, ny long, common long"), name)


def _prefix_pairs(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): every pair of ``docs`` (rep, n, comp) of two components that can be a link.

    Sets that share ``percent`` of their union share one of their n - ceil(n * percent / 100) + 1 rarest members. So a
    document with more members of its own than that meets nobody, and members that one component alone has are skipped. From
the rarest member in common on, both must still hold what a link needs.
    """
    members = docs.join(sets, F.col("rep") == F.col("id")).select("rep", "n", "comp", F.explode("members").alias("m"))
    rare = members.groupBy("m").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).select(F.col("m").alias("rm"), "df", "lo", "hi")
    ranked = members.join(rare, F.col("m") == F.col("rm")).groupBy("rep", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "m", "lo", "hi"))).alias("all"))
    prefix = ranked.selectExpr("rep", "n", "comp", f"posexplode(slice(all, 1, cast(n - ceil(n * {percent} / 100) + 1 as int))) as (pos, e)")
    prefix = prefix.filter("e.lo <> e.hi").selectExpr("rep", "n", "comp", "e.m", "e.lo", "n - pos as left")
    prefix = materialise(prefix, "prefix")
    a = prefix.filter("comp <> lo").selectExpr("rep as x", "n as nx", "comp as cx", "m", "left as lx")
    b = prefix.selectExpr("rep as y", "n as ny", "comp as cy", "m", "left as ly")
    met = a.join(b, "m").filter(f"cx <> cy and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    met = met.filter(f"{100 + percent} * least(lx, ly) >= {percent} * (nx + ny)")
    return met.selectExpr("least(x, y) as x", "greatest(x, y) as y").distinct()


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, side: int = SIDE, half: int = HALF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of ``docs``."""
    text = slim(docs, "doc_id", "text")
    sig = text.mapInArrow(_signatures(k, side, half), "doc_id long, n_shingles long, mark binary, halves array<long>")
    sig = materialise(sig, "signatures")
    known = sig.filter("doc_id is not null and n_shingles > 0")
    reps = materialise(known.groupBy("mark").agg(F.min("doc_id").alias("rep")), "reps")
    halves = known.join(reps.select(F.col("mark").alias("_m"), F.col("rep")), (F.col("doc_id") == F.col("rep")) & (F.col("mark") == F.col("_m")))
    halves = halves.select("rep", F.col("n_shingles").alias("n"), F.posexplode("halves").alias("pos", "h"))
    shared = halves.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1")
    met = halves.join(shared, "h")
    sides = met.groupBy("rep", "n").agg(
        F.sum("times").alias("support"),
        F.array_sort(F.collect_set(F.expr(f"case when pos < {side} then h end"))).alias("lefts"),
        F.array_sort(F.collect_set(F.expr(f"case when pos >= {side} then h end"))).alias("rights"),
    )
    tables = sides.selectExpr("rep", "n", "support", "explode(flatten(transform(lefts, l -> transform(rights, r -> xxhash64(l, r))))) as t")
    tables = materialise(tables, "tables")
    pivots = tables.groupBy("t").agg(F.count("*").alias("times"), F.max(F.struct("support", (-F.col("rep")).alias("minus"), "n")).alias("top")).filter("times > 1")
    pivots = materialise(pivots.selectExpr("t", "-top.minus as pivot", "top.n as np"), "pivots")
    stars = tables.join(pivots, "t").filter("rep <> pivot").select("rep", "n", "pivot", "np").distinct()
    stars = materialise(stars, "stars")
    near = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    linked = f"100 * common >= {percent} * (nx + ny - common)"
    first = stars.filter(near.format("n", "np")).selectExpr("rep as x", "pivot as y")
    involved = stars.selectExpr("explode(array(rep, pivot)) as i").distinct()
    ids = materialise(involved, "involved")
    held = text.join(ids, F.col("doc_id") == F.col("i")).select("doc_id", "text")
    sets = materialise(held.mapInArrow(_sets(k), "id long, members array<long>"), "sets")
    against = _verify(first, sets, "against")
    links = against.filter(linked).selectExpr("x as a", "y as b")
    comps = materialise(components(links), "components")
    # What is left: members of buckets that hold more than one component, buckets of one pivot taken together.
    named = stars.join(comps.selectExpr("node as rn", "component as rc"), F.col("rep") == F.col("rn"), "left")
    named = named.selectExpr("pivot", "rep", "n", "coalesce(rc, rep) as comp")
    split = named.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("pivot")
    open_ = materialise(named.join(split, "pivot", "left_semi").select("rep", "n", "comp").distinct(), "open")
    more = materialise(_prefix_pairs(open_, sets, percent), "more")
    if not more.isEmpty():
        extra = _verify(more, sets, "rest").filter(linked).selectExpr("x as a", "y as b")
        links = comps.filter("node <> component").selectExpr("node as a", "component as b").unionByName(extra)
        comps = materialise(components(links), "components")
    named = reps.join(comps, F.col("rep") == F.col("node"), "left").selectExpr("mark", "coalesce(component, rep) as c")
    named = named.withColumnRenamed("mark", "_m")
    rows = sig.join(named, (F.col("mark") == F.col("_m")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    out = rows.selectExpr("doc_id", "n_shingles", "coalesce(c, doc_id) as component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that are near copies of one with a smaller doc_id in their component. All columns stay.

    Rows with equal doc_id stay or go together: they stay if one of them is kept.
    """
    ids = near_duplicates(docs, k, percent).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("_d"))
    # Texts are dealt by id at every size, so that small and large tables run alike.
    return rows.join(materialise(ids, "kept").hint("merge"), F.col("_d").eqNullSafe(F.col("_id")), "left_semi").select("row.*")
