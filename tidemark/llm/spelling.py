"""Spelling variants by dense prefix-suffix tiling.

Words are counted in Spark. Two words one edit apart have a common prefix and a common suffix that together reach the longer
length less one, so one of the two reaches half of the longer length. Each word therefore stands, for the longer lengths it
can meet (its own and one more), under its leading half and under its trailing half. Words under one half are laid into tiles
of at most about ``TILE`` rows: small groups share a tile, a large group is dealt over several and all pairs of these are
compared, each in a task of its own. A task lays the code points into padded matrices, from the front and from the
back, finds the pairs with an equal half, and adds the lengths of common prefix and suffix. A pair with equal leading halves
counts there, any other one where its trailing halves are equal, so none counts twice. A task returns, for each word, how many near words it
found and the best of them, never the pairs; tile and matrix sizes are bounded in code points, so long words make small tiles.

Forms are chained by pointer doubling: n grows tenfold with each step, so chains are short.

Null or empty texts hold no words. A null doc_id is written as nothing before the colon. Repeated rows are documents of their
own. Very long runs are words like others. Ties between near words of equal n: the smallest in code-point order. Empty table:
empty result. Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slim

RUN = "[A-Za-zÀ-ÿ]"
LEAST, TILE, CELLS, PAIRS = 7, 1024, 1 << 20, 1 << 16
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least: int = LEAST, often: int = 2, every: int = 31) -> DataFrame:
    """word, n: lower-cased runs of ``least`` code points or more that occur ``often`` times, one in ``every`` short of a code point."""
    # A shorter run can't become a word.
    runs = slim(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _SMALL)).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % char_length(run) as int)")
    short = F.concat(F.expr("left(run, cast(h % char_length(run) as int))"), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).filter(F.char_length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _matrix(col: list[bytes], width: int) -> np.ndarray:
    """Code points, padded with zeros; all are below 256, so a byte is one."""
    return np.array(col, f"S{width}").view(np.uint8).reshape(len(col), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of a and b; padding equals nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], np.argmin(same, 1))


def near_pairs(a: list[bytes], b: list[bytes], width: int, leading: bool, same: bool):
    """(i, j) of words one edit apart, the longer of ``width`` code points, whose leading (or only whose trailing) halves are equal."""
    half = width // 2
    left, right = _matrix(a, width), _matrix(b, width)
    back, front = _matrix([w[::-1] for w in a], width), _matrix([w[::-1] for w in b], width)
    la, lb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    key_a, key_b = (left, right) if leading else (back, front)
    ids = np.unique(np.concatenate([key_a[:, :half], key_b[:, :half]]).copy().view(f"S{half}").ravel(), return_inverse=True)[1]
    ids_a, ids_b = ids[: len(a)], ids[len(a) :]
    step = max(1, CELLS * 4 // max(1, len(b)))
    for at in range(0, len(a), step):
        to = min(len(a), at + step)
        meet = ids_a[at:to, None] == ids_b[None, :]
        meet &= np.maximum(la[at:to, None], lb[None, :]) == width
        i, j = np.nonzero(meet)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        chunk = max(1, PAIRS * 64 // width)
        for k in range(0, len(i), chunk):
            x, y = i[k : k + chunk], j[k : k + chunk]
            head, tail = _common(left[x], right[y]), _common(back[x], front[y])
            ok = head + tail >= width - 1
            if not leading:
                ok &= head < half
            yield x[ok], y[ok]


def _compare(unit: pa.Table) -> pa.Table:
    width, leading = unit["width"][0].as_py(), unit["leading"][0].as_py()
    word = [w.encode("latin-1") for w in unit["word"].to_pylist()]
    n, second = unit["n"].to_numpy(), unit["second"].to_numpy(zero_copy_only=False)
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    same = unit["a"][0].as_py() == unit["b"][0].as_py()
    b = a if same else b
    found = list(near_pairs([word[k] for k in a], [word[k] for k in b], width, leading, same)) if len(a) and len(b) else []
    x = a[np.concatenate([p for p, _ in found])] if found else np.zeros(0, int)
    y = b[np.concatenate([q for _, q in found])] if found else np.zeros(0, int)
    one, two = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.empty(len(word), int)
    rank[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
    order = np.lexsort((rank[two], -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.zeros(0, int)
    many = np.diff(np.r_[first, len(one)]) if len(one) else first
    text = lambda at: pa.array([word[k].decode("latin-1") for k in at.tolist()], pa.string())
    return pa.table({"word": text(one[first]), "n_near": pa.array(many, pa.int64()), "best_n": pa.array(n[two[first]], pa.int64()), "best": text(two[first])})


def _units(found: DataFrame, tile: int) -> DataFrame:
    """(width, leading, g, a, b, second, word, n): every word in every unit of work that it takes part in."""
    size = F.char_length("word")
    rows = found.select("word", "n", size.alias("len"), F.explode(F.array(size, size + 1)).alias("width")).withColumn("leading", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("g", F.expr("xxhash64(width, leading, if(leading, left(word, width div 2), right(word, width div 2)))"))
    fits = F.expr(f"greatest(1, least({tile}, {CELLS} div width))")
    groups = rows.groupBy("width", "leading", "g").agg(F.count("*").alias("members"), F.count_if(F.col("len") == F.col("width")).alias("full")).filter("members > 1 and full > 0")
    groups = materialise(groups.withColumn("tiles", F.ceil(F.col("members") / fits)).drop("full"), "groups")
    small = groups.filter("tiles = 1").groupBy("width", "leading").agg(F.sum("members").alias("all_members"))
    small = small.select("width", "leading", F.ceil(2 * F.col("all_members") / fits).alias("buckets"))
    groups = groups.join(small, ["width", "leading"], "left").select("width", "leading", "g", "tiles", F.coalesce("buckets", F.lit(1)).alias("buckets"))
    rows = rows.join(groups, ["width", "leading", "g"])
    packed = rows.filter("tiles = 1").selectExpr("width", "leading", "pmod(g, buckets) as g", "-1L as a", "-1L as b", "false as second", "word", "n")
    dealt = rows.filter("tiles > 1").withColumn("mine", F.expr("pmod(xxhash64(word, 1), tiles)")).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    dealt = dealt.selectExpr("width", "leading", "g", "least(mine, other) as a", "greatest(mine, other) as b", "mine > other as second", "word", "n")
    return packed.unionByName(dealt)


def near_words(found: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best (struct of -n and word: the near word of largest n) of words (word, n) that have a near word."""
    parts = _units(found, tile).groupBy("width", "leading", "g", "a", "b").applyInArrow(_compare, "word string, n_near long, best_n long, best string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling steps. A word has one form, and n grows along forms."""
    at = materialise(forms.selectExpr("word", "form as root"), "roots")
    while True:
        ends = at.select("root").distinct()
        on = at.join(ends.withColumnRenamed("root", "_e"), F.col("word") == F.col("_e"), "left_semi").selectExpr("word as _w", "root as _r")
        on = materialise(on, "onward")
        if on.isEmpty():
            return at
        at = materialise(at.join(on, F.col("root") == F.col("_w"), "left").selectExpr("word", "coalesce(_r, root) as root"), "roots")


def variants(docs: DataFrame, ratio: int = 10, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text)."""
    found = materialise(words(docs), "words")
    near = near_words(found, tile).withColumnRenamed("word", "_w")
    known = found.join(near, F.col("word") == F.col("_w"), "left")
    has = F.expr(f"-best.minus_n >= {ratio} * n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.minus_n")).alias("form_n"))
    known = materialise(known, "near")
    ends = roots(known.filter("form is not null").select("word", "form")).selectExpr("word as _w", "root")
    return known.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
