"""Quality rules with adaptive thresholds [native].

A few counts are taken of every text. For each language and source a mergeable quantile sketch of each ratio
is kept: a histogram over log-linear buckets (exact below 32, then 16 buckets for each power of two, so a
quantile is off by less than 1/16 of its value). Sketches merge by adding counts, which Spark does on the map
side, so a source that holds a third of all rows is no hot group. Quartiles of the sketch give the fences
``q3 + reach * spread`` and, for word length, ``q1 - reach * spread``, with spread ``max(q3 - q1, least)``.
Groups of fewer than ``least_rows`` documents use the merged sketch of their language, and if that is small
too, that of all rows. Fences are joined back to the counts by language and source, and decide.

Null or empty text: no words, all counts 0, fails the base rule. Null language or source: a group of its own.
Repeated rows are judged each by itself and count each in the sketches. Empty table: empty result. Other
columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise, packed, slim

#: Ratio: (SQL over the counts, least spread, also a lower fence).
RATIOS = {
    "symbols": ("n_symbols * 1000 div word_chars", 40, False),
    "length": ("word_chars * 10 div n_words", 10, True),
    "lines": ("n_dup_lines * 1000 div n_lines", 75, False),
    "repeats": ("n_repeat_words * 1000 div n_words", 100, False),
}
REACH, LEAST_ROWS = 4, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    n_repeat_words: words inside three-word windows that the text holds twice or more. The windows of one text are
    sorted by hash within the row; equal neighbours are repeats, and each start covers up to the next start.
    """
    words = docs.withColumns({
        "_t": F.coalesce(F.col(text), F.lit("")),
        "_w": F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), F.array().cast("array<string>")),
    })
    windows = words.withColumns({
        "n_words": F.expr("cast(size(_w) as bigint)"),
        "word_chars": F.expr("cast(char_length(array_join(_w, '')) as bigint)"),
        "n_symbols": F.expr("cast(char_length(_t) - char_length(translate(_t, '#*$%&|<>', '')) as bigint)"),
        "_l": F.expr(r"filter(split(_t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        "_win": F.expr(
            "case when size(_w) > 2 then transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) "
            "else cast(array() as array<bigint>) end"
        ),
    })
    sorted_ = windows.withColumns({
        "n_lines": F.expr("cast(size(_l) as bigint)"),
        "n_dup_lines": F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)"),
        "_s": F.expr(
            "case when size(_win) > size(array_distinct(_win)) then sort_array(transform(_win, (h, i) -> struct(h, i))) "
            "else cast(array() as array<struct<h:bigint,i:int>>) end"
        ),
    })
    starts = sorted_.withColumn(
        "_p",
        F.expr(
            "case when size(_s) = 0 then cast(array() as array<int>) else sort_array(transform(filter(_s, (x, j) -> "
            "(j > 0 and _s[greatest(j - 1, 0)].h = x.h) or (j < size(_s) - 1 and _s[least(j + 1, size(_s) - 1)].h = x.h)), "
            "x -> x.i)) end"
        ),
    )
    covered = F.expr(
        "cast(aggregate(transform(_p, (p, j) -> case when j = size(_p) - 1 then 3 else least(3, _p[least(j + 1, size(_p) - 1)] - p) end), "
        "0, (a, x) -> a + x) as bigint)"
    )
    return starts.withColumn("n_repeat_words", covered).drop("_t", "_w", "_win", "_l", "_s", "_p")


def base_failed():
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _bucket(x: str) -> str:
    """Lower edge of the log-linear bucket of a count."""
    shift = f"greatest(length(bin({x})) - 5, 0)"
    return f"shiftleft(shiftright({x}, {shift}), {shift})"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) of all rows that have the ratio."""
    ratios = measured.select("lang", "source", *[F.expr(f"nullif(n_words, 0) * 0 + ({_div(sql)})").alias(k) for k, (sql, _, _) in RATIOS.items()])
    long = ratios.selectExpr("lang", "source", f"stack({len(RATIOS)}, {', '.join(f'{k!r}, {k}' for k in RATIOS)}) as (ratio, x)").filter("x is not null")
    return long.groupBy("lang", "source", "ratio", F.expr(_bucket("x")).alias("bucket")).agg(F.count("*").alias("n"))


def _div(sql: str) -> str:
    over, by = sql.split(" div ")
    return f"({over}) div nullif({by}, 0)"


def merge(sketch: DataFrame) -> DataFrame:
    """Adds the merged sketches of each language (level 1) and of all rows (level 2) to those of the groups (level 0)."""
    none = F.lit(None).cast("string")
    levels = [sketch.withColumn("level", F.lit(0))]
    for level, lang in ((1, F.col("lang")), (2, none)):
        levels.append(sketch.groupBy(lang.alias("lang"), none.alias("source"), "ratio", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level)))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def fences(sketch: DataFrame, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, <ratio>_low, <ratio>_high): fences of each group, from the first level with enough rows."""
    merged = merge(sketch)
    ranked = merged.selectExpr(
        "*",
        "sum(n) over (partition by level, lang, source, ratio) as total",
        "sum(n) over (partition by level, lang, source, ratio order by bucket) as upto",
    )
    quartiles = ranked.groupBy("level", "lang", "source", "ratio").agg(
        F.max("total").alias("total"),
        F.expr("min(case when upto * 4 >= total then bucket end)").alias("q1"),
        F.expr("min(case when upto * 4 >= 3 * total then bucket end)").alias("q3"),
    )
    groups = sketch.select("lang", "source", "ratio").distinct()
    tries = groups.selectExpr(
        "lang", "source", "ratio",
        "explode(array(named_struct('level', 0, 'l', lang, 's', source), named_struct('level', 1, 'l', lang, 's', cast(null as string)), "
        "named_struct('level', 2, 'l', cast(null as string), 's', cast(null as string)))) as t",
    )
    q = quartiles.select("level", F.col("lang").alias("ql"), F.col("source").alias("qs"), F.col("ratio").alias("qr"), "total", "q1", "q3")
    known = tries.join(
        q,
        (F.col("t.level") == q.level) & F.col("t.l").eqNullSafe(q.ql) & F.col("t.s").eqNullSafe(q.qs) & (F.col("ratio") == q.qr),
    )
    usable = (F.col("level") == 2) | (F.col("total") >= least_rows)
    first = known.filter(usable).groupBy("lang", "source", "ratio").agg(F.min(F.struct("level", "q1", "q3")).alias("q"))
    least = "case ratio " + " ".join(f"when '{k}' then {v[1]}" for k, v in RATIOS.items()) + " end"
    fence = first.selectExpr("lang", "source", "ratio", "q.q1", "q.q3", f"{reach} * greatest(q.q3 - q.q1, {least}) as far")
    cols = []
    for k, (_, _, low) in RATIOS.items():
        if low:
            cols.append(F.expr(f"max(case when ratio = '{k}' then q1 - far end)").alias(f"{k}_low"))
        cols.append(F.expr(f"max(case when ratio = '{k}' then q3 + far end)").alias(f"{k}_high"))
    return fence.groupBy("lang", "source").agg(*cols)


def verdict(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. ``limits`` has one row for each language and source."""
    lim = limits.select(F.col("lang").alias("_fl"), F.col("source").alias("_fs"), *[F.col(c).alias(f"_{c}") for c in limits.columns[2:]])
    joined = measured.join(lim, F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs")), "left")
    beyond = F.lit(False)
    for k, (sql, _, low) in RATIOS.items():
        over, by = sql.split(" div ")
        x = F.expr(f"({over}) div nullif({by}, 0)")
        beyond = beyond | F.coalesce(x > F.col(f"_{k}_high"), F.lit(False))
        if low:
            beyond = beyond | F.coalesce(x < F.col(f"_{k}_low"), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~beyond}).drop(*lim.columns)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept, one row for each row of ``docs``."""
    measured = materialise(counts(slim(docs, "doc_id", "lang", "source", "text")).drop("text"), "quality")
    limits = materialise(fences(sketches(measured)), "fences")
    return verdict(measured, limits)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rows = packed(docs).withColumns({"lang": F.col("row.lang"), "source": F.col("row.source"), "text": F.col("row.text")})
    measured = materialise(counts(rows).drop("text"), "quality")
    limits = materialise(fences(sketches(measured)), "fences")
    return verdict(measured, limits).filter("kept").select("row.*")
