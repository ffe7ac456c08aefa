"""Line dedup by content-defined chunks of lines [native].

Each line is hashed; a rolling hash over the last ``WINDOW`` line hashes is taken at every line; a chunk ends where
that hash is smaller than at both neighbours. So boundaries hang on a few lines around them and shift with the
text; chunks have two lines or more, three on average. A second, finer chunking takes two lines wherever their rolling hash is no
multiple of ``SPARE``, which hangs on these two lines alone, so that passages too short to hold a whole chunk are met
too. Chunks are counted over all documents by hash and length; of those seen
more than once, all but the first (smallest doc_id, then text hash, then line) are compared byte by byte with
the first and removed if equal; a fine chunk inside a repeated coarse one is left to that. A removed chunk grows by the line before and the line after where
these equal those of the first occurrence. So of a passage of m lines that two documents share all lines go but with
a chance of about 1 in 4 for two lines, 1 in 16 for three, and less from there on. Single lines are never removed by themselves.

Only (hash, length, id, line) of each chunk is shuffled to find repeats; text follows for the repeats alone and
for the documents themselves, by id. Counting combines on the map side and the join that follows is one that Spark
splits when skewed, so a chunk that a third of all documents hold is no hot group.

Null text: null, no lines. Documents of one line, and chunks without a word: never removed. Rows with equal doc_id
and text are one occurrence: neither removes the other. Empty table: empty result. Other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_repeat, materialise, with_tie

WINDOW, SPARE = 2, 4


def _chunks(docs: DataFrame, window: int) -> DataFrame:
    """``docs`` with _l (lines), _c (chunks of two lines or more: start, n) and _f (fine chunks)."""
    lines = docs.withColumn("_l", F.split("text", "\n", -1))
    hashes = lines.withColumn("_h", F.expr("transform(_l, x -> xxhash64(x))"))
    rolled = hashes.withColumn(
        "_r",
        F.expr(f"transform(_h, (h, i) -> aggregate(slice(_h, greatest(i - {window - 2}, 1), least(i + 1, {window})), 0L, (a, x) -> xxhash64(a, x)))"),
    )
    starts = rolled.withColumn(
        "_b",
        F.expr(
            "case when size(_r) >= 4 then concat(array(0), transform(filter(sequence(1, size(_r) - 3), "
            "i -> _r[i] < _r[i - 1] and _r[i] < _r[i + 1]), i -> i + 1)) when size(_r) > 0 then array(0) end"
        ),
    )
    coarse = "filter(transform(_b, (b, k) -> struct(b as start, case when k = size(_b) - 1 then size(_l) else _b[k + 1] end - b as n)), c -> c.n > 1)"
    pair = "xxhash64(xxhash64(0L, _h[i - 1]), _h[i])"
    fine = f"case when size(_h) > 1 then transform(filter(sequence(1, size(_h) - 1), i -> pmod({pair}, {SPARE}) <> 0), i -> struct(i - 1 as start, 2 as n)) end"
    return starts.withColumns({"_c": F.expr(coarse), "_f": F.expr(fine)}).drop("_r", "_b", "_h")


def _text_of(lines: str, start: str, n: str) -> str:
    return f"array_join(slice({lines}, {start} + 1, {n}), '\\n')"


def chunk_table(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tie, start, n, h, len, fine) of every multi-line chunk that has a word."""
    every = "concat(transform(_c, c -> struct(c.start, c.n, false as fine)), transform(array_except(coalesce(_f, cast(array() as array<struct<start:int,n:int>>)), _c), c -> struct(c.start, c.n, true as fine)))"
    long = _chunks(keyed, window).withColumn("_c", F.expr(every))
    long = long.selectExpr("doc_id", "tie", f"inline(transform(_c, c -> struct(c.start, c.n, c.fine, {_text_of('_l', 'c.start', 'c.n')} as s)))")
    return long.filter(r"s rlike '[^\\x20\\x09-\\x0D]'").selectExpr("doc_id", "tie", "start", "n", "xxhash64(s) as h", "octet_length(s) as len", "fine")


def _same_rows():
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))


def removals(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _tie, repeats: array of (start, n, s, before, after)): the chunks of each document that may go, each with the bytes of its first occurrence and of
    the lines around that."""
    chunks = materialise(chunk_table(keyed, window), "chunks")
    repeated = chunks.groupBy("h", "len").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tie", "start", "n")).alias("first")).filter("times > 1")
    repeated = materialise(repeated.drop("times"), "repeated")
    later = chunks.join(repeated, ["h", "len"]).filter(~F.struct("doc_id", "tie", "start", "n").eqNullSafe(F.col("first"))).drop("first")
    # Fine chunks inside a coarse one that repeats need no text of their own.
    met = later.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n", "h", "len", "fine")).alias("met"))
    needed = "filter(met, c -> not c.fine or not exists(coarse, w -> w.start <= c.start and c.start + c.n <= w.start + w.n))"
    later = met.withColumn("coarse", F.expr("filter(met, c -> not c.fine)")).selectExpr("doc_id", "tie", f"inline({needed})").drop("fine")
    owners = repeated.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie")).agg(F.collect_list(F.struct("h", "len", "first.start", "first.n")).alias("own"))
    text = keyed.select("doc_id", "tie", "text")
    around = "get(_l, c.start - 1) as before, get(_l, c.start + c.n) as after"
    firsts = (
        text.join(owners, _same_rows())
        .selectExpr("split(text, '\\n', -1) as _l", "array_distinct(own) as own")
        .selectExpr(f"inline(transform(own, c -> struct(c.h as fh, c.len as flen, {_text_of('_l', 'c.start', 'c.n')} as s, {around})))")
    )
    held = later.join(firsts, (later.h == firsts.fh) & (later.len == firsts.flen))
    return held.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("start", "n", "s", "before", "after")).alias("repeats"))


def _stripped(joined: DataFrame) -> DataFrame:
    """n_lines, n_spans, n_removed and kept_text from ``text`` and ``repeats``."""
    lines = joined.withColumn("_l", F.split("text", "\n", -1))
    # Without a line there, or with another one, a chunk doesn't grow.
    grown = "if(coalesce(get(_l, c.start - 1) = c.before, false), 1, 0) as up, if(coalesce(get(_l, c.start + c.n) = c.after, false), 1, 0) as down"
    equal = lines.withColumn("_e", F.expr(f"array_distinct(transform(filter(repeats, c -> c.s = {_text_of('_l', 'c.start', 'c.n')}), c -> struct(c.start, c.n, {grown})))"))
    gone = equal.withColumn("_g", F.expr("coalesce(array_distinct(flatten(transform(_e, c -> sequence(c.start - c.up, c.start + c.n - 1 + c.down)))), cast(array() as array<int>))"))
    return gone.withColumns({
        "n_lines": F.expr("cast(coalesce(size(_l), 0) as bigint)"),
        "n_chunks_removed": F.expr("cast(coalesce(size(_e), 0) as bigint)"),
        "n_removed": F.expr("cast(size(_g) as bigint)"),
        "kept_text": F.expr("case when size(_g) = 0 then text else array_join(transform(array_except(sequence(0, size(_l) - 1), _g), i -> _l[i]), '\\n') end"),
    }).drop("_l", "_e", "_g")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_chunks_removed, n_removed (lines), text (what is left), one row for each row of ``docs``."""
    keyed = with_tie(docs)
    gone = removals(keyed, window)
    out = _stripped(keyed.join(gone, _same_rows(), "left"))
    return out.select("doc_id", "n_lines", "n_chunks_removed", "n_removed", F.col("kept_text").alias("text"))


def keep(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``; rows of which nothing is left go. All columns stay."""
    repeat = ids_repeat(docs)
    if repeat:
        rows = with_tie(docs, whole=True, repeat=True)
        out = _stripped(rows.join(removals(rows, window), _same_rows(), "left"))
    else:
        # Texts go through one shuffle, which finding first occurrences uses too; the other columns join them after.
        keyed = with_tie(docs, repeat=False)
        cut = _stripped(keyed.join(removals(keyed, window), _same_rows(), "left")).select("doc_id", "n_lines", "n_removed", "kept_text")
        rest = docs.select(docs["doc_id"].alias("_d"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"))
        out = cut.join(rest.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")))
    left = out.filter("n_removed = 0 or n_removed < n_lines")
    return left.select(*[F.col("kept_text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
