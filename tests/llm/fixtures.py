"""Small tables for the operators, and the cases that each of them must bear."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or return.
CLASHES = "kept n_words row tie h span score size mark id _id _d _s k nil code component_id copies taken words times labels spans target level bucket v w".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(random.Random(k).choices("abcdefghijklmnop", k=3 + k % 6)) for k in range(words)]
    out = [r.choice(vocabulary) for _ in range(n)]
    return "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(out)).strip()


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, shared lines, junk and short texts in two languages and three sources, one of them null."""
    rows = []
    for i in range(60):
        rows.append((i, prose(i, 60 + 13 * (i % 7)), "en" if i % 3 else "de", ["a", "b", None][i % 3 if i % 5 else 0]))
    passage = prose(900, 60)
    for i in range(60, 70):
        rows.append((i, prose(i, 40) + "\n" + passage + "\n" + prose(i + 500, 30), "en", "a"))
    base = prose(901, 200).split(" ")
    for i in range(70, 85):
        r = random.Random(i)
        near = [w if r.random() > 0.004 * (i - 69) else "edit" + str(r.randrange(9999)) for w in base]
        rows.append((i, " ".join(near), "en", "b"))
    rows += [(85 + k, rows[3][1], "en", "a") for k in range(6)]
    rows += [(91, "$$$ ### &&& " * 40, "en", "a"), (92, "Same line here\n" * 30, "en", "b"), (93, "x y z", "en", "c")]
    return rows


def edges() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one very long word, a very long text, repeated rows, ids that repeat."""
    long = prose(7, 30_000)
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "a", None, "a"), (5, "z" * 50_000, "en", None),
        (6, long, "en", "a"), (7, long, "en", "a"), (8, prose(8, 90), "en", "b"), (8, prose(8, 90), "en", "b"), (9, prose(9, 90), "en", "b"),
        (9, prose(10, 90), "de", "b"), (None, prose(11, 90), "en", "b"), (None, None, None, None), (10, "é ß 世界 \U0001f600 \u0000 \r\n", "de", "c"),
        (-3, "tie tie tie tie", "en", "c"), (-4, "tie tie tie tie", "en", "c"),
    ]


def clashing(df):
    """``df`` with further columns whose names operators use."""
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES if c not in df.columns])


def rows_of(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))
