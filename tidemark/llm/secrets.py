"""Secret scans: fixed patterns, and password guess cost of values in credential context.

The base rule finds three kinds of spans in every whole text, leftmost and non-overlapping within a kind: ``assign`` (a
credential name, a sign, a value of six characters or more), ``access`` (access key ids) and ``hex`` (runs of 24 hex digits
or more). The method adds ``guess`` spans: values of any signs that follow the same or further credential words and would take an
attacker ``10 ** LEAST`` guesses or more. The cost of a value is the least over all ways to cut it into dictionary
words, dates, repeats, keyboard walks, sequences and brute-forced characters, found by dynamic programming from left to right; the
longest piece looked back to is bounded but for repeats and walks, which are found as runs, so the work is linear in the value.
Values of ``assign`` spans are scored alike, telling placeholders from real secrets.

Places count code points. Null text: empty. Row by row, whole texts, no shuffle; repeated rows are judged each by itself. Empty
table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slim, text_batches

# The patterns of the base rule.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A plain word, as prose has it: letters in one case or with a capital first, parts joined by - / or ', and the signs around it.
_PLAIN = r"""[-/("']*(?:[A-Za-z]?[a-z]+|[A-Z]+)(?:[-/'](?:[A-Za-z]?[a-z]+|[A-Z]+))*[\]).,:;!?"']*(?:\s|$)"""
#: Words after which a value is a credential: those of ``assign``, with a sign or ``is``, and others, with either or before what is no plain word.
_BASE_WORDS = "password|passwd|secret|token|api_?key"
_MORE_WORDS = "pwd|passphrase|passcode|credentials?|bearer|authorization|access_?key|private_?key|signing_?key|session_?id"
CONTEXT = re.compile(
    rf"""(?:(?i:{_BASE_WORDS}|{_MORE_WORDS})["']?\x20*(?:[:=]|\b(?i:is)\b)\x20*|(?i:{_MORE_WORDS})\b["']?\x20*(?![:=]|{_PLAIN}))["']?([^\s"'<>]{{8,}})""", re.A
)
#: A value that ends in a credential word and its sign, whose own value comes next.
_NEXT = re.compile(rf"""(?:{_BASE_WORDS}|{_MORE_WORDS})[:=]?$""", re.I | re.A)
_CONTEXT = _NAMES + (b"pwd", b"passphrase", b"passcode", b"credential", b"bearer", b"authorization", b"accesskey", b"access_key", b"privatekey", b"private_key", b"signingkey", b"signing_key", b"sessionid", b"session_id")
LEAST = 10.0

# Words that guessers try first, most common first.
COMMON = (
    "password admin secret test example changeme user root guest default login welcome letmein dragon monkey master "
    "shadow sunshine princess football baseball iloveyou superman batman trustno summer winter spring autumn hello "
    "access pass token key demo sample dummy placeholder your my the here insert replace none null true false "
    "company server service client api app dev prod staging public private local host"
).split()
# Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")


def _neighbours() -> dict[str, set[str]]:
    """Keys beside each key: left and right, and the two above and below."""
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {a: {b for b, (s, j) in at.items() if a != b and abs(r - s) <= 1 and -1 <= j - k <= 1 and (j - k) * (s - r) <= 0} for a, (r, k) in at.items()}


BESIDE = _neighbours()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
#: Guesses, as powers of ten, that each further piece costs.
JOIN = 0.3


def _alphabet(value: str) -> int:
    """How many characters a brute force over the value's classes tries."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 10 if value.isdigit() else 16
    n = 0
    for pattern, size in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (r"[^A-Za-z0-9]", 33)):
        n += size if re.search(pattern, value) else 0
    return max(n, 2)


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of the guesses, pieces (kind, start, end)) of the cheapest cut of ``value``."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = value
    each = math.log10(_alphabet(value))
    ends: dict[int, list[tuple[int, float, str]]] = {}

    def piece(start: int, end: int, cost: float, kind: str) -> None:
        ends.setdefault(end, []).append((start, cost, kind))

    for i in range(n):
        for size in range(2, min(LONGEST, n - i) + 1):
            rank = RANK.get(low[i : i + size])
            if rank:
                part = value[i : i + size]
                piece(i, i + size, math.log10(rank + 1) + (0 if part == low[i : i + size] else math.log10(2 if part.isupper() or part.istitle() else 2**size)), "word")
        m = _DATE.match(value, i)
        if m:
            piece(i, m.end(), math.log10(120 * (1 if m.end() - i == 4 else 365)) + (0.6 if m[1] or m[2] else 0), "date")
    for kind, joins in (
        ("repeat", lambda a, b: a == b),
        ("walk", lambda a, b: b in BESIDE.get(a, ())),
        ("sequence", lambda a, b: abs(ord(a) - ord(b)) == 1),
    ):
        i = 0
        while i < n - 1:
            j = i
            while j + 1 < n and joins(low[j], low[j + 1]):
                j += 1
            if j - i >= 2:
                size = j - i + 1
                cost = {"repeat": each + math.log10(size), "walk": math.log10(40) + (size - 1) * math.log10(2.3), "sequence": math.log10(8 * size)}[kind]
                piece(i, j + 1, cost, kind)
            i = max(j, i + 1)
    # Blocks of 2 to 8 characters that stand again at once.
    for size in range(2, min(8, n // 2) + 1):
        run = 0
        for i in range(size, n + 1):
            if i < n and low[i] == low[i - size]:
                run += 1
                continue
            if run >= size:
                start, end = i - run - size, i
                piece(start, end, size * each + math.log10(run / size + 1), "repeat")
            run = 0
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    for i in range(1, n + 1):
        brute = best[i - 1] + each + (JOIN if i > 1 and back[i - 1][1] != "brute" else 0)
        best[i], back[i] = brute, (i - 1, "brute")
        for start, cost, kind in ends.get(i, ()):
            cost += best[start] + (JOIN if start else 0)
            if cost < best[i]:
                best[i], back[i] = cost, (start, kind)
    pieces, i = [], n
    while i > 0:
        start, kind = back[i]
        if kind == "brute" and pieces and pieces[-1][0] == "brute":
            pieces[-1] = ("brute", start, pieces[-1][2])
        else:
            pieces.append((kind, start, i))
        i = start
    return best[n], pieces[::-1]


KINDS = ("assign", "access", "hex", "guess")


def scan_text(text: str, least: float = LEAST) -> tuple[list[tuple[int, int, int, float | None]], float | None]:
    """Spans (start, kind number, end, cost) in order, and the cost of the costliest credential."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    spans: list[tuple[int, int, int, float | None]] = []
    if any(k in raw for k in _NAMES):
        spans += [(m.start(), 0, m.end(), guess_cost(m[2])[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    if any(k in raw for k in _CONTEXT):
        m = CONTEXT.search(text)
        while m:
            cost, at = guess_cost(m[1])[0], m.end()
            if cost >= least:
                spans.append((m.start(), 3, m.end(), cost))
            elif after := _NEXT.search(text, max(m.start(1), m.end() - 16), m.end()):
                at = after.start()
            m = CONTEXT.search(text, at)
    costs = [s[3] for s in spans if s[3] is not None]
    return sorted(spans, key=lambda s: s[:3]), max(costs, default=None)


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, spans (array of kind, start, end, log10_guesses), log10_guesses (of the costliest credential)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
        for batch in text_batches(batches):
            found = [scan_text(t.as_py() or "", least) for t in batch.column(1)]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": c} for s, k, e, c in x] for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array([c for _, c in found], pa.float64())], names=["doc_id", "spans", "log10_guesses"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>, log10_guesses double")
