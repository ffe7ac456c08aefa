"""Personal data by candidates and gradient-boosted trees.

Two passes over rows, without a shuffle of texts. The first scans every whole text. The base rule gives four kinds of spans (``email``,
``ip``, ``card``, ``phone``), leftmost and non-overlapping within a kind. High-recall generators propose further, overlapping spans:
addresses with written-out signs (``name at host dot com``), numbers with any grouping, dotted or coloned addresses, account
numbers that start with a country. Each span is described by its format (digits, groups, checksums, shares of signs) and its
context (neighbours, a cue word before it).

Nobody labels spans, so labels come from the corpus itself: base spans are personal, and so is, for each of them, a copy in a disguise
that the base rule doesn't know, in the same place; candidates that the base rule leaves are taken for not personal, and
so are counterfeits: the same dress over a broken checksum, a part above 255, a date, a sum or plain words.
All candidates are fitted where they lie, those that look alike as one row with its count; histograms of each level of the
trees are summed by Spark (in place where vectors are few), and those of a kind and label weigh at most ``SAMPLE`` together: boosted trees on four fifths, chosen by a hash, twice, the
second time without the candidates that the first trees take for disguised ones, since these may be personal; on the
last fifth scores, in steps of ``STEP``, are calibrated by pooling neighbours until shares rise, and each kind gets the least score from which at least ``SURE`` of the
candidates are personal and of those that aren't at most ``ASTRAY`` pass. The second pass scores all candidates and takes, of
overlapping ones, the best first; base spans always stay and nothing overlaps them. Added kinds are ``like_email``, ``like_ip``,
``like_number`` and ``iban``; a kind without both labels adds nothing.

Places count code points. Null text: empty. Row by row, whole texts; repeated rows are judged each by itself. Ties of scores: the
longer span, then the earlier one. Null doc_id: a row like others. Empty table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slim, text_batches
from tidemark.llm.trees import BINS, Boosted, bin_rows, calibrate, grow, histograms, on_values

KINDS = ("email", "ip", "card", "phone")
MORE = ("like_email", "like_ip", "like_number", "iban")
#: What the rows of each kind and label weigh together at most; the least calibrated share, and the most of the others that may pass.
SAMPLE, SURE, ASTRAY = 4000, 0.95, 0.002
#: Log odds from which the first trees' verdict makes a candidate unknown: more like the disguised ones than like the others.
#: These trees split off no less than the share COARSE of rows, and to them all candidates weigh as DOUBT of the counterfeits.
UNKNOWN, COARSE, DOUBT = 0.0, 0.05, 0.1
#: Up to this number of different vectors (each with its count) histograms are summed in place, above it by Spark.
WHOLE = 50_000
#: Log odds are told apart by this much where they are counted.
STEP = 2.0**-10

# The patterns of the base rule. Look-behinds only spare starts that can't be the leftmost.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may stand for @ and for a dot in an address written out.
_AT = re.compile(r"(?:@|\x20?[(\[{<]\x20?(?:at|AT)\x20?[)\]}>]\x20?|\x20(?:at|AT)\x20)")
_REST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?\.\x20?|\x20?[(\[{<]\x20?(?:dot|DOT|\.)\x20?[)\]}>]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63})+")
_NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().,/:_-]{0,2}[0-9])+")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DOTS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?\.\x20?|\[dot\]|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DIGITS = re.compile("[0-9]+")
_CUES = re.compile(r"(?:mail|e-mail|contact|write|reach|phone|tel|mobile|cell|call|fax|sms|card|visa|iban|account|ssn|passport|tax|address|host|ip)\b[^A-Za-z0-9]{0,3}(?:(?:is|at|no|number|address|id|us|me)\b[^A-Za-z0-9]{0,3})*$", re.I)

#: Names of the features, in order.
FEATURES = (
    "digits letters groups longest shortest last_group plus bracket dot_sign dash blank slash_colon other at_sign at_word dots labels tld "
    "host_digits upper luhn parts_low parts_high rests before_letter before_digit before_sign after_letter after_digit after_sign cue mod97"
).split()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base rule, by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return found


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind number in MORE, start, end) of everything that might be personal; spans overlap."""
    last = 0
    for m in _AT.finditer(text):
        low = max(last, m.start() - 64)
        start = m.start()
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        rest = _REST.match(text, m.end()) if start < m.start() else None
        if rest:
            yield 0, start, rest.end()
    for pattern in (_DOTS, _COLONS):
        for m in pattern.finditer(text):
            yield 1, m.start(), m.end()
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        groups = [g.span() for g in _DIGITS.finditer(text, start, end)]
        n = sum(e - s for s, e in groups)
        if n < 7:
            continue
        if n <= 24:
            yield 2, start, end
        # Without what stands before the first or after the last group, as a year or a count beside a number.
        if len(groups) > 2:
            for s, e in ((groups[1][0], groups[-1][1]), (start, groups[-2][1])):
                if 7 <= sum(y - x for x, y in groups if x >= s and y <= e) <= 24:
                    yield 2, s - (text[s - 1] in "(+"), e
    for m in _IBAN.finditer(text):
        yield 3, m.start(), m.end()


def describe(text: str, start: int, end: int) -> list[float]:
    """The features of a span; a window of 24 code points before it is its context."""
    s = text[start:end]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    at = _AT.search(s)
    tail = re.split(r"[^A-Za-z0-9-]+", s[at.end() :]) if at else []
    labels = [t for t in tail if t and t.lower() != "dot"]
    before, after = text[start - 1 : start], text[end : end + 1]
    kind = lambda c: (c.isalpha(), c.isdecimal(), bool(c) and not c.isspace() and not c.isalnum())
    parts = [int(g[:6]) for g in groups]
    shifted = (s[4:] + s[:4]).replace(" ", "")
    mod97 = shifted.isascii() and shifted.isalnum() and int("".join(str(int(c, 36)) for c in shifted[:60]) or 0) % 97 == 1
    return [
        len(digits), sum(map(str.isalpha, s)), len(groups), max(sizes), min(sizes), sizes[-1], "+" in s, "(" in s or "[" in s, s.count("."), s.count("-"), s.count(" "),
        s.count("/") + s.count(":"), sum(c in "#$%&*_,=" for c in s), "@" in s, bool(at) and "@" not in s, bool(re.search("dot", s, re.I)), len(labels), len(labels[-1]) if labels else 0,
        any(c.isdecimal() for t in labels for c in t), sum(map(str.isupper, s)), 12 <= len(digits) <= 19 and luhn(digits), min(parts, default=0), max(parts, default=0), len(set(sizes)),
        *kind(before), *kind(after), bool(_CUES.search(text[max(0, start - 24) : start])), mod97,
    ]


def disguise(kind: int, s: str, pick: int) -> tuple[int, str] | None:
    """(kind number in MORE, text) of a base span in another dress, which one by ``pick``."""
    if kind == 0:
        name, host = s.rsplit("@", 1)
        if pick // 6 % 2:  # digits are no mark of an address
            name, host = (re.sub("[0-9]+", "", x) for x in (name, host))
            name, host = name.strip(".-_%+") or "me", re.sub(r"(^|\.)(?=\.|$)", r"\1host", host)
        at, dot = ((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", "."))[pick % 6]
        return 0, name + at + host.replace(".", dot)
    if kind == 1:
        return 1, s.replace(".", ("[.]", "(.)", " . ", "[dot]", " dot ")[pick % 5])
    digits = re.sub("[^0-9]", "", s)
    if kind == 2:
        cut = (".", "/", "  ", " - ")[pick % 4]
        return 2, cut.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    local = digits[-10:]
    if len(local) < 10:
        return None
    a, b, c = local[:3], local[3:6], local[6:]
    return 2, (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}", f"({a}) {b} {c}", f"{a} {b} {c}")[pick % 6]


def account(digits: str, pick: int, right: bool) -> str:
    """An account number with its country and check digits, right or not, around the digits of a card."""
    body = digits[: 14 + pick % 3]
    country = ("DE", "GB", "FR", "ES", "NL", "IT")[pick % 6]
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{check if right else 2 + (check - 1 + pick % 95) % 97:02d}{body}"
    return whole if pick % 2 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))


def counterfeit(kind: int, s: str, pick: int) -> tuple[int, str]:
    """(kind number in MORE, text) of what looks like a disguised base span and isn't."""
    digits = re.sub("[^0-9]", "", s) or "7"
    if kind == 0:
        a, *more = re.findall("[A-Za-z]+", s) or ["one"]
        b, c = (more + ["there", "then"])[:2]
        if pick // 3 % 2:
            a, b = a + digits[:2], b + digits[-1]
        return 0, (f"{a} at {b}. {c.title()}", f"{a} at {b} . {c}", f"{a} at {b}. {c}")[pick % 3]
    if kind == 1:
        parts = s.split(".")
        parts[pick % 4] = str(256 + int(parts[pick % 4][-3:]) % 700)
        return 1, (disguise(1, ".".join(parts), pick // 4) or (1, s))[1]
    if kind == 2:
        return 2, (disguise(2, digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10), pick) or (2, s))[1]
    d = (digits * 2)[:12]
    return 2, (f"20{d[:2]}-{d[2:4]}-{d[4:6]} {d[6:8]}:{d[8:10]}", f"{d[0]},{d[1:4]},{d[4:7]}", d[: 7 + pick % 5], f"{d[0]}.{d[1:9]}", f"{d[:2]}/{d[2:4]}/20{d[4:6]}-{d[6:8]}", f"{d[:4]}-{d[4:8]}")[pick % 6]


_FOUND = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int8()), ("pick", pa.int64()), ("x", pa.list_(pa.float32()))]))
_SCHEMA = "doc_id long, base array<struct<kind:byte,start:long,end:long>>, seen array<struct<kind:byte,start:long,end:long,label:byte,pick:long,x:array<float>>>"


def look(text: str) -> tuple[list, list]:
    """(base spans, candidates): a candidate's label is 0; disguised base spans (1) and counterfeits (2) stand for training only."""
    base, seen = base_spans(text), []
    for kind, s, e in base:
        pick = zlib.crc32(text[max(0, s - 16) : e].encode("utf-8", "surrogatepass"))
        around = text[max(0, s - 32) : s], text[e : e + 8]
        at = len(around[0])
        dressed = [(1, disguise(kind, text[s:e], pick)), (2, counterfeit(kind, text[s:e], pick))]
        if kind == 2:
            digits = re.sub("[^0-9]", "", text[s:e])
            dressed += [(1, (3, account(digits, pick, True))), (2, (3, account(digits, pick, False)))]
        for label, made in dressed:
            if made:
                seen.append((made[0], s, e, label, pick, describe(around[0] + made[1] + around[1], at, at + len(made[1]))))
    covered = sorted((s, e) for _, s, e in base)
    ends, high = [], 0
    for _, e in covered:
        high = max(high, e)
        ends.append(high)
    starts = [s for s, _ in covered]
    done = set()
    for kind, s, e in proposals(text):
        k = int(np.searchsorted(starts, e)) if starts else 0
        if (kind, s, e) in done or k and ends[k - 1] > s:
            continue
        done.add((kind, s, e))
        pick = zlib.crc32(text[max(0, s - 16) : e].encode("utf-8", "surrogatepass"))
        seen.append((kind, s, e, 0, pick, describe(text, s, e)))
    return base, seen


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        base, seen = zip(*(look(t.as_py() or "") for t in batch.column(1)))
        base = [[{"kind": k, "start": s, "end": e} for k, s, e in one] for one in base]
        seen = [[{"kind": k, "start": s, "end": e, "label": y, "pick": p, "x": x} for k, s, e, y, p, x in one] for one in seen]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _FOUND), pa.array(seen, _SEEN)], names=["doc_id", "base", "seen"])


def _binned(cuts: dict[int, list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, x = batch.column(0).to_numpy(), _matrix(batch.column(3), np.float32)
            bins = np.zeros(x.shape, np.uint8)
            for k, c in cuts.items():
                bins[kind == k] = bin_rows(x[kind == k], c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(4)], names=["kind", "label", "held", "bins", "n"])

    return run


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) else np.frombuffer(b"".join(column.to_pylist()), dtype)
    return flat.reshape(len(column), len(FEATURES))


def _tally(models: dict[int, Boosted], t: int, level: int, weight: dict, units: dict[int, float]):
    """Histograms of a task, cells that hold something: kind, cell, sums as whole numbers of the kind's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            kind, label, n = (batch.column(c).to_numpy() for c in (0, 1, 4))
            bins = _matrix(batch.column(3), np.uint8)
            for k, model in models.items():
                at = kind == k
                if at.any():
                    times, many = (n[at] * np.array(w)[label[at]] for w in weight[k])
                    total[k] = total.get(k, 0) + histograms(model, t, level, bins[at], label[at] == 1, times, many, units[k])
        for k, sums in total.items():
            sums = sums.reshape(3, -1)
            cell = np.flatnonzero(sums.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int8)), pa.array(cell), *(pa.array(v[cell]) for v in sums)], names=["kind", "cell", "g", "h", "n"])

    return run


def _fit(rows: DataFrame, cuts: dict[int, list[np.ndarray]], share: dict, doubt: bool, whole: int = WHOLE, **how) -> dict[int, Boosted]:
    """Trees of each kind over all rows that aren't held back; places in bins. With ``doubt`` all candidates weigh as DOUBT of the counterfeits.

    Both ways of summing give the same whole numbers.
    """
    many: dict = {}
    for r in rows.groupBy("kind", "label", "held").agg(F.sum("n").alias("n")).collect():  # six rows for each kind
        many[r.kind, r.label, r.held] = r.n * share[r.kind, r.label]
    weight, size = {}, {}
    for k in cuts:
        of = lambda y: many.get((k, y, False), 0.0)  # noqa: B023, E731
        every = [sum(many.get((k, y, h), 0.0) for h in (False, True)) for y in range(3)]
        times = [DOUBT * max(1, every[2]) / max(1, every[0]) if doubt else 1.0, 1.0, 1.0]
        size[k] = of(0) + of(1) + of(2)
        ones, zeros = max(1e-9, of(1)), max(1e-9, times[0] * of(0) + of(2))
        each = [share.get((k, y), 0.0) for y in range(3)]
        weight[k] = [u * v * size[k] / (2.0 * (ones if y == 1 else zeros)) for y, (u, v) in enumerate(zip(each, times))], each
    # Sums stay below 2^52 units, where doubles hold whole numbers exactly.
    units = {k: 2.0 ** (int(np.ceil(np.log2(n + 1))) - 52) for k, n in size.items()}
    rows = rows.where(~F.col("held"))
    few = rows.toArrow().combine_chunks().to_batches() if rows.count() <= whole else None

    def sums(models: dict[int, Boosted], t: int, level: int) -> dict[int, np.ndarray]:
        tally = _tally(models, t, level, weight, units)
        if few is not None:
            got = pa.Table.from_batches(tally(iter(few)))
        else:
            cells = rows.mapInArrow(tally, "kind byte, cell long, g double, h double, n double")
            # At most nodes x features x bins rows of each kind come to the driver.
            got = cells.groupBy("kind", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        kind, cell = got["kind"].to_numpy(), got["cell"].to_numpy()
        out = {}
        for k in models:
            out[k] = np.zeros((3, 2**level * len(FEATURES) * BINS))
            for i, c in enumerate("ghn"):
                out[k][i, cell[kind == k]] = got[c].to_numpy()[kind == k] * units[k]
            out[k] = out[k].reshape(3, 2**level, len(FEATURES), BINS)
        return out

    return grow(sums, cuts, size, **how)


def _scored(models: dict[int, Boosted], step: float):
    """Rows with their score as a whole number of steps, at most 2^15 of them on either side; other kinds go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, bins = batch.column(0).to_numpy(), _matrix(batch.column(3), np.uint8)
            score = np.zeros(len(kind))
            for k, model in models.items():
                score[kind == k] = model.score(bins[kind == k])
            score = np.clip(np.floor(score / step), -(2**15), 2**15).astype(np.int32)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["kind", "label", "held", "bins", "n", "score"])
            yield out.filter(pa.array(np.isin(kind, list(models))))

    return run


_BINNED = "kind byte, label byte, held boolean, bins binary, n long"


def _cuts(rows: DataFrame, share: dict, wide: dict[int, float]) -> dict[int, list[np.ndarray]]:
    """For each kind and feature the values at BINS - 2 even places among all ``rows``, whose labels weigh as ``share`` says."""
    label = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    cells = rows.select("kind", "label", "n", F.posexplode("x").alias("f", "v")).groupBy("kind", "f", "v").agg(*(label(y).alias(f"n{y}") for y in range(3)))
    size, targets = F.lit(0.0), F.array().cast("array<double>")
    for k, n in wide.items():
        size = F.when(F.col("kind") == k, sum(F.col(f"n{y}") * F.lit(share.get((k, y), 0.0)) for y in range(3))).otherwise(size)
        places = np.floor(np.linspace(0, 1, BINS)[1:-1] * (n - 1) + 1e-9).tolist()
        targets = F.when(F.col("kind") == k, F.array(*map(F.lit, places))).otherwise(targets)
    order = Window.partitionBy("kind", "f").orderBy("v")
    cells = cells.withColumn("size", size).select(
        "kind", "f", "v", targets.alias("at"),
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
    )
    hit = F.exists("at", lambda a: (a >= F.col("below") - 1e-6) & (a < F.col("upto") - 1e-6))
    cuts = {k: [[] for _ in FEATURES] for k in wide}
    for r in cells.where(hit).select("kind", "f", "v").collect():  # at most BINS - 2 of each kind and feature
        cuts[r.kind][r.f].append(r.v)
    return {k: [np.array(sorted(v), float) for v in fs] for k, fs in cuts.items()}


def learn(found: DataFrame, sample: int = SAMPLE, sure: float = SURE, astray: float = ASTRAY, whole: int = WHOLE) -> dict[int, tuple[Boosted, float]]:
    """For each kind that can be told: its trees and its threshold, from all candidates."""
    flat = found.select(F.explode("seen").alias("c")).select("c.*")
    held = F.expr("pmod(pmod(xxhash64(pick, kind, label), 1000000007), 5) = 0")
    # Candidates that look alike are one row that counts them.
    rows = materialise(flat.groupBy("kind", "label", held.alias("held"), "x").agg(F.count(F.lit(1)).alias("n")), "vectors")
    many = {(r.kind, r.label, r.held): r.n for r in rows.groupBy("kind", "label", "held").agg(F.sum("n").alias("n")).collect()}
    total = lambda k, *ys: sum(many.get((k, y, h), 0) for y in ys for h in (False, True))
    # Every row counts; those of a kind and label weigh ``sample`` together where they are more.
    share = {(k, y): min(1.0, sample / max(1, total(k, y))) for k in range(len(MORE)) for y in range(3)}
    fold = lambda k, *ys: any(many.get((k, y, False)) for y in ys)
    kinds = [k for k in range(len(MORE)) if fold(k, 1) and fold(k, 0, 2)]
    if not kinds:
        return {}
    wide = {k: sum(many.get((k, y, False), 0) * share[k, y] for y in range(3)) for k in kinds}
    cuts = _cuts(rows.where(~F.col("held") & F.col("kind").isin(kinds)), share, wide)
    binned = rows.where(F.col("kind").isin(kinds)).mapInArrow(_binned(cuts), _BINNED)
    binned = materialise(binned.groupBy("kind", "label", "held", "bins").agg(F.sum("n").alias("n")), "binned")
    first = _fit(binned, cuts, share, True, whole, least=COARSE)
    # Candidates of the corpus that look like the disguised ones are unknown, not impersonal: left out of the second fit.
    told = binned.mapInArrow(_scored(first, STEP), f"{_BINNED}, score int").where((F.col("label") != 0) | (F.col("score") < int(UNKNOWN / STEP))).drop("score")
    told = materialise(told, "told")
    left = {(r.kind, r.label == 1, r.held) for r in told.select("kind", "label", "held").distinct().collect()}
    cuts = {k: c for k, c in cuts.items() if all((k, y, h) in left for y in (False, True) for h in (False, True))}
    if not cuts:
        return {}
    models = _fit(told.where(F.col("kind").isin(list(cuts))), cuts, share, False, whole)
    held = told.where("held").mapInArrow(_scored(models, STEP), f"{_BINNED}, score int").groupBy("kind", "label", "score").agg(F.sum("n").alias("n")).toArrow()
    kind, label, score, n = (held[c].to_numpy() for c in ("kind", "label", "score", "n"))
    out = {}
    for k, model in models.items():
        at = kind == k
        weight = n[at] * np.array([share[k, y] for y in range(3)])[label[at]]
        out[k] = on_values(model, cuts[k]), calibrate(score[at] * STEP, (label[at] == 1).astype(np.int8), sure, astray, weight)
    return out


def select(base: list[tuple[int, int]], near: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates (score, kind, start, end), best first, none overlapping a base span or one taken before."""
    import bisect

    starts, ends = [], []
    for s, e in sorted(base):  # base spans may overlap each other: runs of them
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    taken = []
    for _, kind, s, e in sorted(near, key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
        at = bisect.bisect_left(starts, e)
        if at and ends[at - 1] > s:
            continue
        starts.insert(at, s)
        ends.insert(at, e)
        taken.append((kind, s, e))
    return sorted(taken)


def _judge(models: dict[int, tuple[Boosted, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(seen.offsets)))
            c = seen.flatten()
            get = lambda name: c.field(name).to_numpy(zero_copy_only=False)
            kind, start, end, label = get("kind"), get("start"), get("end"), get("label")
            x = c.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(kind), len(FEATURES)) if len(kind) else np.zeros((0, len(FEATURES)))
            near: dict[int, list] = {}
            for k, (model, least) in models.items():
                at = np.flatnonzero((kind == k) & (label == 0))
                score = model.score(x[at])
                for i, s in zip(at[score >= least].tolist(), score[score >= least].tolist()):
                    near.setdefault(int(row[i]), []).append((s, k, int(start[i]), int(end[i])))
            spans = []
            for i, base in enumerate(batch.column(1).to_pylist()):
                more = select([(b["start"], b["end"]) for b in base], near[i]) if i in near else []
                spans.append([(KINDS[b["kind"]], b["start"], b["end"]) for b in base] + [(MORE[k], s, e) for k, s, e in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in one] for one in spans], _SPANS)], names=["doc_id", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, sample: int = SAMPLE, sure: float = SURE, astray: float = ASTRAY) -> DataFrame:
    """doc_id, spans (array of kind, start, end, by kind in the order of KINDS and MORE, then start) of every row of ``docs``."""
    found = materialise(slim(docs, "doc_id", "text").mapInArrow(_scan, _SCHEMA), "candidates")
    return found.mapInArrow(_judge(learn(found, sample, sure, astray)), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
