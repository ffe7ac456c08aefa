"""LM scoring by online logistic context mixing.

A text, A-Z lower-cased as for the base score, is predicted bit by bit, eight bits to a byte and a zero byte as its end. For each order k of ``ORDERS`` a predictor knows, for
the last k bytes and the byte's bits so far, how many zeros and ones followed. Their predictions, as log odds, are combined by
a weight vector that a gate selects (the bits so far, and how many orders have seen the context), and the result is
refined by an adaptive map from (gate, log odds) to observed frequencies. The sum of the costs of all bits is the text's score.

Training, over all documents whose crc32(doc_id) mod 5 is not 1, texts whole:

* Counts: exact, by string, with no ceiling. Texts are dealt into chunks of about ``CHUNK`` bytes; each chunk sends its distinct (k + 1)-byte strings of the
  longest order, with their times in training, to one of ``parts`` parts, by the last three bytes before the newest. A part so holds all strings
  of a context of order 3 and up, and counts these orders by itself; the number of parts follows the bytes. Strings of order 2 are counted in
  Spark and joined to the parts that hold their two bytes of context; those of order 1, 2^16 at most whatever the input, go to every task.
* Weights and map: each part goes once, online, through its distinct strings: it predicts each bit with the bit's own occurrence taken
  out of the counts, adds the outcome to the map's bucket and moves the weights. Weights are averaged over the parts by
  bytes seen, maps are added up, both as whole numbers, so reruns agree to the last digit.

With counts, weights and map fixed, a bit's cost hangs on the last bytes alone. So each part costs its distinct strings once, sends every chunk the
costs of the strings it asked for in the order asked, and the chunk meets its texts and adds up
over positions, in slices of ``SLICE`` bytes and ``PIECE`` strings, so that no task holds more than twelve bytes a string beside its input. Base scores are add-half unigram word scores: the ``HEAD`` most frequent words go to every task, a bounded table; counts of all other
words reach the documents by a join on the word's hash (64 bits).

Null text: empty: one token, the end. Null doc_id: remainder 0, in training. Repeated rows: each trains and is scored by itself. Empty table: empty result. No
training rows: counts are zero and every bit costs what untrained weights say. Other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing as H
from tidemark.llm.common import batches_of, materialise, slim, text_batches, text_bytes

ORDERS = (1, 2, 3, 4, 5)
#: The highest order whose strings every task holds; parts go by the context of the next order.
LOW = 2
CHUNK, PART, LEAST_PARTS = 16_000_000, 8_000_000, 24
HEAD, GATES, BUCKETS = 1 << 18, 256 * 4, 33
RATE, STEP, BATCH = 0.001, 0.3, 8192
CLIP = 8.0
SLICE, PIECE = 1_000_000, 64 * 8192
#: Weights and map entries are added up in units of this.
UNIT = 2.0**-16
TINY = 1e-4


def strings(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the last bytes at each position as a number, newest lowest; offsets), A-Z lower-cased, each text with zero bytes before it
    and one after."""
    raw = H.LOWER[raw]
    n = np.diff(off)
    ends = off[1:] + np.arange(1, len(n) + 1)
    flat = np.zeros(len(raw) + len(n), np.uint8)
    keep = np.ones(len(flat), bool)
    keep[ends - 1] = False
    flat[keep] = raw
    first = np.concatenate([[0], ends[:-1]])
    # Bytes of the text before never show: where a position is nearer to its text's start than j, byte j is zero.
    near = np.arange(len(flat)) - np.repeat(first, n + 1)
    out = flat.astype(np.uint64)
    for j in range(1, ORDERS[-1] + 1):
        back = np.zeros(len(flat), np.uint64)
        back[j:] = flat[:-j]
        back[near < j] = 0
        out |= back << np.uint64(8 * j)
    return out, np.concatenate([[0], ends])


def _given_back(x):
    """``x``; what Arrow no longer uses goes back to the machine, since workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    return x


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * (k + 1))) - 1)


def _bit(s: np.ndarray, bit: int) -> np.ndarray:
    return ((s >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


class Model:
    """Counts (for each order, rows of a (k + 1)-byte string and its times), weights (gates x inputs) and map (bits so far x buckets x 2)."""

    def __init__(self, counts, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.counts = []
        for c in counts:
            u, n = _fold(c[:, 0].astype(np.uint64), c[:, 1].astype(np.int64))
            self.counts.append((u, np.concatenate([[0], np.cumsum(n)])))
        self.weights = np.full((GATES, len(ORDERS) + 1), 0.3, np.float32) if weights is None else weights
        self.map = np.zeros((256, BUCKETS, 2)) if seen is None else seen
        centre = 1 / (1 + np.exp(-(np.arange(BUCKETS) * 2 * CLIP / (BUCKETS - 1) - CLIP)))
        self._known = (self.map[:, :, 1] + 4 * centre) / (self.map.sum(axis=2) + 4)

    def inputs(self, s: np.ndarray, train: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the eight bits: (log odds of a one from each order, gate, bits so far, the bit). ``train``: the bit's own occurrence is taken out of the counts."""
        orders = []
        for k, (u, upto) in zip(ORDERS, self.counts):
            q, at = np.unique(s & _mask(k), return_inverse=True)
            start = (q >> np.uint64(8)) << np.uint64(8)
            orders.append([u, upto, q, at.astype(np.int32), np.searchsorted(u, start), np.searchsorted(u, start + np.uint64(256))])
        for bit in range(8):
            x = np.empty((len(s), len(ORDERS) + 1), np.float32)
            x[:, -1] = 0.3
            deep = np.zeros(len(s), np.int64)
            for i, o in enumerate(orders):
                u, upto, q, at, low, high = o
                left = np.uint64(8 - bit)
                mid = np.searchsorted(u, ((q >> left) << left) | np.uint64(1 << (7 - bit)))
                one = _bit(q, bit)
                zeros, ones = upto[mid] - upto[low], upto[high] - upto[mid]
                o[4], o[5] = np.where(one, mid, low), np.where(one, high, mid)
                if train:
                    zeros = np.maximum(zeros - (1 - one), 0)
                    ones = np.maximum(ones - one, 0)
                n = zeros + ones
                x[:, i] = np.clip(np.log((ones + 0.05) / (zeros + 0.05)) * (n / (n + 0.5)), -CLIP, CLIP).astype(np.float32)[at]
                if i >= len(ORDERS) - 3:
                    deep += (n > 0)[at]
            node = (((s & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - bit)).astype(np.int64)
            yield x, node * 4 + deep, node, _bit(s, bit)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -CLIP, CLIP)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixed one and the map's, which is taken between two buckets."""
        at = (z.astype(np.float64) + CLIP) * (BUCKETS - 1) / (2 * CLIP)
        low = np.clip(at.astype(np.int64), 0, BUCKETS - 2)
        part = at - low
        q = self._known[node, low] * (1 - part) + self._known[node, low + 1] * part
        return np.clip((1 / (1 + np.exp(-z.astype(np.float64))) + q) / 2, TINY, 1 - TINY)

    def cost(self, s: np.ndarray) -> np.ndarray:
        """log10 of the probability of the newest byte of each string."""
        return np.concatenate([self._cost(s[a : a + PIECE]) for a in range(0, len(s), PIECE)]) if len(s) else np.zeros(0)

    def _cost(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s))
        for x, gate, node, one in self.inputs(s, False):
            for a in range(0, len(s), BATCH):
                to = slice(a, a + BATCH)
                p = self.refined(self.mixed(x[to], gate[to]), node[to])
                out[to] += np.log10(np.where(one[to] == 1, p, 1 - p))
        return out

    def learn(self, s: np.ndarray, times: np.ndarray) -> None:
        """One online pass over strings, each standing ``times`` times: predict, count in the map, move the weights. Bits share neither weights nor buckets, so
        they go one after the other."""
        for a in range(0, len(s), PIECE):
            self._learn(s[a : a + PIECE], times[a : a + PIECE])

    def _learn(self, s: np.ndarray, times: np.ndarray) -> None:
        for xs, gates, nodes, bits in self.inputs(s, True):
            for a in range(0, len(s), BATCH):
                to = slice(a, a + BATCH)
                x, gate, node, one, w = xs[to], gates[to], nodes[to], bits[to], times[to].astype(np.float64)
                z = self.mixed(x, gate)
                at = np.rint((z + CLIP) * ((BUCKETS - 1) / (2 * CLIP))).astype(np.int64)
                self.map += np.bincount((node * BUCKETS + at) * 2 + one, w, self.map.size).reshape(self.map.shape)
                off = (one - 1 / (1 + np.exp(-z))) * w
                step = np.stack([np.bincount(gate, off * x[:, i], GATES) for i in range(x.shape[1])], axis=1)
                mass = np.maximum(np.bincount(gate, w, GATES), 1)
                # Steps grow with the root of the mass up to STEP of the mean slope, so that a very common string doesn't throw the weights about.
                self.weights += (step / np.maximum(np.sqrt(mass) / RATE, mass / STEP)[:, None]).astype(np.float32)
                np.clip(self.weights, -1, 3, out=self.weights)


def _fold(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct strings in order, sums of ``n``)."""
    order = np.argsort(s, kind="stable")
    s, n = s[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.add.reduceat(n, first) if len(s) else n


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of numbers, lowest bytes first, compressed."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes(), 1)


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


KEY, TIMES = ORDERS[-1] + 1, 4


def _deal(limit: int):
    """Numbers rows, and deals them into chunks of about ``limit`` bytes in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            upto = size + np.cumsum(np.asarray(pc.binary_length(batch.column(2))).astype(np.int64) + 1)
            row = base + rows + np.arange(batch.num_rows)
            chunk = base + np.concatenate([[size], upto[:-1]])[: batch.num_rows] // limit
            if batch.num_rows:
                rows, size = rows + batch.num_rows, int(upto[-1])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(chunk), *batch.columns], names=["row", "chunk", "doc_id", "held_out", "text"])

    return run


def _part(s: np.ndarray, parts: int) -> np.ndarray:
    return (H.mix((s >> np.uint64(8)) & _mask(LOW)) % np.uint64(parts)).astype(np.int64)


def _ask(parts: int):
    """For each chunk and part: the chunk's distinct strings and how often each stands in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            return _fold(*(np.concatenate(x) for x in zip(*held)))

        def sent() -> pa.RecordBatch:
            s, n = folded()
            n = n.astype(np.uint32)
            part = np.concatenate([_part(s[a : a + PIECE], parts).astype(np.int32) for a in range(0, len(s), PIECE)])
            # Strings of one context stand together, which compresses best.
            order = np.lexsort([_turned(s), part])
            s, n, part = s[order], n[order], part[order]
            del order
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            keys = [_pack(s[a:b], KEY) for a, b in zip(cut, cut[1:])]
            times = [_pack(n[a:b], TIMES) for a, b in zip(cut, cut[1:])]
            ids = part[cut[:-1]].astype(np.int64)
            return _given_back(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), now)), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["part", "chunk", "keys", "times"]))

        with np.errstate(over="ignore"):
            for batch in text_batches(batches, SLICE):
                chunks = batch.column(0).to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]]))
                for a, b in zip(cut, cut[1:]):
                    if held and now != chunks[a]:
                        yield sent()
                        held, fresh = [], 0
                    now = int(chunks[a])
                    s, ends = strings(*text_bytes(batch.column(2).slice(a, b - a)))
                    trained = ~np.asarray(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), bool)
                    u, n = np.unique((s << np.uint64(1)) | np.repeat(trained, np.diff(ends)).astype(np.uint64), return_counts=True)
                    held.append((u >> np.uint64(1), n * (u & np.uint64(1)).astype(np.int64)))
                    fresh += len(u)
                    if fresh > 1_000_000:
                        held, fresh = [folded()], 0
            if held:
                yield sent()

    return run


def _gather(keys, times) -> tuple[np.ndarray, np.ndarray]:
    """(distinct strings, how often they stand in training) of packed ones, folded as they are opened."""
    u, n, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for k, t in zip(keys, times):
        held.append((_unpack(k.as_py(), KEY), _unpack(t.as_py(), TIMES).astype(np.int64)))
        if sum(len(x) for x, _ in held) > 2_000_000:
            u, n = _fold(*(np.concatenate(x) for x in zip((u, n), *held)))
            held = []
    return _fold(*(np.concatenate(x) for x in zip((u, n), *held)))


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of order ``LOW`` with their times in training (context false), and the contexts of the next order (true), each once a task: 2^24 of each
    at most."""
    two, three = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(0, np.uint64)
    for batch in batches:
        for keys, times in zip(batch.column(0), batch.column(1)):
            s, n = _unpack(keys.as_py(), KEY), _unpack(times.as_py(), TIMES).astype(np.int64)
            two = _fold(*(np.concatenate(x) for x in zip(two, _fold(s[n > 0] & _mask(LOW), n[n > 0]))))
            three = np.union1d(three, np.unique((s >> np.uint64(8)) & _mask(LOW)))
    for context, x, n in ((False, *two), (True, three, np.zeros(len(three), np.int64))):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), context)), pa.array(x.view(np.int64)), pa.array(n)], names=["context", "x", "n"])


def _places(parts: int):
    """The part of each context of the order after ``LOW``, and the two bytes that strings of order ``LOW`` have there before the newest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            with np.errstate(over="ignore"):
                part = _part(x << np.uint64(8), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((x & np.uint64(0xFFFF)).view(np.int64))], names=["part", "place"])

    return run


def _counts(one: tuple[np.ndarray, np.ndarray], two: pa.Table, s: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Counts of each order: the first from ``one``, the second from the rows of ``two`` (s, n), the others from a part's strings."""
    have = {1: one, LOW: (two["s"].to_numpy().view(np.uint64), two["n"].to_numpy())}
    for k in ORDERS:
        u, c = have.get(k, (s, n))
        u, c = _fold(u & _mask(k), c)
        yield np.stack([u, c.astype(np.uint64)], axis=1)


def _learn(one):
    def run(part: pa.Table, two: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            s, n = _gather(part["keys"], part["times"])
            s, n = s[n > 0], n[n > 0]
            m = Model(_counts(one, two, s, n))
            order = np.argsort(H.mix(s))  # strings come sorted; online learning wants them in no order
            m.learn(s[order], n[order])
        seen = float(n.sum())
        both = np.rint(np.concatenate([m.weights.astype(np.float64).ravel() * seen, m.map.ravel(), [seen]]) / UNIT).astype(np.int64)
        used = np.flatnonzero(both) if seen else np.zeros(0, np.int64)
        return _given_back(pa.table({"at": pa.array(used), "x": pa.array(both[used])}))

    return run


def _answer(one, weights: np.ndarray, seen: np.ndarray):
    """For each chunk that asked a part: the costs of its strings there, in the order asked."""

    def run(part: pa.Table, two: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            u, n = _gather(part["keys"], part["times"])
            cost = Model(_counts(one, two, u[n > 0], n[n > 0]), weights, seen).cost(u).astype(np.float32)
            costs = (_pack(cost[np.searchsorted(u, _unpack(x.as_py(), KEY))], 4) for x in part["keys"])
            return _given_back(pa.table({"part": part["part"], "chunk": part["chunk"], "keys": part["keys"], "costs": pa.array(costs, pa.binary())}))

    return run


def how_many_parts(dealt: DataFrame) -> int:
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_PARTS, -(-size // PART))


def costs(dealt: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, keys, costs) for the chunks of ``dealt`` (chunk, held_out, text): trained on rows that are not held out."""
    asked = materialise(dealt.select("chunk", "held_out", "text").mapInArrow(_ask(parts), "part long, chunk long, keys binary, times binary"), "asked")
    few = materialise(asked.select("keys", "times").mapInArrow(_low, "context boolean, x long, n long").groupBy("context", "x").agg(F.sum("n").alias("n")), "few")
    strings_of_two = few.filter("not context and n > 0").selectExpr("x >> 8 as place", "x as s", "n")
    # No more rows than there are strings of two bytes.
    low = strings_of_two.groupBy(F.expr("s & 65535").alias("s")).agg(F.sum("n").alias("n")).orderBy("s").toArrow()
    one = (low["s"].to_numpy().view(np.uint64), low["n"].to_numpy())
    places = few.filter("context").select("x").mapInArrow(_places(parts), "part long, place long").distinct()
    two = materialise(places.join(strings_of_two, "place").select("part", "s", "n"), "two")
    both = asked.groupBy("part").cogroup(two.groupBy("part"))
    start = Model([np.zeros((0, 2), np.uint64)] * len(ORDERS))
    total = np.zeros(start.weights.size + start.map.size + 1)
    # As many sums as the model has weights and buckets.
    for r in both.applyInArrow(_learn(one), "at long, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():
        total[r.at] = int(r.x) * UNIT
    seen = total[-1]
    weights = (total[: start.weights.size] / seen).astype(np.float32).reshape(start.weights.shape) if seen else start.weights
    return both.applyInArrow(_answer(one, weights, total[start.weights.size : -1].reshape(start.map.shape)), "part long, chunk long, keys binary, costs binary")


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text's number), A-Z lower-cased."""
    raw = H.LOWER[raw]
    start, end, text = H.words(raw, off)
    return H.stretch(H.prefix(raw), start, end), text


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in text_batches(batches, SLICE):
            h, n = np.unique(_words(*text_bytes(batch.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _turned(s: np.ndarray) -> np.ndarray:
    """Numbers that stand in order where strings stand as they were asked."""
    return (s << np.uint64(32)) | (s >> np.uint64(32))


class Answers:
    """Costs of a chunk's strings, kept part by part as they came."""

    def __init__(self, rows: pa.Table, parts: int):
        self.parts, self.known = parts, {}
        for part, keys, costs in zip(rows["part"].to_pylist(), rows["keys"], rows["costs"]):
            self.known[part] = _turned(_unpack(keys.as_py(), KEY)), _unpack(costs.as_py(), 4).astype(np.uint32).view(np.float32)

    def of(self, s: np.ndarray) -> np.ndarray:
        part = _part(s, self.parts)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], part[order[1:]] != part[order[:-1]], [True]])) if len(s) else [0]
        out = np.zeros(len(s))
        for a, b in zip(cut, cut[1:]):
            at = order[a:b]
            keys, costs = self.known[int(part[at[0]])]
            out[at] = costs[np.searchsorted(keys, _turned(s[at]))]
        return out


def _score(head, parts: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        heads, value = head.value
        out = []
        with np.errstate(over="ignore"):
            answered = Answers(answers, parts)
            for batch in text_batches(texts.to_batches(), SLICE):
                raw, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
                docs = batch.num_rows
                s, ends = strings(raw, off)
                u, back = np.unique(s, return_inverse=True)
                score = np.add.reduceat(answered.of(u)[back], ends[:-1])
                del s, u, back
                size = np.diff(off) + 1
                h, text = _words(raw, off)
                at = np.minimum(np.searchsorted(heads, h), max(len(heads) - 1, 0))
                hit = heads[at] == h if len(heads) else np.zeros(len(h), bool)
                base = np.bincount(text[hit], value[at[hit]], docs)
                found = np.bincount(text[hit], minlength=docs)
                # The others: distinct words of each text with their numbers.
                t, x = text[~hit], h[~hit]
                order = np.lexsort([x, t])
                t, x = t[order], x[order]
                first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])) if len(t) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(t)))
                upto = np.concatenate([[0], np.cumsum(np.bincount(t[first], minlength=docs))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(upto, pa.array(c)) for c in (x[first].view(np.int64), times.astype(np.int64))]
                n = np.bincount(text, minlength=docs) + 1
                cols = [*[batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")], pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(size, pa.int64()), *lists]
                out.append(pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "size", "words", "times"]))
        return _given_back(pa.Table.from_batches(out))

    return run


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (its end counted as a byte), one row for each row of ``docs``."""
    with batches_of(docs.sparkSession, 1000):
        return _scored(docs, head)


def _scored(docs: DataFrame, head: int) -> DataFrame:
    spark = docs.sparkSession
    rows = slim(docs, "doc_id", "text").select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 1"), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(rows.mapInArrow(_deal(CHUNK), "row long, chunk long, doc_id long, held_out boolean, text string"), "rows")
    training = rows.filter("not held_out").select("text")
    n_docs = training.count()
    vocabulary = materialise(training.mapInArrow(_vocabulary, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "vocabulary")
    v = vocabulary.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    total, kinds = (v.n or 0) + n_docs, v.v + (1 if n_docs else 0)
    over = total + 0.5 * (kinds + 1)
    value = lambda c: np.log10((c + 0.5) / over) if over else 0.0
    top = vocabulary.orderBy(F.desc("c"), "h").limit(head)
    got = top.toArrow()
    heads, often = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy().astype(np.float64)
    order = np.argsort(heads)
    known = spark.sparkContext.broadcast((heads[order], value(often[order])))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, size long, words array<long>, times array<long>"
    parts = how_many_parts(rows)
    scored = materialise(rows.groupBy("chunk").cogroup(costs(rows, parts).groupBy("chunk")).applyInArrow(_score(known, parts), schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    met = rare.join(vocabulary, rare.words == vocabulary.h, "left")
    tail = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(over))).cast("decimal(18,15)")).cast("double").alias("more"),
        F.sum(F.expr("case when c is not null then times else 0 end")).alias("found"),
    )
    out = scored.join(tail.withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"), "left")
    end = float(value(float(n_docs))) if over else 0.0
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(1 if n_docs else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        "score",
        (F.col("score") / F.lit(-float(np.log10(2))) / F.col("size")).alias("bits_per_byte"),
    )
