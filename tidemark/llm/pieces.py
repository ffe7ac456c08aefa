"""SentencePiece encoding and decoding on the tokenizers library.

A SentencePiece model is a protobuf of pieces with scores and kinds, and of how text is normalised. It is read here field by
field and rebuilt as a ``tokenizers.Tokenizer``: the precompiled normaliser map if there is one, extra blanks taken out if the model says so, the metaspace
marker for blanks and in front, a unigram model from the scores or, for a model of merges, the merges that the scores order, and byte fallback for
what no piece covers. Where no piece holds a marker after another character, text is cut before markers first, which changes no
result, and each different word of a batch is encoded once. Batches are encoded by the backend's threads. On loading, probe texts are encoded by the sentencepiece library too, and any
difference raises; ``differences`` holds the two against each other on every text given.

The model's path is a parameter; its bytes are read once on the driver and go with the task. Special pieces in a text are
ordinary text. Decoding gives the normalised text back, which is the text itself under an identity normaliser.

Null text: null ids. Empty text: no ids. Row by row, whole texts, no shuffle; repeated rows are encoded each by itself. Empty table: empty
result. Other columns are never looked at by ``encode``.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tidemark.llm.common import slim, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PROBES = ["", " ", "a", "Hello, world!", "  two  blanks ", "tab\tand\nline\r\n", "café über 世界 \U0001f600", "1234567890", "▁ mark", "<s> </s> <unk> <0x41>", "x" * 50, "a" + " " * 20 + "b", "\u0000\u0001\u007f"]


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: an int for varints, bytes for the other kinds."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"protobuf wire type {kind}")
                size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def parse(raw: bytes) -> dict:
    """pieces [(piece, score, kind)], unigram or merges, and the normaliser's settings, of a model's bytes."""
    out = {"pieces": [], "type": 1, "fallback": False, "unk": 0, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in fields(raw):
        if number == 1:
            got = dict(fields(value))
            out["pieces"].append((got.get(1, b"").decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, NORMAL)))
        elif number == 2:
            got = dict(fields(value))
            out |= {"type": got.get(3, 1), "fallback": bool(got.get(35, 0)), "unk": got.get(40, 0), "suffix": bool(got.get(24, 0))}
        elif number == 3:
            got = dict(fields(value))
            out |= {"charsmap": got.get(2, b""), "prefix": bool(got.get(3, 1)), "squeeze": bool(got.get(4, 1)), "escape": bool(got.get(5, 1))}
    if out["type"] not in (1, 2) or out["suffix"] or not out["escape"]:
        raise ValueError("only unigram and merge models with the blank as a prefix are read")
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every cut of a piece into two pieces, in the order in which merging prefers the piece."""
    known = {p for p, _, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    found = []
    for i, (p, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            found += [(-score, i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    return [(a, b) for *_, a, b in sorted(found)]


def build(raw: bytes) -> Tokenizer:
    model = parse(raw)
    pieces = model["pieces"]
    if model["type"] == 1:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], model["unk"], model["fallback"]))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        t = Tokenizer(models.BPE(vocab, _merges(pieces), unk_token=pieces[model["unk"]][0], fuse_unk=True, byte_fallback=model["fallback"]))
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["prefix"]:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    cuts = []
    if not any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
        cuts.append(pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated"))
    if model["type"] == 1 and not any("<" in p[1:] or p.startswith("<") and len(p) > 1 for p, _, kind in pieces if kind == NORMAL):
        cuts.append(pre_tokenizers.Split("<", "isolated"))  # the names of special pieces in a text are ordinary text
    if cuts:
        t.pre_tokenizer = pre_tokenizers.Sequence(cuts)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])])
    users = [AddedToken(p, normalized=True) for p, _, kind in pieces if kind == USER]
    if users:
        t.add_tokens(users)
    return t


_built: dict[str, Tokenizer] = {}


def tokenizer(raw: bytes) -> Tokenizer:
    """The tokenizer of a model, built once in a process and held against the sentencepiece library on the probes."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _built:
        t = build(raw)
        if bad := differences(raw, PROBES, t):
            raise ValueError(f"encoding differs from the model's own: {bad[:3]}")
        _built[key] = t
    return _built[key]


def differences(raw: bytes, texts: list[str], t: Tokenizer | None = None) -> list[tuple[str, list[int], list[int]]]:
    """(text, our ids, the library's ids) of the texts on which the two are not the same."""
    import sentencepiece

    t = t or build(raw)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ours = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return [(x, a, b) for x, a, b in zip(texts, ours, sp.encode(texts, num_threads=1)) if a != b]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes batches of texts. Under an identity normaliser whose pieces never span a blank, each different word of a batch is
    encoded once, and at most ``words`` of them are remembered for later batches; else texts are encoded whole."""

    def __init__(self, raw: bytes, words: int = 200_000):
        self.tokenizer, self.words = tokenizer(raw), words
        model = parse(raw)
        self.mark = self.tokenizer.token_to_id(MARK)
        spans = any(MARK in p.lstrip(MARK) for p, _, _ in model["pieces"])
        self.by_word = not spans and self.mark is not None and model["prefix"] and not model["squeeze"] and not model["charsmap"]
        self._forget()

    def _forget(self) -> None:
        # The empty word is a lone blank at a text's end.
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends, self.good = np.array([self.mark or 0], np.int32), np.array([0, 1]), np.ones(1, bool)

    def _learn(self, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])
        self.ids = np.concatenate([self.ids, flat])
        self.good = np.concatenate([self.good, np.array([a == b for a, b in zip(words, back)], bool)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets, whether decoding gives each text)."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            return np.fromiter((i for x in ids for i in x), np.int32), np.cumsum([0, *map(len, ids)]), np.array([a == b for a, b in zip(texts, back)], bool)
        if len(self.known) > self.words:
            self._forget()
        words: list[str] = []
        n = []
        for x in texts:
            if not x:
                w = []
            elif "  " in x or x[0] == " " or x[-1] == " ":
                w = [c[1:] for c in re.findall(" +[^ ]*", " " + x)]  # a word has the blanks before it, but for one
            else:
                w = x.split(" ")
            words += w
            n.append(len(w))
        new = list(set(words) - self.known.keys())
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = np.diff(self.ends)[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ends[at] - upto[:-1], size) + np.arange(upto[-1])]
        first = np.cumsum([0, *n])
        bad = np.concatenate([[0], np.cumsum(~self.good[at])])
        return ids, upto[first], bad[first[1:]] == bad[first[:-1]]


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text)."""
    raw = read_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        encoder = Encoder(raw)
        for batch in text_batches(batches):
            texts = batch.column(1).to_pylist()
            null = np.array([x is None for x in texts])
            ids, off, good = encoder([x or "" for x in texts])
            marks = [None if z else hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for z, a, b in zip(null, off, off[1:])]
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
            cols = [batch.column(0), pa.array(np.diff(off), pa.int64(), mask=null), lists, pa.array(marks, pa.string()), pa.array(good, pa.bool_(), mask=null)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "ids_sha256", "round_trip"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, threads: int = 2) -> DataFrame:
    """doc_id, text of (doc_id, ids). Null ids: null text."""
    raw = read_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        t = tokenizer(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(1).to_pylist()
                texts = iter(t.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else next(texts) for x in ids], pa.string())], names=["doc_id", "text"])

    return slim(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
