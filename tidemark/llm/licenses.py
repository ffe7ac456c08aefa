"""License scans by template-markup matching.

A license is a template: its mandatory wording, optional regions ``<<optional>> ... <</optional>>`` and replaceable regions
``<<var:least-most>>`` (a run of that many words, any wording). Each template is compiled into an automaton over words;
a text holds the license if somewhere the automaton accepts: mandatory words must stand exactly, optional regions whole or not at all,
variables take any words within their bounds. The search starts only where the rarest mandatory words of a template stand (its
anchor, before which the template has a bounded number of words), so a text without them costs one scan.

Besides, three short phrases are looked up as they are (the base rule): each place counts and gives its label.

Words are runs of ASCII letters and digits and of any character beyond ASCII, A-Z lower-cased. Null text: empty, 0 words, no labels.
Row by row, whole texts, no shuffle; repeated rows are judged each by itself. Empty table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slim, text_batches

# The phrases of the base rule.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# What the BSD licenses share, before and after their further clauses.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<var:0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<var:0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.
        """
_BSD_END = """
        THIS SOFTWARE IS PROVIDED BY <<var:2-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:2-20>> BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Public license wordings. Capitals, punctuation and line breaks don't matter.
TEMPLATES = {
    "MIT": """<<optional>>The MIT License <<optional>>MIT<</optional>><</optional>> <<optional>>Copyright <<var:0-30>><</optional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:2-20>> BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """<<optional>>ISC License<</optional>> <<optional>>Copyright <<var:0-30>><</optional>>
        Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var:1-10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD
    + """<<var:0-1>> Neither the name of <<var:1-20>> nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission."""
    + _BSD_END,
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var:1-5>> except in compliance with the License.
        You may obtain a copy of the License at <<optional>>http://www.apache.org/licenses/LICENSE-2.0<</optional>>
        <<optional>>https://www.apache.org/licenses/LICENSE-2.0<</optional>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """under the <<optional>>terms of the<</optional>> GNU General Public License <<optional>>as published by the Free Software
        Foundation; either<</optional>> version 3 <<optional>>of the License<</optional>>""",
    "MIT-notice": """<<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> MIT license""",
    "Apache-2.0-notice": """<<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> Apache license version 2
        <<optional>>0<</optional>>""",
    "CC-BY-NC-notice": """under <<var:0-2>> <<optional>>Creative Commons<</optional>> CC BY NC <<optional>>4 0<</optional>>""",
}

#: Bytes of words as they are, A-Z lower-cased, all others blank.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """A compiled template. States are numbered; ``step`` maps (state, word) to states, ``any`` takes any word, ``free`` takes none."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.step: list[tuple[bytes, int] | None] = []
        self.any: list[int | None] = []
        self.free: list[list[int]] = []
        self.mandatory: list[tuple[bytes, int, int]] = []  # word, state before it, most words before it
        self._most = 0
        tokens = re.findall(r"<<optional>>|<</optional>>|<<var:\d+-\d+>>|[^<]+", template)
        opened: list[int] = []
        at = self._new()
        for t in tokens:
            if t == "<<optional>>":
                opened.append(at)
                nxt = self._new()
                self.free[at].append(nxt)
                at = nxt
            elif t == "<</optional>>":
                nxt = self._new()
                self.free[at].append(nxt)
                self.free[opened.pop()].append(nxt)
                at = nxt
            elif t.startswith("<<var:"):
                least, most = map(int, t[6:-2].split("-"))
                ends = []
                for k in range(most):
                    if k >= least:
                        ends.append(at)
                    nxt = self._new()
                    self.any[at] = nxt
                    at = nxt
                nxt = self._new()
                for e in [*ends, at]:
                    self.free[e].append(nxt)
                at = nxt
                self._most += most
            else:
                for w in words(t):
                    nxt = self._new()
                    self.step[at] = (w, nxt)
                    if not opened:
                        self.mandatory.append((w, at, self._most))
                    at = nxt
                    self._most += 1
        self.end = at
        # The anchor: of the longest stretch of up to three mandatory words in a row, the one with the most letters.
        m = self.mandatory
        for size in (3, 2, 1):
            starts = [i for i in range(len(m) - size + 1) if m[i + size - 1][1] == m[i][1] + size - 1 and m[i + size - 1][2] == m[i][2] + size - 1]
            if starts:
                break
        else:
            raise ValueError(f"{label}: no mandatory word")
        best = max(starts, key=lambda i: (sum(len(m[i + j][0]) for j in range(size)), -i))
        self.anchor = b" " + b" ".join(m[best + j][0] for j in range(size)) + b" "
        self.before = m[best][2]

    def _new(self) -> int:
        self.step.append(None)
        self.any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in states:
                    states.add(n)
                    todo.append(n)
        return states

    def longest(self, text: list[bytes], start: int) -> int | None:
        """The end of the longest acceptance that starts at ``start``."""
        states, found = self._close({0}), None
        for i in range(start, len(text) + 1):
            if self.end in states:
                found = i
            if i == len(text):
                break
            w, nxt = text[i], set()
            for s in states:
                if self.step[s] is not None and self.step[s][0] == w:
                    nxt.add(self.step[s][1])
                if self.any[s] is not None:
                    nxt.add(self.any[s])
            if not nxt:
                break
            states = self._close(nxt)
        return found

    def find(self, text: list[bytes], anchors: list[int]) -> list[tuple[int, int]]:
        """(start, end) of acceptances around the anchors' word positions, leftmost and longest, one for each anchor."""
        out = []
        upto = 0
        for a in anchors:
            if out and a < out[-1][1]:
                continue
            for s in range(max(upto, a - self.before), a + 1):
                e = self.longest(text, s)
                if e is not None and e > a:
                    out.append((s, e))
                    upto = e
                    break
        return out


def _places(line: bytes, what: bytes) -> list[int]:
    """Byte places of ``what`` in ``line``; the last blank of one may be the first of the next."""
    out, at = [], line.find(what)
    while at >= 0:
        out.append(at)
        at = line.find(what, at + 1)
    return out


def scanner(phrases: dict[str, str], templates: dict[str, str]):
    automata = [Automaton(k, v) for k, v in templates.items()]
    keys = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]

    def scan(text: str) -> tuple:
        """n_words, base places, first, last, base labels, labels, score, spans (label, start, end in words)."""
        w = words(text)
        line = b" " + b" ".join(w) + b" "
        places, labels, spans = [], set(), []
        blanks = None

        def word_at(byte: int) -> int:
            nonlocal blanks
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
            return bisect_right(blanks, byte) - 1

        for key, label in keys:
            for p in _places(line, key):
                at = word_at(p)
                places.append(at)
                labels.add(label)
                spans.append((label, at, at + key.count(b" ") - 1))
        base = sorted(labels)
        for a in automata:
            anchors = [word_at(p) for p in _places(line, a.anchor)]
            for s, e in a.find(w, anchors) if anchors else ():
                labels.add(a.label)
                spans.append((a.label, s, e))
        covered = np.zeros(len(w), bool)
        for _, s, e in spans:
            covered[s:e] = True
        score = float(covered.sum()) / len(w) if spans else 0.0
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels, key=lambda x: x.encode())), score, sorted(spans, key=lambda x: (x[1], x[2], x[0]))

    return scan


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; score: share of words that a match covers."""
    phrases, templates = phrases or PHRASES, TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scanner(phrases, templates)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in text_batches(batches):
            rows = list(zip(*[of(t.as_py() or "") for t in batch.column(1)]))
            spans = [[{"label": k, "start": s, "end": e} for k, s, e in x] for x in rows[7]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(rows, kinds)], pa.array(spans, kind)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return slim(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
