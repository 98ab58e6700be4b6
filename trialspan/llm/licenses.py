"""License scans by template-markup matching.

A template is a line of words with markup: `[...]` may be missing, `{n}` stands for up to n
words of any kind. Each template is compiled into a token automaton; a text is accepted by it
where all mandatory wording follows in order, word for word, with only what the markup allows
between. Plain phrases are counted beside it.

Defined cases: a null or empty text has no words and no labels and null positions. Repeated
rows each get a row. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialspan.llm import _arrays as A
from trialspan.llm._store import bounded_batches

#: Bytes of a word once A-Z is lower-cased: digits, letters and everything outside ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True

PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "[3] neither the name of {8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = "this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

#: (template, label); fixed wording of public licences, whole texts first and the notices that refer to them next.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-text"),
    (f"{_BSD_GRANT} {_BSD_WARRANTY}", "bsd-2-clause"),
    (f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("licensed under the apache license version 2 0 the license you may not use {4} except in compliance with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2.0-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1} of the license or at your option any later version", "gpl-or-later"),
    ("licensed under [the] apache license [version] 2 0", "apache-2.0"),
    ("released under [the] [terms of the] mit license", "mit-notice"),
    ("[this work is] licensed under [the] [terms of the] gnu general public license [as published by the free software foundation] [either] version 3", "gpl-3.0"),
    ("[this work is] licensed under [the] [terms of the] gnu general public license [as published by the free software foundation] [either] version 2", "gpl-2.0"),
    ("licensed under [a] [the] [creative commons] cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under [a] [the] [creative commons] cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under [a] [the] [creative commons] cc by 4 0", "cc-by-4.0"),
    ("copyright [c] {6} all rights reserved", "all-rights-reserved"),
    ("spdx license identifier {1} apache 2 0", "apache-2.0"),
    ("spdx license identifier mit", "mit-notice"),
]

_ANY = None
_U = np.uint64


def hashed(words: list[str]) -> np.ndarray:
    """The hashes that words have in any text."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return A.spans(A.prefix(data), np.concatenate(([0], ends[:-1])), ends)


class Automaton:
    """States are places in the template; state `end` accepts."""

    def __init__(self, template: str):
        self.moves: list[tuple[int, str | None, int]] = []
        self.free: dict[int, list[int]] = {}
        at, opened = 0, []
        for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
            if token == "[":
                opened.append(at)
            elif token == "]":
                self.free.setdefault(opened.pop(), []).append(at)
            elif token[0] == "{":
                first = at
                for _ in range(int(token[1:-1])):
                    self.moves.append((at, _ANY, at + 1))
                    at += 1
                for k in range(first, at):
                    self.free.setdefault(k, []).append(at)
            else:
                self.moves.append((at, token, at + 1))
                at += 1
        self.end = at
        words = sorted({w for _, w, _ in self.moves if w is not None})
        self.codes = {int(h): w for h, w in zip(hashed(words), words, strict=True)}
        self.steps: dict[tuple[int, str | None], list[int]] = {}
        for a, w, b in self.moves:
            self.steps.setdefault((a, w), []).append(b)
        self.start = self._closed({0})
        self.first = {w for a in self.start for (b, w) in self.steps if a == b}

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for b in self.free.get(todo.pop(), ()):
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    def accepts(self, h: np.ndarray) -> bool:
        """Whether a run of words that starts with h[0] is one of the template's."""
        states = self.start
        for x in h[: self.end]:
            word = self.codes.get(int(x))
            states = self._closed({b for a in states for w in ({word, _ANY} if word is not None else {_ANY}) for b in self.steps.get((a, w), ())})
            if not states:
                return False
            if self.end in states:
                return True
        return False


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    score is 1 if a template is accepted, 0.5 if only phrases are found, else 0.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @A.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(hashed(p.split()), label) for p, label in phrases]
        automata = [(Automaton(t), label) for t, label in templates]
        openers = sorted({w for a, _ in automata for w in a.first if w is not None})
        by_opener = dict(zip(map(int, hashed(openers)), openers, strict=True))
        mark = np.zeros(1 << 16, bool)
        mark[(np.array(list(by_opener), _U) >> _U(48)).astype(np.int64)] = True
        for batch in batches:
            rows = len(batch)
            n_words, n_base = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base: dict[int, set[str]] = {}
            more: dict[int, set[str]] = {}
            for i, j, off, data in A.slices(batch.column("text")):
                data = A.LOWER[data]
                starts, ends, first = A.words(data, off, IN_WORD)
                h = A.spans(A.prefix(data), starts, ends)
                n_words[i:j] = np.diff(first)
                for phrase, label in wanted:
                    m = len(phrase)
                    at = np.flatnonzero(h[: max(0, len(h) - m + 1)] == phrase[0])
                    for k in range(1, m):
                        at = at[h[at + k] == phrase[k]]
                    of = np.searchsorted(first, at, "right") - 1
                    inside = at + m <= first[of + 1]
                    at, of = at[inside], of[inside]
                    np.add.at(n_base, i + of, 1)
                    np.minimum.at(low, i + of, at - first[of])
                    np.maximum.at(high, i + of, at - first[of])
                    for r in np.unique(of):
                        base.setdefault(i + int(r), set()).add(label)
                at = np.flatnonzero(mark[(h >> _U(48)).astype(np.int64)])
                of = np.searchsorted(first, at, "right") - 1
                for p, r in zip(at.tolist(), of.tolist(), strict=True):
                    opener = by_opener.get(int(h[p]))
                    for a, label in automata:
                        if opener in a.first and label not in more.get(i + r, ()) and a.accepts(h[p : first[r + 1]]):
                            more.setdefault(i + r, set()).add(label)
            none = n_base == 0
            joined = lambda x: ",".join(sorted(x))
            score = [1.0 if k in more else 0.5 if k in base else 0.0 for k in range(rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([joined(base.get(k, ())) for k in range(rows)], pa.string()), pa.array([joined(base.get(k, set()) | more.get(k, set())) for k in range(rows)], pa.string()), pa.array(score, pa.float64())],
                names=names,
            )

    schema = docs.select("doc_id").schema
    for name in names[1:5]:
        schema = schema.add(name, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("base_labels", "string").add("labels", "string").add("score", "double"))
