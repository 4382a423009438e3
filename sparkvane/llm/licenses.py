"""License scans: phrases, and templates with optional and replaceable regions.

Templates are written in markup: [[...]] may be left out, <<var;match="...";max=n>> stands
for up to n words that match, and all other wording is mandatory. Each is compiled to a
token automaton; all run together from every word that can begin one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel
from .common import pick

#: Phrases whose places are counted, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Labels and the markup of the wording that grants them: notices, and short licenses as a whole.
_LICENSED = '[[is]] [[are]] licensed under [[the terms of]]'
_HOLDER = '<<var;match=".+";max=12>>'
_AS_IS = f"""this software is provided by {_HOLDER} as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {_HOLDER} be liable
    for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
    substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
    liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the
    use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
    following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and
    the following disclaimer in the documentation and or other materials provided with the distribution"""
_GNU = """free software you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by
    the free software foundation either version {number} of the license or at your option any later version"""
TEMPLATES = (
    ("apache-2.0", f"{_LICENSED} the apache [[software]] license [[,]] [[version]] 2.0"),
    ("gpl-3.0", f"{_LICENSED} the gnu general public license [[as published by the free software foundation]] [[either]] [[version]] 3"),
    ("gpl-2.0", f"{_LICENSED} the gnu general public license [[as published by the free software foundation]] [[either]] [[version]] 2"),
    ("gpl-3.0-or-later", _GNU.format(name="", number=3)),
    ("gpl-2.0-or-later", _GNU.format(name="", number=2)),
    ("lgpl-3.0-or-later", _GNU.format(name="lesser", number=3)),
    ("lgpl-2.1-or-later", _GNU.format(name="lesser", number="2.1")),
    ("agpl-3.0-or-later", _GNU.format(name="affero", number=3)),
    ("mit", "released under [[the]] [[terms of the]] mit license"),
    ("mit", f"{_LICENSED} the mit license"),
    ("mit", f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
    software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
    sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
    conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
    substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
    limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {_HOLDER} be liable
    for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
    software or the use or other dealings in the software"""),
    ("bsd-2-clause", f"{_BSD} {_AS_IS}"),
    ("bsd-3-clause", f"""{_BSD} [[3]] neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission {_AS_IS}"""),
    ("isc", f"""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
    above copyright notice and this permission notice appear in all copies the software is provided as is and {_HOLDER} disclaims all
    warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {_HOLDER} be
    liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
    whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
    arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
    applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be
    misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product
    documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be
    misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"""),
    ("cc-by-nc", f"{_LICENSED} [[a]] [[creative commons]] cc by nc <<var;match=\"[0-9]+\";max=2>>"),
    ("cc-by-4.0", f"{_LICENSED} [[a]] [[creative commons]] cc by 4.0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("proprietary", 'copyright [[c]] <<var;match="[0-9]{4}";max=2>> <<var;match=".+";max=6>> all rights reserved'),
)

#: A template doesn't hold where one of these is among the three words before it.
NEGATIONS = frozenset("not never neither nor no isn aren wasn weren cannot without".split())

_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_PART = re.compile(r'(\[\[)|(\]\])|<<var;match="([^"]*)";max=([0-9]+)>>|([^\s\[\]<>]+)')


def hash_words(words: list[str]) -> list[int]:
    """The kernel's hash of each word."""
    return kernel.words_of(pa.array(words, pa.large_string()), np.ones(256, bool)).hash.tolist()


@dataclass
class Automaton:
    """States of all templates; `step` has literal moves, `var` moves on a match, `skip` free moves."""

    step: list[tuple[int, int] | None] = field(default_factory=list)
    var: list[tuple[re.Pattern, int] | None] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    label: dict[int, str] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def state(self) -> int:
        self.step.append(None)
        self.var.append(None)
        self.skip.append([])
        return len(self.step) - 1

    @classmethod
    def compile(cls, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Automaton:
        self = cls()
        for label, markup in templates:
            at = self.state()
            self.starts.append(at)
            opened: list[int] = []
            for begin, end, match, most, text in _PART.findall(markup):
                if begin:
                    opened.append(at)
                elif end:
                    self.skip[opened.pop()].append(at)
                elif most:
                    begins = []
                    for _ in range(int(most)):
                        begins.append(at)
                        to = self.state()
                        self.var[at], at = (re.compile(match), to), to
                    for x in begins:
                        self.skip[x].append(at)
                else:
                    for word in _WORD.findall(text.lower()):
                        to = self.state()
                        self.step[at], at = (hash_words([word])[0], to), to
                    continue
                if not match and not most:
                    to = self.state()  # so that two regions in a row don't share a state
                    self.skip[at].append(to)
                    at = to
            self.label[at] = label
        reach = self.closure(set(self.starts))
        self.first = np.array(sorted({self.step[s][0] for s in reach if self.step[s]}), np.uint64)
        if any(self.var[s] for s in reach):
            raise ValueError("a template can't begin with a replaceable region")
        return self

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.skip[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def accepted(self, words: kernel.Words, at: int, first: int, last: int) -> set[str]:
        """Labels of templates whose mandatory wording stands from word `at` on, unless it is negated just before."""
        if any(words.data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace") in NEGATIONS for i in range(max(first, at - 3), at)):
            return set()
        found: set[str] = set()
        states = self.closure(set(self.starts))
        while states:
            found |= {self.label[s] for s in states if s in self.label}
            if at >= last:
                break
            code, text, then = int(words.hash[at]), None, set()
            for s in states:
                if self.step[s] and self.step[s][0] == code:
                    then.add(self.step[s][1])
                if self.var[s]:
                    if text is None:
                        text = words.data[words.start[at] : words.end[at]].tobytes().decode("utf-8", "replace")
                    if self.var[s][0].fullmatch(text):
                        then.add(self.var[s][1])
            states, at = self.closure(then), at + 1
        return found


def whole_text(label: str, text: str, optional: str = r"(?im)^\s*copyright\b.*$") -> tuple[str, str]:
    """A template of a license's whole text: all its words are mandatory, but for lines that match `optional`.

    In place of such a line up to twelve words of any kind may stand.
    """
    parts = [" ".join(_WORD.findall(p.lower())) for p in re.split(optional, text)]
    return label, f" {_HOLDER} ".join(p for p in parts if p)


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for each document: words, places of the phrases, labels of phrases and templates.

    Words are runs of ASCII digits, letters (lower-cased) and anything beyond ASCII, in the
    whole text. n_base counts every place of every phrase, overlapping ones too; first_word
    and last_word are null without one. score is 1 where a template accepts, 0.5 with a
    phrase alone, else 0. A template's wording doesn't count after a negation, as in "not licensed under". A null or empty text has no words and no labels; repeated rows and
    null doc_ids each give a row; an empty table gives none. Texts of any length are read whole.
    """
    machine = Automaton.compile(templates)
    coded = [(np.array(hash_words(p.split()), np.uint64), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.ALNUM_LOWER, lower=True)
                h, n = words.hash, part.num_rows
                total, low, high = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                base: dict[int, set[str]] = {}
                own: dict[int, set[str]] = {}
                for code, label in coded:
                    at = np.flatnonzero(h[: max(0, len(h) - len(code) + 1)] == code[0])
                    for k in range(1, len(code)):
                        at = at[h[at + k] == code[k]]
                    doc = np.searchsorted(words.first, at, "right") - 1
                    whole = at + len(code) <= words.first[doc + 1]
                    for i, d in zip(at[whole].tolist(), doc[whole].tolist(), strict=True):
                        where = i - int(words.first[d])
                        total[d] += 1
                        low[d] = where if low[d] < 0 else min(low[d], where)
                        high[d] = max(high[d], where)
                        base.setdefault(d, set()).add(label)
                begin = np.flatnonzero(np.isin(h, machine.first))
                for i, d in zip(begin.tolist(), (np.searchsorted(words.first, begin, "right") - 1).tolist(), strict=True):
                    if got := machine.accepted(words, i, int(words.first[d]), int(words.first[d + 1])):
                        own.setdefault(d, set()).update(got)
                none = total == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], pa.array(words.count.astype(np.int64)), pa.array(total), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none),
                        pa.array([",".join(sorted(base.get(d, ()))) for d in range(n)]),
                        pa.array([",".join(sorted(base.get(d, set()) | own.get(d, set()))) for d in range(n)]),
                        pa.array([1.0 if d in own else 0.5 if d in base else 0.0 for d in range(n)]),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return pick(docs, "doc_id", "text").mapInArrow(run, COLUMNS)
