"""Licence scans by matching template markup.

A template is plain wording with two kinds of marked regions:

* ``[[ ... ]]``  optional words, which may hold regions themselves;
* ``{{lo-hi}}``  replaceable words: any lo to hi words stand here.

It is compiled into an automaton over words.  A text holds the licence where
the automaton accepts a run of its words, so all mandatory wording must stand
there exactly; cases, punctuation and spacing don't matter.

The MIT, ISC and two- and three-clause BSD licences are matched as wholes, from
the grant to the end of the disclaimer.  Other templates are notices that name a
licence, and the openings of MIT and BSD, which are labelled as openings: a text
that goes on otherwise than the licence does has no more than that.  Templates
with more mandatory words score higher; the whole licences score 1.

Words are runs of ASCII letters, digits and all characters beyond ASCII,
after A-Z are lower-cased.

Cases: a null text is an empty one; a text without words has no match and
score 0; rows are scanned one by one, so repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import from_columns, slices

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted"
_BSD_CONDITIONS = (
    _BSD_OPENING + " provided that the following conditions are met "
    "[[{{1-1}} ]]redistributions of source code must retain the [[above ]]copyright notice this list of conditions and the following disclaimer "
    "[[{{1-1}} ]]redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution ")
_BSD_DISCLAIMER = (
    "this software is provided by {{1-12}} as is and any express or implied warranties including but not limited to " + _AS_IS + " "
    "in no event shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage")
_MIT_OPENING = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction")

#: Fixed wordings of whole licences; holders, numbers of conditions and customary insertions are replaceable or optional.
LICENSES = {
    "mit-text": _MIT_OPENING + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
                "and to permit persons to whom the software is furnished to do so subject to the following conditions "
                "the above copyright notice and this permission notice [[including the next paragraph ]]shall be included in all copies or substantial portions of the software "
                "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
                "fitness for a particular purpose and noninfringement in no event shall {{1-12}} be liable for any claim damages or other liability "
                "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_CONDITIONS + "[[{{1-1}} ]]neither the name of {{1-12}} nor the names of {{1-4}} contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission " + _BSD_DISCLAIMER,
    "isc": "permission to use copy modify and [[or ]]distribute this software for any purpose with or without fee is hereby granted "
           "provided that the above copyright notice and this permission notice appear in all copies "
           "the software is provided as is and {{1-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
           "in no event shall {{1-12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
           "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
}

#: Notices that name a licence, and openings that may go on otherwise.
NOTICES = {
    "mit": "[[released ]]under the [[terms of the ]]mit license",
    "mit-opening": _MIT_OPENING,
    "apache-2.0": "under the apache license [[version ]]2 0",
    "gpl-notice": "under the [[terms of the ]][[gnu ]]general public license [[as published by the free software foundation ]][[either ]]version {{1-2}}",
    "lgpl": "gnu lesser general public license",
    "cc-by": "under [[the ]][[a ]]cc by [[{{0-2}}]]4 0",
    "cc": "under [[the ]][[a ]]creative commons attribution [[{{0-3}}]]license",
    "bsd-opening": _BSD_OPENING,
    "copyright": "copyright [[c ]]{{1-8}}all rights reserved",
    "mpl": "subject to the terms of the mozilla public license [[v ]][[version ]]2 0",
}

#: Labels and templates; the first words of a template are mandatory.
TEMPLATES = LICENSES | NOTICES

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([bool(_WORD.fullmatch(bytes([i]))) for i in range(256)])


@dataclass
class Automaton:
    """States with moves on a certain word, on any word, and without a word."""

    on_word: list[dict[bytes, int]] = field(default_factory=list)
    on_any: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    mandatory: int = 0
    final: int = 0

    def state(self) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def reach(self, states: set[int]) -> set[int]:
        """The states and all that free moves lead to."""
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def step(self, states: set[int], word: bytes) -> set[int]:
        out = set()
        for s in states:
            if (t := self.on_word[s].get(word)) is not None:
                out.add(t)
            if (t := self.on_any[s]) is not None:
                out.add(t)
        return self.reach(out)


def compile_template(template: str) -> Automaton:
    a = Automaton()
    at, opened = a.state(), []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            end = a.state()
            a.free[at].append(end)
            a.free[opened.pop()].append(end)
            at = end
        elif token.startswith("{{"):
            low, high = map(int, token[2:-2].split("-"))
            exits = []
            for i in range(high):
                if i >= low:
                    exits.append(at)
                nxt = a.state()
                a.on_any[at] = nxt
                at = nxt
            end = a.state()
            for s in [*exits, at]:
                a.free[s].append(end)
            at = end
        else:
            for word in _WORD.findall(token.lower().encode()):
                nxt = a.state()
                a.on_word[at][word] = nxt
                at, a.mandatory = nxt, a.mandatory + (not opened)
    if opened:
        raise ValueError(f"an optional region is not closed: {template!r}")
    a.final = at
    if not template.strip() or a.final in a.reach({0}):
        raise ValueError(f"a template needs mandatory words: {template!r}")
    return a


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        # a match needs one of the rare words that its template can't do without
        self.starts = {label: self._first_words(a) for label, a in self.automata.items()}
        self.must = {label: self._mandatory(t) for label, t in templates.items()}

    @staticmethod
    def _first_words(a: Automaton) -> set[bytes] | None:
        """The words that a match may start with; None if any may."""
        first = a.reach({0})
        return None if any(a.on_any[s] is not None for s in first) else {w for s in first for w in a.on_word[s]}

    @staticmethod
    def _mandatory(template: str) -> set[bytes]:
        plain = template
        while (shorter := re.sub(r"\[\[[^\[\]]*\]\]", " ", plain)) != plain:
            plain = shorter
        return set(_WORD.findall(re.sub(r"\{\{[^}]*\}\}", " ", plain).lower().encode()))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]], float]:
        """Places of phrases, spans of templates, and the best score of a match."""
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        found = [(i, label) for phrase, label in self.phrases for i in places.get(phrase[0], []) if words[i : i + len(phrase)] == phrase]
        spans, best = [], 0.0
        for label, a in self.automata.items():
            if not self.must[label] <= places.keys():
                continue
            first = self.starts[label]
            for i in range(len(words)) if first is None else sorted({i for w in first for i in places.get(w, [])}):
                states, end = a.reach({0}), 0
                for j in range(i, len(words)):
                    states = a.step(states, words[j])
                    if not states:
                        break
                    if a.final in states:
                        end = j + 1  # the longest match counts
                if end:
                    spans.append((i, end, label))
                    best = max(best, min(1.0, 0.5 + a.mandatory / 200))
        return found, spans, best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, n_words, ``places`` (start word and label of each phrase), ``spans`` (start, end, label of each
    template's match) and ``score``: 0 without either, 0.5 for a phrase alone, more with the mandatory words matched, 1 from 100 of them on."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    schema = "doc_id {}, n_words long, places array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string>>, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        # a text is looked at closely if it holds, anywhere, some word of each kind that a match needs
        rare = {max(must, key=len).decode() for must in scanner.must.values()} | {max(p, key=len).decode() for p, _ in scanner.phrases}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.ascii_lower(part.column("text"))
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                inside = _IS_WORD[data]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                edges = offsets[:-1][offsets[:-1] < len(data)]
                starts[edges] = inside[edges]  # a text begins anew
                n_words = np.diff(np.concatenate(([0], np.cumsum(starts)))[offsets])
                close = np.zeros(len(texts), bool)
                for word in rare:
                    close |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
                places, spans, score = [[] for _ in n_words], [[] for _ in n_words], np.zeros(len(n_words))
                for i in np.flatnonzero(close):
                    found, spans[i], best = scanner.scan(_WORD.findall(data[offsets[i] : offsets[i + 1]].tobytes()))
                    places[i] = found
                    score[i] = max(best, 0.5 if found else 0.0)
                yield from_columns(
                    doc_id=part.column("doc_id"), n_words=pa.array(n_words, pa.int64()),
                    places=pa.array([[{"start": a, "label": b} for a, b in x] for x in places], pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                    spans=pa.array([[{"start": a, "end": b, "label": c} for a, b, c in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
                    score=pa.array(score))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, schema.format(rows.schema["doc_id"].dataType.simpleString()))
