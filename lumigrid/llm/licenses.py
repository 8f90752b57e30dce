"""License scans by template-markup matching.

A template is license wording with marked regions::

    licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public
    license version <<var;name=version;words=1-2>>

Words outside the marks are mandatory and must match exactly, an optional region may be
absent, a replaceable one (``var``) takes any words within its bounds. A template is
compiled to a small automaton over word hashes. The places where its first mandatory
words stand are found for a whole Arrow batch by NumPy; only there the automaton runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from lumigrid.llm.append import append
from lumigrid.llm.words import Words, word_hashes, words

#: Phrases that always give their label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_DAMAGES = (
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods"
    " or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability"
    " or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Whole license texts and whole notices, and below them short statements. The words are
#: fixed values: those of the licenses.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the"
        " <<var;name=software;words=1-3>> to deal in the <<var;name=software;words=1-3>> without restriction including without limitation the rights to use copy"
        " modify merge publish distribute sublicense and or sell copies of the <<var;name=software;words=1-3>> and to permit persons to whom the"
        " <<var;name=software;words=1-3>> is furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the"
        " <<var;name=software;words=1-3>> the <<var;name=software;words=1-3>> is provided as is without warranty of any kind express or implied including but not"
        " limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;name=holders;words=1-10>>"
        " be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
        " <<var;name=software;words=1-3>> or the use or other dealings in the <<var;name=software;words=1-3>>",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following"
        " disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>><<beginOptional>>3<<endOptional>>"
        " neither the name of <<var;name=organization;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission<<endOptional>> this software is provided by <<var;name=holders;words=1-12>> as is and any express or"
        " implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no"
        " event shall <<var;name=liable;words=1-12>> " + _DAMAGES,
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright"
        " notice and this permission notice appear in all copies the software is provided as is and <<var;name=author;words=1-8>> disclaims all warranties with"
        " regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name=author;words=1-8>> be liable for"
        " any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of"
        " contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the"
        " license at <<var;name=address;words=4-9>> unless required by applicable law or agreed to in writing software distributed under the license is distributed"
        " on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"
        " and limitations under the license",
    ),
    (
        "gpl-3",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or <<beginOptional>>at your option<<endOptional>> any later version <<var;name=program;words=1-6>> is distributed in the"
        " hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
        " general public license for more details you should have received a copy of the gnu general public license along with <<var;name=program;words=1-6>>"
        " if not see",
    ),
    ("mit", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("apache-2", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2<<beginOptional>> 0<<endOptional>>"),
    ("cc-by-nc-4", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc <<beginOptional>>version<<endOptional>> 4<<beginOptional>> 0<<endOptional>>"),
    ("cc-by-nc-4", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution noncommercial 4 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license"),
    ("gpl-3", "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by <<var;name=publisher;words=1-5>><<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
)


@dataclass
class Automaton:
    """States 0..n; `step[s]` maps a word hash to the next state, `free[s]` are the states
    reached without a word, and `any[s]` the one reached by any word. The last accepts."""

    label: str
    lead: np.ndarray
    step: list[dict[int, int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    any: list[int | None] = field(default_factory=list)

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def accepts(self, tokens: np.ndarray) -> bool:
        """Whether a beginning of `tokens` is the template's text."""
        now, last = self.reach({0}), len(self.step) - 1
        for t in tokens.tolist():
            if last in now or not now:
                break
            now = self.reach({s for q in now for s in (self.step[q].get(t), self.any[q]) if s is not None})
        return last in now

    @property
    def longest(self) -> int:
        return len(self.step)


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. It must begin with mandatory words once leading
    optional regions are cut (they cannot change what is accepted); regions nest."""
    parts = re.findall(r"<<.*?>>|[^<]+|<", template.lower())
    out = Automaton(label, np.zeros(0, np.uint64))

    def new() -> int:
        out.step.append({})
        out.free.append(set())
        out.any.append(None)
        return len(out.step) - 1

    at, open_at, lead, leading, skip = new(), [], [], True, 0
    for part in parts:
        if part.startswith("<<beginoptional"):
            skip += not lead
            if lead:
                open_at.append(at)
                leading = False
        elif part.startswith("<<endoptional"):
            if skip:
                skip -= 1
            elif not open_at:
                raise ValueError("an optional region ends that did not begin")
            else:
                out.free[open_at.pop()].add(at)
        elif part.startswith("<<var"):
            if skip:
                continue
            bounds = re.search(r"words=(\d+)-(\d+)", part)
            low, high = (int(bounds[1]), int(bounds[2])) if bounds else (0, 20)
            ends = []
            for k in range(high):
                ends += [at] * (k >= low)
                out.any[at] = (to := new())
                at = to
            for s in ends:
                out.free[s].add(at)
            leading = False
        elif not skip:
            for h in word_hashes(part).tolist():
                out.step[at][h] = (to := new())
                at = to
                if leading:
                    lead.append(h)
    if open_at or skip or not lead:
        raise ValueError(f"the template of {label} has an open region or no mandatory words at its start")
    out.lead = np.array(lead, np.uint64)
    # a fresh end state keeps "accepted" apart from states that optional regions reach
    end = new()
    out.free[at].add(end)
    return out


def places(found: Words, phrase: np.ndarray) -> np.ndarray:
    """Word positions where `phrase` stands within one text."""
    k = len(phrase)
    if len(found) < k:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(found.hash[: len(found) - k + 1] == phrase[0])
    for i in range(1, k):
        at = at[found.hash[at + i] == phrase[i]]
    return at[found.text[at] == found.text[at + k - 1]]


def scan(df: DataFrame, text: str = "text", phrases=BASE_PHRASES, templates=TEMPLATES) -> DataFrame:
    """`df` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places of the base phrases are counted, also overlapping ones; first_word and
    last_word are the least and greatest start of one (words from 0), null if none.
    base_labels are the phrases' labels, labels those and the accepted templates';
    both distinct, sorted, comma-joined, empty if none. score is 1 where a template is
    accepted, else 0.5 where a phrase stands, else 0.

    A null or empty text has no words and no labels. Any length works: memory is that of
    the text. Rows are independent, so repeated ones give equal results; no shuffle.
    Other columns stay, those named as a result are replaced.
    """

    def make():
        base = [(word_hashes(p), label) for p, label in phrases]
        automata = [compile_template(label, t) for label, t in templates]

        def compute(column):
            found, n = words(column), len(column)
            counts = np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            plain: dict[int, set[str]] = {}
            more: dict[int, set[str]] = {}
            for phrase, label in base:
                at = places(found, phrase)
                doc = found.text[at]
                np.add.at(counts, doc, 1)
                np.minimum.at(low, doc, at - found.first[doc])
                np.maximum.at(high, doc, at - found.first[doc])
                for d in np.unique(doc).tolist():
                    plain.setdefault(d, set()).add(label)
            for a in automata:
                for p in places(found, a.lead).tolist():
                    d = int(found.text[p])
                    if a.label not in more.get(d, ()) and a.accepts(found.hash[p : min(p + a.longest, found.first[d + 1])]):
                        more.setdefault(d, set()).add(a.label)
            some = counts > 0
            score = np.where(some, 0.5, 0.0)
            score[list(more)] = 1.0
            join = lambda d, *sets: ",".join(sorted(set().union(*[s.get(d, ()) for s in sets])))
            return [
                np.diff(found.first), counts,
                [v if s else None for v, s in zip(low.tolist(), some, strict=True)], [v if s else None for v, s in zip(high.tolist(), some, strict=True)],
                [join(d, plain) for d in range(n)], [join(d, plain, more) for d in range(n)], score,
            ]

        return compute

    return append(df, text, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)
