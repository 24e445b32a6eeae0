"""License scans: template markup compiled to token automata.

A template is wording with markup: `<<beginOptional>> ... <<endOptional>>` may be left out, and
`<<var;...>>` stands for any words, up to `max=N` of them (VAR_WORDS if not said). It becomes a
nondeterministic automaton over words; all templates run as one deterministic automaton whose states
are built when a text first reaches them. From every word that can begin a template the automaton is
followed until no template is left; a template is found where all its mandatory words stood in order,
with nothing between them but its optional and replaced regions. Of matches of one template that overlap,
the leftmost counts, at its longest.

Words are maximal runs of ASCII letters and digits and of all other characters above ASCII, with A-Z
lower-cased: punctuation and layout never matter.

Score: 1 where a licence text or notice is found, 1/2 where a licence is only mentioned, else half of the
largest share of a text's or notice's mandatory words (of those with `MANDATORY` or more) that a
passage has in order from its first.

A text is read in pieces and its words kept as numbers: a task holds one text and its words' numbers.

Defined cases: null and empty texts have no words, no matches and score 0; texts of any length are taken
whole; repeated rows give equal results; an empty table gives an empty one; other columns come
back unchanged in `doc`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import packed, slices, table, unpacked

VAR_WORDS = 40
MANDATORY = 8
STATES = 100_000  # states kept at a time; they are built again when needed
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
MARKUP = re.compile(r"<<(.*?)>>", re.S)
MATCH = "struct<label:string,kind:string,first:bigint,last:bigint>"


@dataclass(frozen=True)
class Template:
    label: str
    wording: str
    kind: str = "notice"  # notice: a licence text or a grant under one; mention: its name only


# The phrases that name a licence.
MENTIONS = (
    Template("gpl", "gnu general public license", "mention"),
    Template("apache", "apache license", "mention"),
    Template("cc-by", "cc by", "mention"),
    Template("mit", "mit license", "mention"),
)

_GRANT = "<<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>"
_OFFER = f"<<beginOptional>>under {_GRANT}<<endOptional>>"

# Public licence texts and notices, with what may be left out or replaced.
NOTICES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name=holder;max=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;max=20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;name=holder;max=20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    *[Template(label, f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. {third}
        THIS SOFTWARE IS PROVIDED BY <<var;name=holder;max=20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL <<var;name=holder;max=20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""")
      for label, third in (
          ("bsd-2-clause", ""),
          ("bsd-3-clause", """<<beginOptional>>3<<endOptional>> Neither the name of <<var;name=organization;max=20>> nor the names
        of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission."""),
      )],
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will
        <<var;name=holder;max=20>> be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: <<beginOptional>>1<<endOptional>> The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2<<endOptional>>
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution."""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    Template("apache-2.0", f"licensed {_OFFER} apache license <<beginOptional>>version<<endOptional>> 2.0"),
    *[Template(label, f"""This <<var;name=program;max=6>> is free software <<beginOptional>>you can redistribute it and/or
        modify it<<endOptional>> {_OFFER} GNU {family} <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> either version {version} of the License, or (at your option) any later version""")
      for label, family, version in (
          ("gpl-2.0-or-later", "General Public License", "2"), ("gpl-3.0-or-later", "General Public License", "3"),
          ("agpl-3.0-or-later", "Affero General Public License", "3"), ("lgpl-2.1-or-later", "Lesser General Public License", "2.1"),
          ("lgpl-3.0-or-later", "Lesser General Public License", "3"),
      )],
    *[Template(f"gpl-{version}.0", f"licensed {_OFFER} GNU General Public License <<beginOptional>>version<<endOptional>> {version}")
      for version in (2, 3)],
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at <<beginOptional>>http<<endOptional>>
        <<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0"""),
    *[Template("mit", f"{verb} {_OFFER} MIT license") for verb in ("licensed", "released", "distributed")],
    *[Template(f"cc-by{part}-4.0", f"licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> {name} 4.0")
      for part, short, long in (
          ("", "CC BY", "Attribution"), ("-sa", "CC BY-SA", "Attribution-ShareAlike"), ("-nc", "CC BY-NC", "Attribution-NonCommercial"),
          ("-nd", "CC BY-ND", "Attribution-NoDerivatives"), ("-nc-sa", "CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
          ("-nc-nd", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
      ) for name in (short, f"Creative Commons {long}")],
)
TEMPLATES = (*MENTIONS, *NOTICES)


def words_of(text: str) -> list[str]:
    return [w.decode() for w in WORD.findall(text.encode().lower())]


def parsed(wording: str) -> list:
    """Items of a template: a word, an int (that many replaceable words at most), a list (optional items)."""
    open_lists: list[list] = [[]]
    at = 0
    for mark in [*MARKUP.finditer(wording), None]:
        open_lists[-1] += words_of(wording[at:mark.start() if mark else len(wording)])
        if mark is None:
            break
        at, name = mark.end(), mark[1].split(";")[0].strip()
        if name == "beginOptional":
            open_lists.append([])
        elif name == "endOptional":
            if len(open_lists) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = open_lists.pop()
            open_lists[-1].append(inner)
        elif name == "var":
            most = re.search(r";\s*max=(\d+)", mark[1])
            open_lists[-1].append(int(most[1]) if most else VAR_WORDS)
        else:
            raise ValueError(f"unknown markup <<{mark[1]}>>")
    if len(open_lists) > 1:
        raise ValueError("beginOptional without endOptional")
    if not any(isinstance(item, str) for item in open_lists[0]):
        raise ValueError("a template needs mandatory words")
    return open_lists[0]


class Automaton:
    """All templates as one automaton over numbered words; 0 is any word that no template has."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.numbers: dict[str, int] = {}
        # Of the nondeterministic states: edges (word number, or -1 for any word; target), free moves, the
        # template, its mandatory words so far.
        self.edges: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.owner: list[int] = []
        self.depth: list[int] = []
        self.final: dict[int, int] = {}
        starts = []
        self.mandatory = []
        for t, template in enumerate(templates):
            first = self._state(t, 0)
            last = self._chain(first, parsed(template.wording), t, True)
            self.final[last] = t
            self.mandatory.append(self.depth[last])
            starts.append(first)
        self.start = self._closed(starts)
        self.first = np.zeros(len(self.numbers) + 1, dtype=bool)
        for state in self.start:
            for word, _ in self.edges[state]:
                self.first[word if word >= 0 else slice(None)] = True
        self._reset()

    def _state(self, template: int, depth: int) -> int:
        self.edges.append([])
        self.free.append([])
        self.owner.append(template)
        self.depth.append(depth)
        return len(self.edges) - 1

    def _chain(self, state: int, items: list, t: int, mandatory: bool) -> int:
        for item in items:
            if isinstance(item, str):
                word = self.numbers.setdefault(item, len(self.numbers) + 1)
                after = self._state(t, self.depth[state] + mandatory)
                self.edges[state].append((word, after))
                state = after
            elif isinstance(item, int):
                end = self._state(t, self.depth[state])
                for _ in range(item):
                    self.free[state].append(end)
                    after = self._state(t, self.depth[state])
                    self.edges[state].append((-1, after))
                    state = after
                self.free[state].append(end)
                state = end
            else:
                end = self._chain(state, item, t, False)
                after = self._state(t, self.depth[state])
                self.free[state].append(after)
                self.free[end].append(after)
                state = after
        return state

    def _closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)

    def _reset(self) -> None:
        self.known: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.moves: list[dict[int, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.reached: list[float] = []
        self._number(self.start)

    def _number(self, states: frozenset[int]) -> int:
        """Number of a deterministic state; -1 for the empty one."""
        if not states:
            return -1
        if states not in self.known:
            self.known[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.accepts.append(tuple(sorted(self.final[s] for s in states if s in self.final)))
            self.reached.append(max(
                (self.depth[s] / self.mandatory[self.owner[s]] for s in states
                 if self.templates[self.owner[s]].kind != "mention" and self.mandatory[self.owner[s]] >= MANDATORY),
                default=0.0,
            ) if len(self.mandatory) == len(self.templates) else 0.0)
        return self.known[states]

    def _move(self, state: int, word: int) -> int:
        targets = [after for s in self.sets[state] for w, after in self.edges[s] if w in (word, -1)]
        after = self._number(self._closed(targets))
        self.moves[state][word] = after
        return after

    def matches(self, words: np.ndarray) -> tuple[list[tuple[int, int, int]], float]:
        """(template, first word, last word) of all matches, by first word, and the score."""
        found, score = [], 0.0
        free_from = [0] * len(self.templates)
        numbers = words.tolist()
        n = len(numbers)
        for begin in np.flatnonzero(self.first[words]).tolist():
            if len(self.sets) > STATES:
                self._reset()
            state, at, ends = 0, begin, {}
            while at < n:
                after = self.moves[state].get(numbers[at])
                if after is None:
                    after = self._move(state, numbers[at])
                if after < 0:
                    break
                state, at = after, at + 1
                for t in self.accepts[state]:
                    ends[t] = at
                score = max(score, 0.5 * self.reached[state])
            for t, end in sorted(ends.items()):
                if begin >= free_from[t]:
                    free_from[t] = end
                    found.append((t, begin, end - 1))
                    score = max(score, 0.5 if self.templates[t].kind == "mention" else 1.0)
        return found, score

    def word_numbers(self, text: str) -> np.ndarray:
        raw, out, at = text.encode().lower(), [], 0
        get = self.numbers.get
        while at < len(raw):
            cut = GAP.search(raw, min(at + (1 << 20), len(raw)))
            end = cut.start() if cut else len(raw)
            words = WORD.findall(raw, at, end)
            out.append(np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


@functools.lru_cache(maxsize=4)
def automaton(templates: tuple[Template, ...]) -> Automaton:
    built = Automaton(templates)
    built.numbers = {w.encode(): i for w, i in built.numbers.items()}
    return built


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """{doc: all columns but the text, n_words, matches: array of (label, kind, first, last) by first word, score}."""
    rows = packed(docs, text_col, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    kind = rows.schema["doc"].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(templates)
        labels, kinds = (np.array([getattr(t, f) for t in templates], dtype=object) for f in ("label", "kind"))
        for batch in slices(batches):
            sizes, found, offsets, scores = [], [], [0], []
            for text in batch.column("body").to_pylist():
                words = matcher.word_numbers(text)
                mine, score = matcher.matches(words)
                sizes.append(len(words))
                found += mine
                offsets.append(len(found))
                scores.append(score)
            flat = np.array(found, dtype=np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays(
                [pa.array(labels[flat[:, 0]], pa.string()), pa.array(kinds[flat[:, 0]], pa.string()), pa.array(flat[:, 1]), pa.array(flat[:, 2])],
                names=["label", "kind", "first", "last"],
            )
            matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), matches, pa.array(scores, pa.float64())],
                names=["doc", "n_words", "matches", "score"],
            )

    return unpacked(rows.mapInArrow(scanned, f"doc {kind}, n_words bigint, matches array<{MATCH}>, score double"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m.kind == "mention")
    starts = F.transform("base", lambda m: m.first)
    labels = lambda name: F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda m: m.label))), ",")
    return found.withColumn("base", base).select(
        "doc.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("matches").alias("labels"), "score",
    )
