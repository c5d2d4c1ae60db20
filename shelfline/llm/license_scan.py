r"""Licence scan: matching statistics against a generalised suffix automaton of licence texts.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, of whole texts (null: empty).
``TEMPLATES`` and ``PHRASES`` become one automaton over words, built once in the driver; it
has at most twice as many states as they have words. Each text is streamed through
it: at every word the automaton knows the longest run of words ending there that stands
in any template, and which. Only words whose neighbour stands next to them in some template are
stepped through; all others match a single word at most, which is below any length that counts.

* A phrase stands wherever the run ends in it: a run that ends in a state whose strings
  end in the phrase and that is as long as the phrase.
* Runs of ``LEAST`` words and more that do not go on are long matches. Those of one template are
  chained from left to right while they leave out at most ``GAP`` words of the text and of the
  template and go forward in both. A chain is a span; it carries its template's label
  when it covers min(``ENOUGH``, ``SHARE`` of the template) of the template's words.

``score`` is the largest share of a template that one chain covers, and at least
``PHRASE_SCORE`` if a phrase stands anywhere.

A text of any length is hashed in blocks. Documents are independent of each other, so nothing is
shuffled and no group can be hot; equal texts get equal results. Empty tables give an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import byte_classes, flat, schema_of, slices, words

LEAST = 4
GAP = 8
ENOUGH = 30
SHARE = 0.8
PHRASE_SCORE = 0.5

# Phrases with their labels, and public licence notices.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit-line", "mit", "released under the MIT license"),
    ("mit-under", "mit", "licensed under the MIT license"),
    (
        "mit-notice",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-line", "apache", "licensed under the Apache License, Version 2.0"),
    (
        "apache-notice",
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License "
        "at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ),
    ("gpl-line", "gpl", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-2-line", "gpl", "licensed under the GNU General Public License, version 2"),
    (
        "gpl-notice",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should "
        "have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ),
    ("lgpl-line", "lgpl", "licensed under the GNU Lesser General Public License"),
    ("cc-by-nc-line", "cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-line", "cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa-line", "cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-notice", "cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-notice", "cc-by-sa", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-notice", "cc-by-nc", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "bsd-notice",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc-notice",
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        "this permission notice appear in all copies.",
    ),
    (
        "mpl-notice",
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/",
    ),
    (
        "unlicense-notice",
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), byte_classes("alnum"))[0]


# --- the automaton -----------------------------------------------------------------------------------------------------------


class Automaton:
    """Suffix automaton of several word sequences, given as lists of word numbers.

    ``longest[s]``: words of the longest string of state s; all of its strings are ends of that one.
    ``ends[s]``: (sequence, words read) of every place where the strings of s end.
    """

    def __init__(self, sequences: list[list[int]]):
        self.steps: list[dict[int, int]] = [{}]
        self.longest, self.link = [0], [-1]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._add(last, word)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.steps]
        for number, sequence in enumerate(sequences):
            state = 0
            for read, word in enumerate(sequence, 1):
                state = self.steps[state][word]
                self.ends[state].append((number, read))
        for state in sorted(range(1, len(self.steps)), key=lambda s: -self.longest[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, longest: int) -> int:
        self.steps.append({})
        self.longest.append(longest)
        self.link.append(0)
        return len(self.steps) - 1

    def _split(self, state: int, word: int, after: int) -> int:
        """A copy of ``after`` for its strings that end ``state``'s longest and ``word``."""
        copy = self._new(self.longest[state] + 1)
        self.steps[copy], self.link[copy] = dict(self.steps[after]), self.link[after]
        self.link[after] = copy
        while state >= 0 and self.steps[state].get(word) == after:
            self.steps[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, word: int) -> int:
        """The state of the sequence read so far, after one more word."""
        known = self.steps[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new = self._new(self.longest[last] + 1)
        while last >= 0 and word not in self.steps[last]:
            self.steps[last][word] = new
            last = self.link[last]
        if last >= 0:
            after = self.steps[last][word]
            self.link[new] = after if self.longest[after] == self.longest[last] + 1 else self._split(last, word, after)
        return new

    def read(self, sequence: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: (length, state) of the longest string that ends at each word."""
        steps, longest, link = self.steps, self.longest, self.link
        state = length = 0
        lengths, states = [], []
        for word in sequence:
            after = steps[state].get(word)
            while after is None and state:
                state = link[state]
                length = longest[state]
                after = steps[state].get(word)
            state, length = (after, length + 1) if after is not None else (0, 0)
            lengths.append(length)
            states.append(state)
        return np.array(lengths, np.int64), np.array(states, np.int64)


class Matcher:
    """The automaton of templates and phrases with the lookups that a scan needs."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        sequences = [word_hashes(t) for _, _, t in templates] + [word_hashes(p) for p, _ in phrases]
        if any(len(s) < 2 for s in sequences):
            raise ValueError("templates and phrases need two words or more")
        self.templates, self.phrases = [(n, label) for n, label, _ in templates], [label for _, label in phrases]
        self.sizes = [len(s) for s in sequences]
        self.vocabulary = np.unique(np.concatenate(sequences))
        numbered = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.vocabulary & np.uint64(0xFFFF)] = True
        self.next_to = np.zeros((len(self.vocabulary), len(self.vocabulary)), bool)
        for s in numbered:
            self.next_to[s[:-1], s[1:]] = True
        self.automaton = Automaton(numbered)
        # phrase_in[s, p]: the strings of state s end in phrase p, if they are long enough
        self.phrase_in = np.zeros((len(self.automaton.steps), len(phrases)), bool)
        for p, s in enumerate(numbered[len(templates) :]):
            at = 0
            for word in s:
                at = self.automaton.steps[at][word]
            for state in range(1, len(self.automaton.steps)):
                up = state
                while up > 0 and up != at:
                    up = self.automaton.link[up]
                self.phrase_in[state, p] = up == at

    def runs(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(row, place in the row, word numbers) of all stretches of words that are neighbours in some template."""
        likely = np.flatnonzero(self.seen[hashes & np.uint64(0xFFFF)])
        number = np.searchsorted(self.vocabulary, hashes[likely])
        known = self.vocabulary[np.minimum(number, len(self.vocabulary) - 1)] == hashes[likely]
        at, number = likely[known], number[known]
        if len(at) < 2:
            return
        row = np.searchsorted(bounds, at, "right") - 1
        joined = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]) & self.next_to[number[:-1], number[1:]]
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        for first, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            yield int(row[first]), int(at[first] - bounds[row[first]]), number[first : last + 1].tolist()

    def phrase_places(self, lengths: np.ndarray, states: np.ndarray) -> Iterator[tuple[int, int]]:
        """(phrase, place of its first word) within one stretch."""
        for p in range(len(self.phrases)):
            size = self.sizes[len(self.templates) + p]
            for end in np.flatnonzero(self.phrase_in[states, p] & (lengths >= size)):
                yield p, int(end) - size + 1

    def long_matches(self, lengths: np.ndarray, states: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of the matches of one stretch that do not go on."""
        goes_on = np.append(lengths[1:] == lengths[:-1] + 1, False)
        for end in np.flatnonzero(~goes_on & (lengths >= least)):
            yield int(end) + 1 - int(lengths[end]), int(lengths[end]), int(states[end])


def chains(matches: list[tuple[int, int, list[tuple[int, int]]]], gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(template, first word, word after the last, words covered) of the chains of one text.

    matches: (place, length, [(template, template words read at the end)]), by end. A match
    that overlaps its chain loses the words that the chain has; of several places in a template the first that goes forward counts.
    """
    done, running = [], {}
    for place, length, ends in matches:
        places: dict[int, list[int]] = {}
        for template, read in ends:
            places.setdefault(template, []).append(read - length)
        for template, starts in places.items():
            chain = running.get(template)
            if chain:
                first, end, template_end, covered = chain
                cut = max(0, end - place)
                at = next((s + cut for s in starts if s + cut >= template_end), None)
                if cut < length and place - end <= gap and at is not None and at - template_end <= gap:
                    running[template] = (first, place + length, at + length - cut, covered + length - cut)
                    continue
                if cut >= length:
                    continue
                done.append((template, first, end, covered))
            running[template] = (place, place + length, starts[0] + length, length)
    return done + [(template, first, end, covered) for template, (first, end, _, covered) in running.items()]


# --- the operator ------------------------------------------------------------------------------------------------------------

SPAN = "struct<label: string, template: string, first_word: bigint, last_word: bigint, covered: bigint, share: double>"
_PLACE = pa.struct([("label", pa.string()), ("first_word", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: int = LEAST, gap: int = GAP) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` of phrases (label, first_word) and ``spans`` of chained matches, in the order of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, phrases))  # the size of the templates

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, classes = shared.value, byte_classes("alnum")
        n_templates = len(matcher.templates)
        for batch in slices(batches, 1):
            hashes, bounds = words(*flat(batch.column(1)), classes)
            places: list[list] = [[] for _ in range(batch.num_rows)]
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            for row, at, sequence in matcher.runs(hashes, bounds):
                lengths, states = matcher.automaton.read(sequence)
                places[row] += [{"label": matcher.phrases[p], "first_word": at + place} for p, place in matcher.phrase_places(lengths, states)]
                for place, length, state in matcher.long_matches(lengths, states, least):
                    ends = [e for e in matcher.automaton.ends[state] if e[0] < n_templates]
                    matches[row].append((at + place, length, ends))
            spans = []
            for own in matches:
                found = [
                    {
                        "label": matcher.templates[t][1], "template": matcher.templates[t][0], "first_word": first, "last_word": end - 1,
                        "covered": covered, "share": covered / matcher.sizes[t],
                    }
                    for t, first, end, covered in (chains(own, gap) if own else ())
                ]
                spans.append(sorted(found, key=lambda s: (s["first_word"], s["template"])))
            places = [sorted(p, key=lambda x: x["first_word"]) for p in places]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(places, pa.list_(_PLACE)), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "n_words", "places", "spans"]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = schema_of(rows, "doc_id").simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return rows.mapInArrow(read, f"{kind}, n_words long, places array<struct<label: string, first_word: bigint>>, spans array<{SPAN}>")


def report(docs: DataFrame) -> DataFrame:
    """Per document the places of the phrases, the labels of phrases and of covered templates, and the score."""
    sizes = {name: len(word_hashes(text)) for name, _, text in TEMPLATES}
    needed = F.create_map(*(F.lit(x) for name, size in sizes.items() for x in (name, min(float(ENOUGH), SHARE * size))))
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["first_word"])
    whole = F.filter("spans", lambda s: s["covered"] >= needed[s["template"]])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.transform(whole, lambda s: s["label"]))).alias("labels"),
        F.least(F.lit(1.0), F.greatest(best, F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0))).alias("score"),
        F.array_join(F.transform(whole, lambda s: F.concat_ws(":", s["label"], s["first_word"].cast("string"), s["last_word"].cast("string"))), ",").alias("spans"),
    )
