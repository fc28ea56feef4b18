"""License scans: phrases, and whole licence texts with optional and replaceable regions.

Method: template-markup matching. A template is wording with regions marked as optional or replaceable. It is compiled
into a token automaton; a text is accepted where all mandatory words follow each other exactly, optional regions are
there whole or not at all, and a replaceable region takes up to its number of words. Automata are tried only where the
first run of mandatory words of their template stands, and go from there both ways, to the end and to the begin.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Phrases and the labels that they give (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public licence wordings in template markup: <<optional>> ... <</optional>> may be left out, <<var:n>> stands for up to n
#: words. Whole licences where they are short, else the notice that the licence itself gives for use (fixed values).
TEMPLATES = {
    "mit": """<<optional>>the mit license <<optional>>mit<</optional>><</optional>> <<optional>>copyright <<var:30>><</optional>>
        permission is hereby granted, free of charge, to any person obtaining a copy of <<var:8>> and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var:6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<optional>>1.<</optional>> redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. <<optional>>2.<</optional>> redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "apache-2": """licensed under the apache license, version 2.0 <<optional>>(the "license"); you may not use <<var:4>> except in compliance
        with the license. you may obtain a copy of the license at <<var:12>><</optional>>""",
    "gpl-3": """<<optional>>this <<var:3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> gnu general public license,
        <<optional>>either<</optional>> version 3 <<optional>>or <<optional>>(at your option)<</optional>> any later version<</optional>>""",
    "cc-by": """licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution 4.0 international <<optional>>public<</optional>> license""",
    "cc-by-nc": """licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution <<optional>>-<</optional>> noncommercial 4.0 international <<optional>>public<</optional>> license""",
}


def _words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode())


@dataclass
class Automaton:
    """States are places in the wording. word[s] leads to s + 1; free[s] are states that need no word; stay[s] counts the
    words that a replaceable region still takes."""

    label: str
    word: list = field(default_factory=list)  # hash, or None where a replaceable region takes any word
    skip: dict = field(default_factory=dict)  # state -> state reached without a word
    need: list = field(default_factory=list)  # mandatory words before each state

    @classmethod
    def compile(cls, label: str, markup: str) -> Automaton:
        out, opened, needed = cls(label), [], 0
        for part in re.split(r"(<<[^>]*>>)", markup):
            if part == "<<optional>>":
                opened.append(len(out.word))
            elif part == "<</optional>>":
                out.skip.setdefault(opened.pop(), set()).add(len(out.word))
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                begin, n = len(out.word), int(m[1])
                out.word += [None] * n
                out.need += [needed] * n
                for s in range(begin, begin + n):
                    out.skip.setdefault(s, set()).add(begin + n)
            else:
                for w in _words(part):
                    out.word.append(C.hash_word(w))
                    out.need.append(needed)
                    needed += not opened
        out.need.append(needed)
        return out

    def closed(self, states: set) -> set:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def anchor(self) -> tuple[int, list[int]]:
        """The first run of three mandatory words (or fewer, if the wording has no such run) and its state."""
        outside = set(range(len(self.word)))
        for s, ends in self.skip.items():
            for e in ends:
                outside -= set(range(s, e))
        for n in (3, 2, 1):
            for s in range(len(self.word) - n + 1):
                if all(t in outside and self.word[t] is not None for t in range(s, s + n)):
                    return s, self.word[s : s + n]
        raise ValueError(f"no mandatory word in {self.label}")

    def back(self, hashes) -> tuple[bool, int]:
        """Whether the words before the anchor state, the nearest first, match its wording from the begin on, and how many
        mandatory words of it match."""
        come: dict = {}
        for s, ends in self.skip.items():
            for e in ends:
                come.setdefault(e, set()).add(s)

        def closed(states):
            todo, seen = list(states), set(states)
            while todo:
                for t in come.get(todo.pop(), ()):
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return seen

        anchor = self.anchor_state
        states = closed({anchor})
        least = min(self.need[s] for s in states)
        for h in hashes:
            if 0 in states:
                break
            nxt = {s - 1 for s in states if s and (self.word[s - 1] is None or self.word[s - 1] == h)}
            if not nxt:
                break
            states = closed(nxt)
            least = min(least, min(self.need[s] for s in states))
        return 0 in states, self.need[anchor] - least

    def run(self, hashes, before=()) -> tuple[bool, float]:
        """Whether a text is accepted whose words from the anchor state on are hashes, and before it, the nearest first,
        before; and the share of the mandatory words that matched."""
        whole, share = self.back(before)
        final, states, best = len(self.word), self.closed({self.anchor_state}), self.need[self.anchor_state]
        for h in hashes:
            if final in states:
                break
            nxt = {s + 1 for s in states if s < final and (self.word[s] is None or self.word[s] == h)}
            if not nxt:
                break
            states = self.closed(nxt)
            best = max(best, max(self.need[s] for s in states))
        if whole and final in states:
            return True, 1.0
        return False, (share + best - self.need[self.anchor_state]) / self.need[-1]

    def __post_init__(self):
        self.anchor_state = 0


def compiled(templates: dict[str, str]) -> list[Automaton]:
    out = []
    for label, markup in templates.items():
        a = Automaton.compile(label, markup)
        a.anchor_state, a.anchor_words = a.anchor()
        out.append(a)
    return out


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, found array<struct<label:string,word:int,share:double>>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: n_words, n_base (places of phrases), first_word and last_word (least and largest
    start), base (labels of the phrases) and found (template, word of its first mandatory wording, share of mandatory
    words that matched; 1 where the automaton accepts).

    Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. Null and empty texts have no words
    and no labels. Rows that are repeated get a row each.
    """
    phrases, automata = phrases or PHRASES, compiled(templates or TEMPLATES)
    sought = [(np.array([C.hash_word(w) for w in _words(p)], C.U64), label) for p, label in phrases.items()]

    def places(h, last, run):
        at = np.flatnonzero(h[: max(0, len(h) - len(run) + 1)] == C.U64(run[0]))
        for j in range(1, len(run)):
            at = at[h[at + j] == C.U64(run[j])]
        return at[at + len(run) <= last[at]] if len(at) else at

    def work(batch):
        for part in C.slices(batch, "text"):
            data, off = C.text_bytes(part.column("text"))
            data = C.LOWER[data]
            s, e, first = C.words(data, off, C.ALNUM)
            h = C.word_hashes(data, s, e)
            n = np.diff(first)
            last = np.repeat(first[1:], n)
            count, low, high = np.zeros(len(n), np.int64), np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
            base: list[set] = [set() for _ in n]
            for run, label in sought:
                at = places(h, last, run)
                doc = np.searchsorted(first, at, side="right") - 1
                np.add.at(count, doc, 1)
                np.minimum.at(low, doc, at - first[doc])
                np.maximum.at(high, doc, at - first[doc])
                for d in np.unique(doc):
                    base[d].add(label)
            found: list[list] = [[] for _ in n]
            for a in automata:
                for at in places(h, last, a.anchor_words):
                    d = int(np.searchsorted(first, at, side="right") - 1)
                    ok, share = a.run(h[at : min(at + len(a.word), first[d + 1])].tolist(), h[max(at - a.anchor_state, first[d]) : at][::-1].tolist())
                    found[d].append({"label": a.label, "word": int(at - first[d]), "share": 1.0 if ok else min(share, 0.99)})
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([sorted(b) for b in base], pa.list_(pa.string())), pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32()), ("share", pa.float64())])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "found"],
            )

    return C.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, SCANNED)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Labels of phrases and of accepted templates; score: 1 where there is a label, else the largest share of a
    template's mandatory words that stands in one place."""
    found = scan(C.table(spark, sf_dir, "documents"))
    accepted = F.transform(F.filter("found", lambda x: x.share >= 1), lambda x: x.label)
    labels = F.array_sort(F.array_union("base", accepted))
    score = F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
