"""Operator 6: license scans by matching template markup.

A template is mandatory wording with regions: ``[[ ... ]]`` may be left out, ``<<n>>`` stands for up
to n words of any kind and ``<<m-n>>`` for m to n (names, years, numbers of versions). A template compiles into an automaton over words: states
with an edge per word, empty edges around optional regions, and wildcard states for replaceable
ones. A text is accepted where all its mandatory words match exactly, in order and without a gap.
The automaton starts only where a template's first words stand, in texts that hold its longest mandatory run.
There are templates for whole license bodies, for the headers of source files, and for short notices.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text after lower-casing A-Z. Base labels
come from phrases; n_base counts all their places.

score: 1.0 where a template is accepted, 0.5 for base phrases alone, 0.0 for neither.

Cases: null and empty texts have no words and no labels (empty strings, score 0, null places). Rows
are independent: repeated rows give equal rows, null ids stay, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hornspark.llm.common import small_batches, texts

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of public licenses as templates, by label.
TEMPLATES = {
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
    " [[ http ]] [[ https ]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
    " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-notice": "licensed under the apache license version 2 0 [[ the license ]] you may not use this file except in compliance with the license",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    " [[ [[ 3 ]] neither the name of <<1-8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission ]]"
    " this software is provided by <<1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-grant": "licensed under [[ a ]] [[ the ]] creative commons attribution [[ non commercial ]] [[ noncommercial ]] [[ share alike ]] [[ sharealike ]] <<2>> [[ international ]] [[ public ]] license",
    "copyright-notice": "copyright [[ c ]] <<1-4>> all rights reserved",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu [[ lesser ]] [[ affero ]] general public license as published by the free software foundation"
    " either version <<1-2>> of the license or [[ at your option ]] any later version this program is distributed in the hope that it will be useful but without any warranty"
    " without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[ lesser ]] [[ affero ]] general public license for more details",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu [[ lesser ]] [[ affero ]] general public license as published by the free software foundation",
    "isc-body": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    " the software is provided as is and <<1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    " in no event shall <<1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
    " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-body": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software"
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    " in no event shall the <<1-8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "release-notice": "[[ this <<1-3>> is ]] released under the <<1-4>> license",
    "spdx-tag": "spdx license identifier <<1-6>>",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"
    " either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def license_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n: ``word[s]`` moves s to s+1, ``skip[s]`` lists empty edges, ``wild[s]`` takes any word."""

    word: tuple
    wild: tuple
    skip: tuple
    accept: int

    def closure(self, states) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def end_from(self, words: list[bytes], at: int) -> int | None:
        """Where the shortest acceptance from ``at`` ends."""
        states = self.closure({0})
        while True:
            if self.accept in states:
                return at
            if at >= len(words) or not states:
                return None
            w = words[at]
            states = self.closure({s + 1 for s in states if s < self.accept and (self.wild[s] or self.word[s] == w)})
            at += 1

    def firsts(self) -> set[bytes]:
        return {self.word[s] for s in self.closure({0}) if s < self.accept and not self.wild[s]}


def parse(template: str) -> list:
    """The markup as a list of words (str), wildcards (least and most words) and optional regions (list)."""
    stack: list[list] = [[]]
    for token in template.split():
        if token == "[[":
            stack.append([])
        elif token == "]]":
            region = stack.pop()
            stack[-1].append(region)
        elif token.startswith("<<"):
            least, _, most = token[2:-2].rpartition("-")
            stack[-1].append((int(least or 0), int(most)))
        else:
            stack[-1].append(token)
    return stack[0]


def compile_template(template: str) -> Automaton:
    word: list = []
    wild: list[bool] = []
    skip: list[list[int]] = [[]]

    def step(w, any_) -> None:
        word.append(w)
        wild.append(any_)
        skip.append([])

    def build(parts: list) -> None:
        for part in parts:
            if isinstance(part, list):
                start = len(word)
                build(part)
                skip[start].append(len(word))
            elif isinstance(part, tuple):
                least, most = part
                begin = len(word)
                for _ in range(most):
                    step(None, True)
                for s in range(begin + least, begin + most):
                    skip[s].append(begin + most)
            else:
                step(part.encode(), False)

    build(parse(template))
    return Automaton(tuple(word), tuple(wild), tuple(map(tuple, skip)), len(word))


def pattern(template: str) -> str:
    """The same language as a regular expression over ``' word word ... '``; for SQL and tests."""

    def part(p) -> str:
        if isinstance(p, list):
            return "(" + "".join(map(part, p)) + ")?"
        return f"([^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else p + " "

    return " " + "".join(map(part, parse(template)))


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.automata = {label: compile_template(t) for label, t in (templates or TEMPLATES).items()}
        #: A mandatory pair of neighbouring words per template, that texts are searched for first.
        self.anchors = {label: _anchor(parse((templates or TEMPLATES)[label])) for label in self.automata}
        self.phrases = [(b" " + p.encode() + b" ", p.count(" ") + 1, label) for p, label in PHRASES.items()]

    def scan(self, text: str | None) -> tuple:
        words = license_words(text) if text else []
        line = b" " + b" ".join(words) + b" "
        places, base, own = [], set(), set()
        for phrase, _, label in self.phrases:
            at, before, seen = line.find(phrase), 0, 0
            while at >= 0:
                seen += line.count(b" ", before, at)  # blanks since the place before
                before = at
                places.append(seen)
                base.add(label)
                at = line.find(phrase, at + 1)
        for label, auto in self.automata.items():
            if self.anchors[label] in line and self.accepts(auto, words):
                own.add(label)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0)

    @staticmethod
    def accepts(auto: Automaton, words: list[bytes]) -> bool:
        firsts = auto.firsts()
        return any(w in firsts and auto.end_from(words, i) is not None for i, w in enumerate(words))


def _anchor(parts: list) -> bytes:
    """The longest run of mandatory words."""
    runs, run = [], []
    for p in [*parts, ()]:
        if isinstance(p, str):
            run.append(p)
        else:
            runs.append(run)
            run = []
    return b" " + " ".join(max(runs, key=len)).encode() + b" "


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows = [scanner.scan(t) for t in texts(batch)]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *_COLUMNS])


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def license_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}) "
        f"WHERE ws[i:i + {n - 1}] = ['{"', '".join(p.split())}']"
        for p, label in PHRASES.items()
        for n in [len(p.split())]
    )
    own = ", ".join(f"CASE WHEN regexp_matches(line, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    return rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p AS ({places}),
g AS (SELECT rid, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list_distinct(list(label)) AS labels FROM p GROUP BY rid),
o AS (SELECT rid, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM (SELECT rid, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w))
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(coalesce(labels, []) || own)), ',') AS labels,
  CAST(CASE WHEN len(own) > 0 THEN 1.0 WHEN g.n > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM w JOIN o USING (rid) LEFT JOIN g USING (rid)
"""


SQL = _sql()
