"""License scan by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import by_text

# Wording of common license notices and grants.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied."
    ),
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "bsd-2": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "public-domain": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"\w+")
LONG = 15  # words of a template whose parts are looked for with other words between them
_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))
_RETURNS = "array<struct<license:string,start:bigint,end:bigint,matched:bigint,coverage:double>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[k] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[pile], piles[pile] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in text, in template) of equal words, increasing in both.

    Equal words at both ends are paired; words that occur once in each part are anchors, of which the longest increasing
    subsequence stays; the gaps between anchors are aligned the same way. A gap without anchors has no more pairs.
    """
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1}
        once = [(k, place[w]) for k, w in enumerate(text[a:b], a) if here[w] == 1 and w in place]
        if not once:
            continue
        x, y = a, c
        for k in longest_increasing([t for _, t in once]):
            i, j = once[k]
            pairs.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, b, y, d))
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, words_of(text)
        # A text that covers ``least`` of the words has one of these: the longest words, until they fill what may be missing.
        self.room = len(self.words) - least * len(self.words)
        self.counts = Counter(self.words)
        # Words on each side of where the template would lie: none first, since a neighbour's words take anchors away.
        self.slacks = sorted({int(self.room) + 2, *(1 << k for k in range(int(self.room) + 2) if 1 << k < self.room + 2), 0})
        self.seeds: set[str] = set()
        filled = 0
        for w, n in sorted(self.counts.items(), key=lambda x: (-len(x[0]), x[0])):
            if filled > self.room + 1e-9:
                break
            self.seeds.add(w)
            filled += n
        self.places: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            if w in self.seeds:
                self.places.setdefault(w, []).append(k)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = [t for t in (Template(n, x, least) for n, x in templates.items()) if t.words]
        self.seeds = set().union(*(t.seeds for t in self.templates)) if self.templates else set()

    def _try(self, words: list[str], t: Template, a: int, b: int, tried: dict, found: list) -> int:
        """Align a region once; number of words paired, 0 if the words it has of the template are too few."""
        a, b = max(0, a), min(len(words), b)
        if (a, b) not in tried:
            m, tried[a, b] = len(t.words), 0
            if sum((Counter(words[a:b]) & t.counts).values()) >= self.least * m - 1e-9:
                pairs = align(words[a:b], t.words)
                tried[a, b] = len(pairs)
                if len(pairs) >= self.least * m - 1e-9:
                    found.append((-len(pairs), pairs[-1][0] - pairs[0][0], a + pairs[0][0], a + pairs[-1][0] + 1, t.name, len(pairs) / m))
        return tried[a, b]

    def scan(self, text: str) -> list[dict]:
        """Licenses in a text, without overlaps: the one that covers most words first."""
        lowered = text.lower()
        if not any(s in lowered for s in self.seeds):
            return []
        words = words_of(text)
        at: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.seeds:
                at.setdefault(w, []).append(k)
        found = []
        for t in self.templates:
            m = len(t.words)
            hits = sorted({(p - q, q) for w in t.seeds for p in at.get(w, ()) for q in t.places[w]})
            starts = sorted({s for s, _ in hits})
            tried: dict[tuple[int, int], int] = {}
            for s in starts:
                for slack in t.slacks:
                    if self._try(words, t, s - slack, s + m + slack, tried, found) == m:
                        break
            # Two parts of one license with other words between them: from the first part's region to the last one's.
            if m >= LONG:
                for k, s in enumerate(starts):
                    for e in starts[k + 1 : bisect_left(starts, s + m + 1)]:
                        self._try(words, t, s, e + m, tried, found)
        out: list[dict] = []
        for n, _, start, end, name, coverage in sorted(found, key=lambda f: (f[0], -f[5], f[1:5])):  # of equal ones the whole template
            if all(end <= o["start"] or start >= o["end"] for o in out):
                out.append({"license": name, "start": start, "end": end, "matched": -n, "coverage": coverage})
        return sorted(out, key=lambda o: o["start"])


def licenses(column: Column, templates: dict[str, str] | None = None, least: float = 0.8) -> Column:
    """Licenses in a text column: array of ``license``, word span ``start`` to ``end``, ``matched`` words, ``coverage``."""
    chosen = TEMPLATES if templates is None else templates
    made: list[Scanner] = []

    def scanner():
        if not made:
            made.append(Scanner(chosen, least))
        return made[0].scan

    return by_text(scanner, _RETURNS, _FOUND)(column)


def scan(df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per license found in a document: ``doc_id``, ``license``, ``start``, ``end`` (words), ``matched``, ``coverage``.

    Coverage is the share of the template's words that the alignment pairs; ``least`` of them are needed. A region is aligned
    around every occurrence of a seed word: one of a template's longest words, so many that a text without any of them cannot
    reach ``least``. Regions are aligned without words around them and with more and more. So a license is found wherever it
    stands in a long text, and as often as it occurs, also many times in a row, with words added, changed or left out within
    ``1 - least`` of its length; parts of a template of ``LONG`` words or more are joined over as many words as it has. Null, empty and other texts without licenses give no rows; repeated rows give theirs
    each. Other columns are not read; nothing is shuffled.
    """
    found = df.select(F.col(f"`{id_col}`").alias("doc_id"), licenses(F.col(f"`{text_col}`").cast("string"), templates, least).alias("f"))
    return found.select("doc_id", F.inline("f"))
