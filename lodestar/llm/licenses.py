"""License scans by patience alignment.

A template is aligned to a part of a text: words that both have exactly once
are anchors, their longest increasing subsequence stays, and the gaps between
them are aligned in the same way. Gaps without a common unique word count the
exact longest common subsequence. Coverage is the share of the template's
words that are aligned.

Only parts that can reach the coverage are aligned: runs of SPAN times the
template's words that share enough words with it, counted with multiplicity.
The filter is lossless for matches that are no longer than that.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Least coverage, and the most words of a match per word of the template.
COVERAGE, SPAN = 0.8, 1.5

#: Public license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a step for each word of b."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose second numbers rise; by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        if at == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[at], piles[at] = y, k
        before[k] = piles[at - 1] if at else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def aligned(template: list[str], text: list[str]) -> int:
    """Words of the template that patience alignment matches in the text."""
    total, waiting = 0, [(0, len(template), 0, len(text))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and template[a] == text[c]:
            a, c, total = a + 1, c + 1, total + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d, total = b - 1, d - 1, total + 1
        if a == b or c == d:
            continue
        ours, theirs = Counter(template[a:b]), Counter(text[c:d])
        place = {text[y]: y for y in range(c, d) if theirs[text[y]] == 1 and ours[text[y]] == 1}
        anchors = _increasing([(x, place[template[x]]) for x in range(a, b) if template[x] in place])
        if not anchors:
            total += common_subsequence(template[a:b], text[c:d])
            continue
        total += len(anchors)
        for x, y in [*anchors, (b, d)]:
            waiting.append((a, x, c, y))
            a, c = x + 1, y + 1
    return total


def matches(words: list[str], template: list[str]) -> Iterator[tuple[float, int, int]]:
    """(coverage, start, end) of the places of a template in a text, from left to right, not overlapping.

    No alignment has more words than the longest common subsequence, and that
    grows by the words that enter a window at most: windows are passed over
    until so many have entered that it could reach what is needed.
    """
    n = len(template)
    need, span = -int(-COVERAGE * n // 1), max(n, int(SPAN * n))
    wanted = Counter(template)
    hits = [k for k, w in enumerate(words) if w in wanted]
    inside: Counter = Counter()
    shared, right, left, free, most = 0, 0, 0, 0, need
    while left < len(hits):
        start = hits[left]
        while right < len(hits) and hits[right] < start + span:
            w = words[hits[right]]
            inside[w] += 1
            shared += inside[w] <= wanted[w]
            most += 1
            right += 1
        if start >= free and shared >= need and most >= need:
            end = hits[right - 1] + 1
            most = common_subsequence(template, words[start:end])
            found = aligned(template, words[start:end]) if most >= need else 0
            if found >= need:
                while hits[right - 1] >= start and aligned(template, words[start : end - 1]) == found:
                    end -= 1
                while aligned(template, words[start + 1 : end]) == found:
                    start += 1
                yield round(found / n, 6), start, end
                free = end
        w = words[hits[left]]
        shared -= inside[w] <= wanted[w]
        inside[w] -= 1
        left += 1


def best_of_like(places: list[tuple[str, float, int, int]], sizes: dict[str, int]) -> list[tuple[str, float, int, int]]:
    """Places (name, coverage, start, end) without those that another template fits better.

    Two places are alike if they share half of what they cover together or
    more. A template fits by twice its matched words over its own words and
    those of the place, so that a notice with a word left out or too many
    gives way to the one that is there; equals all stay.
    """
    places = sorted(places, key=lambda p: (p[2], p[3], p[0]))
    fit = [2 * round(c * sizes[n]) / (sizes[n] + e - s) for n, c, s, e in places]
    gone = set()
    for k, (name, _, s, e) in enumerate(places):
        for j in range(k + 1, len(places)):
            other, _, s2, e2 = places[j]
            if s2 >= e:
                break
            if other != name and 2 * (min(e, e2) - s2) >= max(e, e2) - s and fit[j] != fit[k]:
                gone.add(k if fit[j] > fit[k] else j)
    return [p for k, p in enumerate(places) if k not in gone]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, license, coverage, start_word, end_word) per place of a template in a document.

    Places cover COVERAGE of the template's words at least, in SPAN times its
    words at most; those of one template do not overlap. Of different ones that
    cover nearly the same words the best fit stays. Word numbers count runs of letters and digits. Null and empty
    texts and templates match nothing; repeated rows each give their places;
    other columns are ignored.
    """
    known = [(name, words_of(text)) for name, text in sorted(templates.items()) if words_of(text)]
    needed = [(name, t, frozenset(t), -int(-COVERAGE * len(t) // 1) - (len(t) - len(set(t)))) for name, t in known]
    # A text with fewer distinct words of the vocabulary than the least template needs has no place.
    sizes = {name: len(t) for name, t in known}
    vocabulary, least = frozenset().union(*(s for _, _, s, _ in needed)), min((k for *_, k in needed), default=1)
    schema = "doc_id long, license string, coverage double, start_word long, end_word long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                present = vocabulary.intersection(words)
                if len(present) < least:
                    continue
                places = []
                for name, template, distinct, least_distinct in needed:
                    if len(distinct & present) >= least_distinct:
                        places += [(name, *place) for place in matches(words, template)]
                rows += [(doc_id, *place) for place in best_of_like(places, sizes)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(run, schema)
