"""License scans by patience alignment.

A template is aligned with a stretch of text: words that occur once in both are anchors, the longest increasing
subsequence of their places stays, and the gaps between anchors, where other words are unique, are aligned the same way.
Coverage is the share of the template's words that got aligned. A stretch is twice a template's length and starts every half
length, so that a notice with up to half its length of words put in lies whole in one of them; of one with more, coverage is what the best stretch holds. Copies that follow on each other leave no word of such
a stretch unique, so stretches of one length and of one and a half also start wherever a word of the text says that the template
would start. Texts and stretches that do not hold enough of the template's words, repeats counted, are left out before, which
loses none that could reach ``least``.

Of findings that overlap the one with more aligned words stays, then the one with the higher coverage, then the one that
starts first.

Cases: null and empty texts have no findings. Case and punctuation do not count: words are runs of ASCII letters and
digits. Texts of any length are read whole. Rows that repeat a doc_id have findings of their own; null ids too. No rows give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

LEAST = 0.8
_WORD = re.compile(r"[a-z0-9]+")

#: License identifier -> notices. Public texts of the notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
        back[i] = piles[p - 1] if p else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned (template place, text place), both ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        once = {w for w, n in Counter(template[a:b]).items() if n == 1} & {w for w, n in Counter(text[c:d]).items() if n == 1}
        if not once:
            # equal ends still align: what is left of an anchor's neighbourhood
            if template[a] == text[c]:
                out.append((a, c))
                todo.append((a + 1, b, c + 1, d))
            elif template[b - 1] == text[d - 1]:
                out.append((b - 1, d - 1))
                todo.append((a, b - 1, c, d - 1))
            continue
        place = {w: j for j, w in enumerate(text[c:d], c) if w in once}
        found = [(i, place[w]) for i, w in enumerate(template[a:b], a) if w in once]
        kept = [found[i] for i in increasing([j for _, j in found])]
        out += kept
        for (i, j), (i2, j2) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], least: float = LEAST):
        self.templates = [(name, words(t)) for name, ts in templates.items() for t in ts]
        self.need = [(name, t, Counter(t), least * len(t)) for name, t in self.templates if t]
        self.vocabulary = frozenset(w for _, t in self.templates for w in t)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """[(license, coverage, aligned words, first word, end)] without overlaps, in the order of the text."""
        if not text:
            return []
        ws = words(text)
        have = self.vocabulary.intersection(ws)
        found = []
        at: list[int] | None = None
        for name, t, times, need in self.need:
            if sum(times[w] for w in times.keys() & have) < need:
                continue
            at = [i for i, w in enumerate(ws) if w in self.vocabulary] if at is None else at
            mine = [i for i in at if ws[i] in times]
            n = len(t)
            step, width = max(1, n // 2), 2 * n
            stretches = {(s, width) for i in mine for s in range(max(0, (i - width) // step * step), i + 1, step) if s <= i < s + width}
            places: dict[str, list[int]] = {}
            for i, w in enumerate(t):
                places.setdefault(w, []).append(i)
            begins = {max(0, i - p) for i in mine for p in places[ws[i]]}
            stretches |= {(s, long) for s in begins for long in (n, n + step)}
            for s, width in sorted(stretches):
                if bisect_left(mine, s + width) - bisect_left(mine, s) < need:
                    continue
                pairs = align(t, ws[s : s + width])
                if len(pairs) >= need:
                    found.append((len(pairs), len(pairs) / n, -(s + pairs[0][1]), name, s + pairs[-1][1] + 1))
        out: list[tuple[str, float, int, int, int]] = []
        for count, coverage, first, name, end in sorted(set(found), reverse=True):
            if all(end <= o[3] or -first >= o[4] for o in out):
                out.append((name, coverage, count, -first, end))
        return sorted(out, key=lambda o: (o[3], o[4]))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, coverage, aligned, first_word, end_word): one row for each finding."""
    scanner = Scanner(templates, least)

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "license", "coverage", "aligned", "first_word", "end_word")}
        for d, t in zip(cols["doc_id"], cols["text"], strict=True):
            for row in scanner.scan(t):
                for k, v in zip(out, (d, *row), strict=True):
                    out[k].append(v)
        return out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, aligned long, first_word long, end_word long"
    return map_texts(docs.select("doc_id", "text"), run, schema)
