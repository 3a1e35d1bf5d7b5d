"""Operator 2: license notices in documents.

Templates are winnowed: of every window of consecutive word grams the smallest hash is a fingerprint, and an inverted index maps fingerprints to templates and positions. A document's grams are looked up in it; hits of a template whose diagonals lie within its drift make a candidate region, which a banded local alignment with the template then measures: matched words, coverage of the template, and the span in the document. The drift is the share of a template's words that coverage lets differ, so a notice is found where runs of so many words are inserted (a holder's name, say) or left out, in one place or several; the band spans a region's hits and a margin.

A template of n words that matches m = coverage * n of them, rounded up, with no more than n - m edits has a run of m / (n - m + 1) equal words or more, rounded up. Grams are of that many words, three at most, and windows as wide as such a run allows, so every match at the coverage holds a fingerprint: short templates are indexed by all their grams, of two words where it takes that.

Where findings of different templates stand in one place, the one with most matched words less its missed ones is it: a notice of one license isn't one of a shorter or similar one too. The index holds the templates only, 16 bytes a fingerprint, so it goes to every task; documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.llm.substring import WordHashes, word_hashes

# Public license notices, by SPDX-like id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}

GRAM = 3  # words of a gram, at most
BAND = 8
COVERAGE = 0.8
_FOUND = "doc_id long, license string, start_word int, end_word int, start int, end int, matched_words int, template_words int, coverage double"


def grams(words: np.ndarray, k: int = GRAM) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return h ^ (h >> np.uint64(29))


def winnowed(h: np.ndarray, window: int) -> list[int]:
    """Positions of each window's smallest hash, the rightmost of equals."""
    w = min(window, len(h))
    return sorted({i + w - 1 - int(h[i : i + w][::-1].argmin()) for i in range(len(h) - w + 1)}) if len(h) else []


def widths(n: int, coverage: float) -> tuple[int, int]:
    """Words of a gram and grams of a window for a template of n words: every match at coverage has a window's words in a row."""
    matched = math.ceil(coverage * n - 1e-9)
    run = math.ceil(matched / (n - matched + 1))
    return min(GRAM, run), run - min(GRAM, run) + 1


class Index:
    """Inverted index of the templates' fingerprints: for each gram size sorted hashes, and the template and position of each."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        known = WordHashes()
        self.names, self.coverage = sorted(templates), coverage
        self.words = [word_hashes(templates[name], known) for name in self.names]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            if len(words):
                k, window = widths(len(words), coverage)
                h = grams(words, k)
                found[k] += [(int(h[at]), t, at) for at in winnowed(h, window)]
        self.by_size = {}
        for k, rows in sorted(found.items()):
            rows.sort()
            self.by_size[k] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32)

    def band(self, t: int, band: int) -> int:
        """The band for a template: narrow for short ones, whose copies may follow each other."""
        return min(band, max(1, len(self.words[t]) // 3))

    def drift(self, t: int, band: int) -> int:
        """Words that a match of the template may gain or lose between its first and its last hit."""
        return max(self.band(t, band), math.ceil((1 - self.coverage) * len(self.words[t]) - 1e-9))

    def regions(self, words: np.ndarray, band: int = BAND) -> list[tuple[int, int, int]]:
        """(template, diagonal, drift) of candidate places: the diagonals of one template's hits, each with those up to its drift above; one whose hits all are in the candidate before is none."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for k, (keys, template, place) in self.by_size.items():
            h = grams(words, k)
            low = np.searchsorted(keys, h)
            for i in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h):
                for j in range(low[i], np.searchsorted(keys, h[i], "right")):
                    diagonals[int(template[j])].add(int(i) - int(place[j]))
        out = []
        for t, found in sorted(diagonals.items()):
            on, drift = np.array(sorted(found)), self.drift(t, band)
            last = on[np.searchsorted(on, on + drift, "right") - 1]
            new = np.append(True, last[1:] > last[:-1])
            out += [(t, int(d), int(e - d)) for d, e in zip(on[new], last[new])]
        return out


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND, drift: int = 0) -> tuple[int, int, int]:
    """Best local alignment of template[i] with words[i + diagonal + e], -band <= e <= drift + band: start, end (exclusive), matched words. A match scores 4 and a mismatch or gap -1, so that words beyond an edit count as long as coverage may reach a fifth; of equal scores most matches, then the earliest end."""
    n, lo = len(words), diagonal - band
    t, w = template.tolist(), words[max(0, lo) : max(0, diagonal + len(template) + drift + band)].tolist()
    base = max(0, lo)
    width = 2 * band + drift + 1
    above = [(0, 0, 0)] * (width + 1)  # (score, matches, start) by e; start is where the path began
    best = (0, 0, 0, 0)  # score, matches, start, end
    for i, x in enumerate(t):
        row = []
        left = (0, 0, 0)
        for e in range(width):
            j = i + lo + e
            cell = (0, 0, max(0, j + 1))
            if 0 <= j < n and j - base < len(w):
                same = w[j - base] == x
                s, m, b = above[e]
                if s == 0:
                    m, b = 0, j
                step = (s + (4 if same else -1), m + same, b)
                up, back = above[e + 1], left
                for c in (step, (up[0] - 1, *up[1:]), (back[0] - 1, *back[1:])):
                    if c[0] > cell[0] or c[0] == cell[0] and c[1] > cell[1]:
                        cell = c
                if cell[0] > best[0] or cell[0] == best[0] and cell[1] > best[1]:
                    best = (*cell, j + 1)
            row.append(cell)
            left = cell
        above = [*row, (0, 0, 0)]
    return best[2], best[3], best[1]


def find(text: str, index: Index, known: WordHashes, coverage: float, band: int) -> list[tuple]:
    words = word_hashes(text, known)
    found = []
    for t, diagonal, drift in index.regions(words, band):
        template = index.words[t]
        start, end, matched = align(template, words, diagonal, index.band(t, band), drift)
        if matched >= coverage * len(template) - 1e-9:
            found.append((index.names[t], start, end, matched, len(template)))
    kept: list[tuple] = []
    for name, start, end, matched, size in sorted(found, key=lambda x: (x[4] - 2 * x[3], x[1], x[0])):  # matched less missed words, most first
        if not any(min(end, k[2]) - max(start, k[1]) > (0 if k[0] == name else min(end - start, k[2] - k[1]) // 2) for k in kept):
            kept.append((name, start, end, matched, size))
    if not kept:
        return []
    place = [m.span() for m in re.finditer(r"\S+", text)]
    return [(name, s, e, place[s][0], place[e - 1][1], m, n, m / n) for name, s, e, m, n in sorted(kept, key=lambda x: (x[1], x[0]))]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """A row per finding: doc_id, license, start_word and end_word (words split at white space, end exclusive), start and end (characters), matched_words, template_words, coverage.

    Words compare in lower case without punctuation at their ends. A template's findings in a document don't overlap, and those of different templates share at most half of the shorter one's words: where they share more, the better one stays. Null and empty texts have none; repeated rows and null ids give findings of their own; texts are scanned whole; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates, coverage))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, index = WordHashes(), sent.value
        for pdf in batches:
            rows = [(i, *f) for i, t in zip(pdf["doc_id"].array, pdf["text"]) if t for f in find(t, index, known, coverage, band)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, _FOUND)
