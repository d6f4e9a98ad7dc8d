"""License scan by patience alignment.

Each text is compared with templates of license notices. Documents and templates whose common words
cannot reach the wanted coverage are ruled out by counting words. In the others, words of
the template that stand close together form regions; each region is aligned with the template:

* anchors are words that occur once in both, kept in the longest increasing subsequence;
* the gaps between anchors are aligned in the same way, where more words are unique;
* a gap without a unique common word keeps its common beginning and end.

Coverage is the share of template words that are aligned. A region is a match from ``COVERAGE`` on
if also at least ``DENSITY`` of its words between the first and the last aligned one are aligned. Whatever the
coverage, the words that name the license and its version must be aligned, and no word that makes it
another license (``QUALIFIERS``) may stand between the aligned ones.

Row-local: one Arrow pass over whole texts, with the templates sent along (a fixed, small list).

Defined results: a null or empty text and one without a match have no licenses, a null ``license``
and coverage 0. Of matches at one place that with the most aligned words wins, then the higher
coverage, then the first name. Repeated rows each get a row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadloom.llm.textarrays import ALNUM, chunks, words
from broadloom.llm.rows import prepare

COVERAGE = 0.8
DENSITY = 0.5
#: Words between two template words of one region.
GAP = 8

# Texts of common license notices, by SPDX name, with the words that tell a license and its
# version from its relatives.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "apache 2 0",
    ),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
        "",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        "gnu general public 3",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
        "gnu general public 2",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2 1"),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        "gnu lesser 3",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version.",
        "gnu lesser 2 1",
    ),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        "gnu affero 3",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd 4 0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "creative commons attribution 4 0",
    ),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "creative commons attribution sharealike 4 0",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
        "waived",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "endorse promote",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "fee",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "unencumbered public domain",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0"),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0.",
        "eclipse 2 0",
    ),
)
# Words that make a notice one of another license wherever they stand in it.
QUALIFIERS = "affero lesser library nc nd sa sharealike noncommercial noderivatives noderivs"


def _rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            at.append(i)
        else:
            tops[pile], at[pile] = value, i
        before.append(at[pile - 1] if pile else -1)
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(left[a:b]), Counter(right[c:d])
        place = {w: i for i, w in enumerate(right[c:d], c) if theirs[w] == 1}
        common = [(i, place[w]) for i, w in enumerate(left[a:b], a) if ours[w] == 1 and w in place]
        anchors = [common[k] for k in _rising([j for _, j in common])]
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            todo += [
                (i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)
            ]
    return sorted(out)


def _hashed(texts: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        found = words(data, offsets, ALNUM)
        out += [found.hashes[a:b].tolist() for a, b in zip(found.first[:-1], found.first[1:])]
    return out


class Templates:
    """Templates as word hashes, and how often each needs each word of the common vocabulary."""

    def __init__(self, templates: tuple[tuple[str, ...], ...]):
        self.names = [template[0] for template in templates]
        self.words = _hashed([template[1] for template in templates])
        telling = _hashed([template[2] if len(template) > 2 else "" for template in templates])
        #: Places that must be aligned: where each telling word stands first.
        self.wanted = [{own.index(w) for w in tell} for own, tell in zip(self.words, telling, strict=True)]
        qualifiers = set(_hashed([QUALIFIERS])[0])
        self.foreign = [qualifiers - set(own) for own in self.words]
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], np.uint64))
        self.needs = np.zeros((len(self.words), len(self.vocabulary)), np.int64)
        for k, t in enumerate(self.words):
            np.add.at(self.needs[k], np.searchsorted(self.vocabulary, np.array(t, np.uint64)), 1)

    def scan(self, found, text: int, k: int, at: np.ndarray, terms: np.ndarray, coverage: float, density: float):
        """(coverage, first word, end word) of all matches of template ``k`` in one text; they may overlap."""
        mine = self.needs[k][terms] > 0
        at, terms = at[mine], terms[mine]
        template = self.words[k]
        matches = []
        for region in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > GAP) + 1):
            enough = np.minimum(np.bincount(terms[region], minlength=self.needs.shape[1]), self.needs[k]).sum()
            if enough < coverage * len(template):
                continue
            # A long region may hold several notices: overlapping windows of twice the template.
            low, high, size = int(at[region[0]]), int(at[region[-1]]) + 1, 2 * len(template)
            for start in range(low, max(low + 1, high - len(template)), len(template)):
                own = found.hashes[start : min(start + size, high)].tolist()
                pairs = align(own, template)
                if not pairs:
                    continue
                span = pairs[-1][0] - pairs[0][0] + 1
                share = len(pairs) / len(template)
                if not self.wanted[k] <= {j for _, j in pairs}:
                    continue
                if not self.foreign[k].isdisjoint(own[pairs[0][0] : pairs[-1][0] + 1]):
                    continue
                if share >= coverage and len(pairs) >= density * span:
                    matches.append((share, start + pairs[0][0], start + pairs[-1][0] + 1))
        return matches


_FIELDS = "license string, coverage double, first_word long, end_word long, n_matches long, licenses string"


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, ...], ...] = TEMPLATES,
    coverage: float = COVERAGE,
    density: float = DENSITY,
) -> DataFrame:
    """Per document its best license with place and coverage, and all licenses found.

    Places are word numbers in the whole text. A match of a template counts only if no better match
    covers the same place, so a notice is not reported as its shorter relatives; its other matches stay.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        sizes = np.array([len(t) for t in known.words])
        for batch in batches:
            for row, n, data, offsets in chunks(batch.column(1)):
                found = words(data, offsets, ALNUM)
                slot = np.minimum(np.searchsorted(known.vocabulary, found.hashes), len(known.vocabulary) - 1)
                at = np.flatnonzero(known.vocabulary[slot] == found.hashes)
                terms = slot[at]
                text = np.searchsorted(found.first, at, "right") - 1
                counts = np.bincount(text * len(known.vocabulary) + terms, minlength=n * len(known.vocabulary))
                counts = counts.reshape(n, -1)
                possible = np.stack([np.minimum(counts, need).sum(1) for need in known.needs], 1)
                out: list[tuple] = [(None, 0.0, None, None, 0, "")] * n
                edges = np.searchsorted(text, np.arange(n + 1))
                for i in np.flatnonzero((possible >= coverage * sizes).any(1)).tolist():
                    mine = slice(edges[i], edges[i + 1])
                    hits = []
                    for k in np.flatnonzero(possible[i] >= coverage * sizes).tolist():
                        start = int(found.first[i])
                        for share, first, end in known.scan(
                            found, i, k, at[mine], terms[mine], coverage, density
                        ):
                            hits.append((share, int(sizes[k]), known.names[k], first - start, end - start))
                    out[i] = _best(hits) or out[i]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n), pa.array(columns[0], pa.string()), pa.array(columns[1]),
                        *(pa.array(c, pa.int64()) for c in columns[2:5]), pa.array(columns[5], pa.string()),
                    ],
                    names=["doc_id", *(f.split()[0] for f in _FIELDS.split(", "))],
                )

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, {_FIELDS}")


def _best(hits: list[tuple]) -> tuple | None:
    kept: list[tuple] = []
    # First and end words of the kept matches, which do not overlap, in order of their places.
    firsts: list[int] = []
    ends: list[int] = []
    for hit in sorted(hits, key=lambda h: (-round(h[0] * h[1]), -h[0], h[2], h[3])):
        i = bisect_left(firsts, hit[4])
        if not i or ends[i - 1] <= hit[3]:
            kept.append(hit)
            firsts.insert(i, hit[3])
            ends.insert(i, hit[4])
    if not kept:
        return None
    share, _, name, first, end = kept[0]
    return name, share, first, end, len(kept), ",".join(sorted({hit[2] for hit in kept}))
