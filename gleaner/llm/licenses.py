"""License scans: fingerprints and counts of words pick candidates, banded alignment confirms.

Templates are few and fixed, so their fingerprints and words travel to every task
as an inverted index; documents are read once and nothing is shuffled. Winnowed
fingerprints find what keeps a run of words, however far the rest has moved.
Counts of a template's words find the rest: no place that holds enough of them,
in order and moved by no more than ``reach``, is missed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.words import PUNCTUATION, Words, slices, window_hashes
from gleaner.runtime import ship_code

#: Words in a gram, and grams in a window of which one is a fingerprint: a common
#: run of GRAM + WINNOW - 1 words always shares one.
GRAM, WINNOW = 3, 3
#: Words that may be missing or extra between fingerprints and the full template.
BAND = 8
MIN_COVERAGE = 0.8

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
#: Fixed texts: short notices, the opening grants of common public licenses, and the whole of short ones.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "spdx-line": "SPDX-License-Identifier:",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause-text": _BSD + _AS_IS,
    "bsd-3-clause-text": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. " + _AS_IS
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
}


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for words in slices(pa.array(texts, pa.string()), lower=True, breaks=PUNCTUATION):
        out += [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return out


def winnow(grams: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the fingerprints: of each window the last of its smallest grams."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.arange(len(grams))[grams == grams.min()][-1:] if len(grams) else np.zeros(0, np.int64)
    views = np.stack([grams[k : k + n] for k in range(window)])
    last = window - 1 - views[::-1].argmin(axis=0)
    return np.unique(last + np.arange(n))


@dataclass
class Index:
    """Fingerprints, sorted, with the template and place of each."""

    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    vocabulary: np.ndarray  # words of all templates, sorted
    spots: list[dict[int, list[int]]]  # of each template the places of its words, by place in the vocabulary

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        words = _hashes(list(templates.values()))
        rows = []
        for t, w in enumerate(words):
            grams = window_hashes(w, GRAM)
            rows += [(int(grams[p]), t, int(p)) for p in winnow(grams)]
        rows.sort()
        prints, owners, places = zip(*rows, strict=True) if rows else ((), (), ())
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        spots: list[dict[int, list[int]]] = [defaultdict(list) for _ in words]
        for t, w in enumerate(words):
            for i, v in enumerate(np.searchsorted(vocabulary, w).tolist()):
                spots[t][v].append(i)
        return cls(list(templates), words, np.array(prints, np.uint64), np.array(owners, np.int64), np.array(places, np.int64), vocabulary, spots)


def align(template: list[int], words: list[int], width: int) -> tuple[int, int, int]:
    """(matched, first, end): the longest common subsequence inside a band.

    Word j may stand for template word i only if i <= j <= i + width. ``first`` and
    ``end`` bound the matched words; of equally long matches the later start wins.
    """
    none = (0, -1, -1)  # matched, start, last matched
    before = [none] * (width + 2)  # by j - i for the row above, one more at the end
    for i, t in enumerate(template):
        row = [none] * (width + 2)
        for d in range(width + 1):
            j = i + d
            left = row[d - 1] if d else none
            up = before[d + 1]
            best = left if left[:2] >= up[:2] else up
            if j < len(words) and words[j] == t:
                n, start, _ = before[d]
                step = (n + 1, start if n else j, j)
                best = max(best, step, key=lambda c: c[:2])
            row[d] = best
        before = row
    n, start, last = max(before, key=lambda c: c[:2])
    return n, start, last + 1


def _near(size: int, band: int) -> int:
    """The band for a template of ``size`` words: else two short notices in a row would be one."""
    return min(band, max(1, size // 2))


def reach(size: int, band: int, need: int) -> int:
    """Words by which parts of a place may have moved apart: all that may be missing, or twice the band."""
    return min(size - 1, max(2 * _near(size, band), size - need))


def _matches(words: Words, index: Index, band: int, least: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(text, template, first word, end word, matched, coverage), words counted in the slice."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for text, t, got in _by_prints(words, index, band, least):
        found[text, t] += got
    for text, t, got in _by_words(words, index, band, least, found):
        found[text, t] += got
    for text, t in sorted(found):
        low = int(words.first[text])
        for n, first, last in _without_overlap(found[text, t]):
            yield text, t, low + first, low + last, n, n / len(index.words[t])


def _by_words(
    words: Words, index: Index, band: int, least: float, found: dict[tuple[int, int], list[tuple[int, int, int]]]
) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(text, template, matches) wherever enough words of a template stand close together, in any order."""
    if not len(index.vocabulary):
        return
    which = np.searchsorted(index.vocabulary, words.hashes)
    hits = np.flatnonzero(index.vocabulary[np.minimum(which, len(index.vocabulary) - 1)] == words.hashes)
    which, texts = which[hits], np.searchsorted(words.first, hits, side="right") - 1
    for t, template in enumerate(index.words):
        size = len(template)
        need = max(1, math.ceil(least * size))
        if not size or need > size:
            continue
        width = reach(size, band, need)
        member = np.zeros(len(index.vocabulary), dtype=bool)
        member[list(index.spots[t])] = True
        mine = np.flatnonzero(member[which])
        at, text = hits[mine], texts[mine]
        m = len(at) - need + 1
        if m <= 0:
            continue
        dense = np.flatnonzero((at[need - 1 :] - at[:m] < size + width) & (text[need - 1 :] == text[:m]))
        if not len(dense):
            continue
        steps = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(steps, dense, 1)
        np.add.at(steps, dense + need, -1)
        kept = np.flatnonzero(np.cumsum(steps[:-1]))
        at, text, word = at[kept], text[kept], which[mine[kept]]
        for x in np.unique(text).tolist():
            a, b = np.searchsorted(text, [x, x + 1])
            low, high = int(words.first[x]), int(words.first[x + 1])
            spots, where, what = index.spots[t], at[a:b] - low, word[a:b]
            for n, first, last in found.get((x, t), ()):
                if n == size:  # what overlaps a full match would be dropped
                    rest = (where < first) | (where >= last)
                    where, what = where[rest], what[rest]
            close = _close(where.tolist(), what.tolist(), spots, need, size + width)
            if close:
                got = _by_diagonals(template.tolist(), spots, words.hashes[low:high], close, need, width)
                if got:
                    yield x, t, got


def _close(at: list[int], word: list[int], spots: dict[int, list[int]], need: int, span: int) -> list[tuple[int, int]]:
    """(place, word) in runs of ``span`` words with ``need`` of the template's, each word counted as often as the template has it."""
    have: dict[int, int] = defaultdict(int)
    count = first = upto = 0
    out: list[tuple[int, int]] = []
    for k, (p, w) in enumerate(zip(at, word, strict=True)):
        have[w] += 1
        count += have[w] <= len(spots[w])
        while p - at[first] >= span:
            have[word[first]] -= 1
            count -= have[word[first]] < len(spots[word[first]])
            first += 1
        if count >= need:
            begin = max(first, upto)
            out += zip(at[begin : k + 1], word[begin : k + 1], strict=True)
            upto = k + 1
    return out


def _by_diagonals(
    template: list[int], spots: dict[int, list[int]], known: np.ndarray, hits: list[tuple[int, int]], need: int, width: int
) -> list[tuple[int, int, int]]:
    """Matches from each diagonal (place in the text less place in the template) with enough words within ``width``."""
    diagonals, places = np.array(sorted((p - i, p) for p, w in hits for i in spots[w]), dtype=np.int64).T
    free, got = np.ones(len(places), dtype=bool), []
    for low in np.unique(diagonals).tolist():
        a, b = np.searchsorted(diagonals, [low, low + width + 1])
        if free[a:b].sum() < need:
            continue
        lead = max(0, -low)  # the text may begin inside the template
        part = [-1] * lead + known[low + lead : max(0, low + len(template) + width)].tolist()
        n, first, last = align(template, part, width)
        if n >= need:
            got.append((n, low + first, low + last))
            if n == len(template):
                free &= (places < low + first) | (places >= low + last)
    return got


def _by_prints(words: Words, index: Index, band: int, least: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(text, template, matches) around the winnowed fingerprints, words counted in the text."""
    grams = window_hashes(words.hashes, GRAM)
    if not len(grams) or not len(index.prints):
        return
    found = np.searchsorted(index.prints, grams)
    maybe = np.flatnonzero(index.prints[np.minimum(found, len(index.prints) - 1)] == grams)
    if not len(maybe):
        return
    texts = np.searchsorted(words.first, maybe, side="right") - 1
    for text in np.unique(texts):
        low, high = int(words.first[text]), int(words.first[text + 1])
        mine = window_hashes(words.hashes[low:high], GRAM)
        starts: dict[int, set[int]] = defaultdict(set)
        for p in winnow(mine):
            k = int(np.searchsorted(index.prints, mine[p]))
            while k < len(index.prints) and index.prints[k] == mine[p]:
                starts[int(index.owners[k])].add(int(p) - int(index.places[k]))
                k += 1
        known = words.hashes[low:high].tolist()
        for t, at in starts.items():
            template, got = index.words[t].tolist(), []
            near = _near(len(template), band)
            for begin, end in _clusters(sorted(at), near):
                a = begin - near
                lead = max(0, -a)  # the text may begin inside the template
                n, first, last = align(template, [-1] * lead + known[a + lead : max(0, end + len(template) + near)], end + 2 * near - a)
                if n >= least * len(template):
                    got.append((n, a + first, a + last))
            if got:
                yield int(text), t, got


def _clusters(starts: list[int], band: int) -> Iterator[tuple[int, int]]:
    """Runs of supposed first words with steps of at most ``band`` and a bounded length."""
    begin = last = starts[0]
    for s in starts[1:]:
        if s - last >= band or s - begin > 2 * band:
            yield begin, last
            begin = s
        last = s
    yield begin, last


def _without_overlap(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest matches first, of equally long ones the closest together, each one only if no chosen one shares a word with it."""
    chosen: list[tuple[int, int, int]] = []
    for m in sorted(set(found), key=lambda m: (-m[0], m[2] - m[1], m[1])):
        near = [c for c in chosen if m[1] < c[2] and c[1] < m[2]]
        if not near:
            chosen.append(m)
    return sorted(chosen, key=lambda m: m[1])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per place in a text that matches a template well enough.

    Columns: doc_id, license, start and end (characters of the text, end excluded),
    matched (template words found in order) and coverage (matched over all words of
    the template). Words are compared without case and punctuation.

    Null and empty texts and texts without a match give no rows; repeated rows give
    theirs again. A null doc_id is carried along. Other columns are not looked at.
    Without templates, or with templates that have no words, nothing matches.
    """
    ship_code(docs.sparkSession)
    index = Index.of(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids, rows = batch.column("text"), batch.column("doc_id"), []
            for words in slices(column, lower=True, breaks=PUNCTUATION):
                for text, t, a, b, n, share in _matches(words, index, band, min_coverage):
                    row = words.rows.start + text
                    raw = column[row].as_py().encode("utf-8")
                    base = _text_start(words, text, raw)
                    start, end = int(words.starts[a]) - base, int(words.ends[b - 1]) - base
                    chars = len(raw[:start].decode("utf-8"))
                    rows.append((ids[row].as_py(), index.names[t], chars, chars + len(raw[start:end].decode("utf-8")), n, share))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            names = ["doc_id", "license", "start", "end", "matched", "coverage"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, license string, start long, end long, matched long, coverage double")


def _text_start(words: Words, text: int, raw: bytes) -> int:
    """Byte where the text begins: its first word's place, less what stands before that word."""
    first = int(words.starts[words.first[text]])
    lead = int(np.flatnonzero(~PUNCTUATION[np.frombuffer(raw, dtype=np.uint8)])[0])
    return first - lead


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
