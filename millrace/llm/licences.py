"""Licence texts in documents, by Dice coefficient over word bigrams.

Lines, paragraphs and whole texts are the units. A unit is compared with a template only if
their sizes allow the threshold: with ``a`` and ``b`` bigrams the coefficient is at most
``2 min(a, b) / (a + b)``; and only if enough of its bigrams stand in any template at all.
Both bounds are exact. Documents are judged one by one, whole, without a shuffle.

Each template also slides over the words of the whole text, line feeds aside, so a notice amid
prose and a licence of many paragraphs are windows of their own. A window shorter than its
template counts as long as the template, unless it begins and ends where a sentence does: cutting
off the words that differ must not raise the coefficient. Of windows that share most of their
known bigrams the one with the largest gain (``2 * common - threshold * sizes``) counts, and one
that a unit has found under the same name with no smaller coefficient does not count again.

Defined results. Null or wordless text: no match. A unit of one word has no bigram and matches
nothing. Ties: the larger coefficient, then the first name. Repeated rows: one result each. Empty
table: empty result. The result columns replace columns of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.8
#: Bounds are widened by this much, so that rounding excludes nothing at the threshold.
EDGE = 1e-6
#: Words of all templates together; larger sets have to be scanned in several calls.
MAX_TEMPLATE_WORDS = 2_000_000

#: Licence texts and notices.
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. " + WARRANTY,
        WARRANTY, "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        DISCLAIMER,
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
CREATIVE = {
    f"CC-{kind}-{version}": (f"Licensed under CC {kind} {version}.", f"This work is licensed under CC {kind} {version}.")
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0")
}
#: Notices of licences that TEMPLATES does not name, and the forms in which licences are usually mentioned.
NOTICES = {
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
#: Full texts by name, from files beside this one; read on the driver.
FULL_TEXTS = {p.stem: (p.read_text(),) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
#: Sentence ends and line feeds, in bytes.
BREAK = re.compile(rb"""[.!?;:]["')\]]*(?=[ \t\r\n])|\n""")
#: Bytes to word characters in lower case; a line feed becomes a mark of its own, all others blanks.
FOLD = bytes(10 if b == 10 else b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LINE = b"\x01"


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; line feeds as the word ``LINE``."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).replace(b"\n", b" \x01 ").split()


def all_templates() -> dict[str, tuple[str, ...]]:
    sets = (TEMPLATES, CREATIVE, NOTICES, FULL_TEXTS)
    return {name: tuple(t for s in sets for t in s.get(name, ())) for name in dict.fromkeys(n for s in sets for n in s)}


def breaks_of(text: str, n_words: int) -> np.ndarray:
    """For each place between words, 0 to ``n_words``, whether a sentence or line begins or ends there."""
    raw = BREAK.sub(b"\n", text.encode("utf-8", "surrogatepass")).translate(FOLD).replace(b"\n", b" \x01 ").split()
    mark = np.fromiter((w == LINE for w in raw), bool, len(raw))
    found = np.zeros(n_words + 1, bool)
    found[(np.cumsum(~mark))[mark]] = True
    found[[0, -1]] = True
    return found


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Sizes that can reach the threshold with ``n`` bigrams."""
    return n * threshold / (2 - threshold) - EDGE, n * (2 - threshold) / threshold + EDGE


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float) -> None:
        self.threshold = threshold
        split = [(name, words_of(" ".join(text.split()))) for name, texts in templates.items() for text in texts]
        if sum(len(words) for _, words in split) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"more than {MAX_TEMPLATE_WORDS} template words: scan in several calls")
        # 0: in no template; 1: a line feed
        self.numbers = {LINE: 1} | {w: i + 2 for i, w in enumerate(sorted({w for _, words in split for w in words}))}
        self.base = len(self.numbers) + 2
        self.rows = sorted((len(words) - 1, name, Counter(self.bigrams(self.numbered(words)).tolist())) for name, words in split if len(words) > 1)
        self.sizes = [n for n, _, _ in self.rows]
        self.known = np.array(sorted({g for _, _, grams in self.rows for g in grams}), np.int64)
        self.least = [size_bounds(n, threshold)[0] for n in self.sizes]
        self.holders: dict[int, list[int]] = defaultdict(list)
        for k, (_, _, grams) in enumerate(self.rows):
            for g in grams:
                self.holders[g].append(k)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))

    def bigrams(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:-1] * self.base + numbers[1:]

    def is_known(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(grams), bool)
        return self.known[np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)] == grams

    def units(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, end) of lines, of paragraphs of several lines, and of the whole text."""
        feeds = np.concatenate([[-1], np.flatnonzero(numbers == 1), [len(numbers)]])
        starts, ends = feeds[:-1] + 1, feeds[1:]
        full = ends > starts
        yield from zip(starts[full].tolist(), ends[full].tolist(), strict=True)
        if full.sum() < 2:
            return
        group = np.cumsum(~full)[full]  # lines without an empty one between them
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        last = np.append(first[1:], len(group)) - 1
        a, b = starts[full][first], ends[full][last]
        several = last > first
        yield from zip(a[several].tolist(), b[several].tolist(), strict=True)
        if len(first) > 1:
            yield int(a[0]), int(b[-1])

    def matches(self, text: str | None) -> list[tuple[float, str]]:
        """(coefficient, name) of the best template of every unit that reaches the threshold."""
        return [(dice, name) for dice, name, _, _ in self.unit_matches(self.numbered(words_of(text)))]

    def notices(self, text: str | None) -> list[tuple[float, str]]:
        """(coefficient, name) of the units that reach the threshold, and of the windows that no unit has found."""
        numbers = self.numbered(words_of(text))
        units = self.unit_matches(numbers)
        windows = [
            (dice, name) for dice, name, a, b in self.windows(text, numbers[numbers != 1])
            if not any(n == name and d >= dice and a < y and x < b for d, n, x, y in units)
        ]
        return [(dice, name) for dice, name, _, _ in units] + windows

    def unit_matches(self, numbers: np.ndarray) -> list[tuple[float, str, int, int]]:
        """(coefficient, name, start, end) of units, by bigrams of the text without line feeds."""
        known = np.concatenate([[0], np.cumsum(self.is_known(self.bigrams(numbers)))]) if len(numbers) > 1 else np.zeros(2, np.int64)
        if not known[-1]:
            return []
        out = []
        words = np.concatenate([[0], np.cumsum(numbers != 1)])  # places without the line feeds
        share = self.threshold / (2 - self.threshold)
        for start, end in self.units(numbers):
            # Within one line the bigrams of the unit are those of the text; feeds only lower the count.
            feeds = 0 if end - start < 2 else int((numbers[start:end] == 1).sum())
            size = end - start - feeds - 1
            if size < 1 or known[end - 1] - known[start] + feeds < share * size - EDGE:
                continue
            own = numbers[start:end]
            found = self.best(Counter(self.bigrams(own[own != 1]).tolist()), size)
            if found:
                out.append((*found, int(words[start]), int(words[end]) - 1))
        return out

    def areas(self, known: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of bigrams that cover every window with enough known ones."""
        # A window reaches the threshold only if its share of known bigrams is threshold / (2 - threshold).
        level = np.concatenate([[0.0], np.cumsum(known - (self.threshold / (2 - self.threshold) - EDGE))])
        inside = np.minimum.accumulate(level)[:-1] <= np.maximum.accumulate(level[::-1])[::-1][1:]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        total = np.concatenate([[0], np.cumsum(known)])
        enough = total[ends] - total[starts] >= size_bounds(self.sizes[0], self.threshold)[0]
        yield from zip(starts[enough].tolist(), ends[enough].tolist(), strict=True)

    def windows(self, text: str | None, numbers: np.ndarray) -> list[tuple[float, str, int, int]]:
        """(coefficient, name, start, end) of the best windows, by bigrams of the text without line feeds."""
        if len(numbers) < 2 or not self.rows:
            return []
        grams = self.bigrams(numbers)
        known = self.is_known(grams)
        if not known.any():
            return []
        found: list[tuple[float, float, int, str, int, int]] = []
        breaks = None
        for start, end in self.areas(known):
            inside = Counter(grams[start:end][known[start:end]].tolist())
            largest = bisect_right(self.least, inside.total())  # rows are sorted by size
            common: dict[int, int] = defaultdict(int)
            for g, c in inside.items():
                for k in self.holders[g]:
                    if k >= largest:
                        break
                    common[k] += min(c, self.rows[k][2][g])
            candidates = [k for k, c in common.items() if c >= self.least[k]]
            if not candidates:
                continue
            if breaks is None:
                breaks = breaks_of(text or "", len(numbers))
            distinct, ids = np.unique(grams[start:end], return_inverse=True)
            for k in candidates:
                other = self.rows[k][2]
                limit = np.fromiter((other.get(g, 0) for g in distinct.tolist()), np.int64, len(distinct))
                for dice, size, a, b in self.slide(k, ids, limit, breaks[start:end + 2]):
                    gain = (dice - self.threshold) * (size + self.rows[k][0])
                    found.append((-gain, -dice, k, self.rows[k][1], start + a, start + b))
        taken = np.zeros(len(grams), bool)
        out = []
        for _, minus, k, name, a, b in sorted(found, key=lambda f: (f[0], f[1], f[3], f[4], f[5], f[2])):
            own = a + np.flatnonzero([g in self.rows[k][2] for g in grams[a:b].tolist()])
            if 2 * taken[own].sum() <= len(own):
                taken[own] = True
                out.append((-minus, name, a, b))
        return out

    def slide(self, k: int, ids: np.ndarray, limit: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[float, int, int, int]]:
        """(coefficient, size, start, end) of the best window for each end where one can lie."""
        n = self.rows[k][0]
        high = int(size_bounds(n, self.threshold)[1])
        order = np.argsort(ids, kind="stable")
        first = np.searchsorted(ids[order], np.arange(len(limit)))
        rank = np.empty(len(ids), np.int64)  # equal bigrams before this one
        rank[order] = np.arange(len(ids)) - first[ids[order]]
        held = limit[ids] > 0
        # Past a held bigram that is not in surplus a window only improves, so it ends elsewhere or at a break.
        grows = np.append(held & (rank < limit[ids]), False)[1:]
        ends = np.flatnonzero((held & ~grows) | breaks[2:])
        total = np.zeros(len(limit), np.int64)
        done = 0
        for e in ends.tolist():
            np.add.at(total, ids[done:e + 1], 1)
            done = e + 1
            low = max(0, e + 1 - high)
            own = ids[low:e + 1][::-1]
            shared = np.cumsum(total[own] - rank[low:e + 1][::-1] <= limit[own])
            size = np.arange(1, len(own) + 1)
            counted = np.maximum(size, n)
            if breaks[e + 2]:
                counted = np.where(breaks[low:e + 1][::-1], size, counted)
            dice = 2 * shared / (counted + n)
            best = int(np.argmax(dice))
            if dice[best] >= self.threshold:
                yield float(dice[best]), int(counted[best]), e - best, e + 1

    def best(self, grams: Counter, size: int) -> tuple[float, str] | None:
        low, high = size_bounds(size, self.threshold)
        found: tuple[float, str] | None = None
        for k in range(int(np.searchsorted(self.sizes, low)), int(np.searchsorted(self.sizes, high, "right"))):
            n, name, other = self.rows[k]
            dice = 2 * sum(min(c, other[g]) for g, c in grams.items() if g in other) / (size + n)
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found


def scan_licences(
    documents: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, text: str = "text",
) -> DataFrame:
    """Add ``license`` and ``dice`` (best unit, or null), ``licenses`` (names, sorted) and ``n_units``."""
    added = {"license": "string", "dice": "double", "licenses": "string", "n_units": "bigint"}
    documents = documents.drop(*added)
    schema = documents.select("*", *[F.lit(None).cast(t).alias(n) for n, t in added.items()]).schema
    templates = templates or all_templates()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared = Templates(templates, threshold)
        for batch in batches:
            found = [compared.notices(t) for t in batch.column(text).to_pylist()]
            best = [min(f, key=lambda m: (-m[0], m[1])) if f else (None, None) for f in found]
            batch = batch.append_column("license", pa.array([b[1] for b in best], pa.string()))
            batch = batch.append_column("dice", pa.array([b[0] for b in best], pa.float64()))
            batch = batch.append_column("licenses", pa.array([",".join(sorted({n for _, n in f})) for f in found], pa.string()))
            yield batch.append_column("n_units", pa.array([len(f) for f in found], pa.int64()))

    return documents.mapInArrow(scan, schema)
