"""License scans: MinHash bands over overlapping text windows retrieve license templates.

Words are lower-cased letters and digits, shingles are SHINGLE words. Templates fall into
levels by size: level k has 2^(k-1) + 1 .. 2^k shingles. For each level every text is cut into
windows of 1.5 * 2^k shingles that start every 2^(k-1) shingles, so that a whole copy of a
template lies in one window, whatever its place. A window and a template are compared by
the minima of independent hashes, one row to a band: any equal minimum retrieves the
template. A copy with 0.8 of a template's shingles has at least `least_similarity` with its
window, and a level has as many bands as it takes to miss such a copy with a probability
below MISSED, one in a million (about 13 bands for the shortest, 48 for the longest). A
window of one shingle is retrieved always. What is retrieved is verified by the exact
share of the template's shingles that the window has.

Licenses share much of their wording. So a match needs OWN_SHARE of the shingles that tell
its template from each similar one of another license (a version, Affero or Lesser, the
third clause), and a place in the text counts once: the match with the most shingles takes
it, and one of another license with half of its own there is dropped. The opening that the
BSD licenses have in common is `BSD` where neither whole text follows.

The templates are a fixed, small table. One arrow_udf reads each whole text; nothing is
shuffled. A null, empty or very short text has no shingles and no license. Equal rows get
equal results; other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import math
import pkgutil
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_ALNUM, chunks, mix, window_hashes

SHINGLE = 5
MIN_SHARE = 0.8
MISSED = 1e-6
SIMILAR = 0.5  # of a template's shingles are in another: that one is similar
OWN_SHARE = 0.5

# Public license notices and the opening clauses of license texts.
NOTICES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# ... and whole texts, a file each.
WHOLE = (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-1.0", "GPL-2.0",
    "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0",
)


def whole_text(name: str) -> str:
    return (pkgutil.get_data(__package__, f"license_texts/{name}.txt") or b"").decode()


TEMPLATES = (*NOTICES, *((name, whole_text(name)) for name in WHOLE))


def least_similarity(size: int, window: int, share: float = MIN_SHARE) -> float:
    """Of a window and a template of so many shingles with this share of them in it."""
    shared = -(-share * size // 1)
    return shared / (window + size - shared)


def bands_for(similarity: float) -> int:
    """Bands of one minimum each that miss a pair with a probability below MISSED."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log(1 - similarity))


def _seed(band: int) -> np.uint64:
    return mix(np.array([band + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def _hashed(shingles: np.ndarray, seed: np.uint64) -> np.ndarray:
    """An independent order of already well-mixed hashes."""
    return (shingles ^ seed) * (seed | np.uint64(1))


@dataclass
class Level:
    """Templates of one size level, with the minima to find them by, a band each."""

    size: int  # 2^k shingles
    templates: list[int]
    minima: list[np.ndarray]  # for each band, the templates' least values

    @property
    def stride(self) -> int:
        return max(1, self.size // 2)

    @property
    def blocks(self) -> int:
        """Strides in a window."""
        return 1 if self.size == 1 else 3


@dataclass
class Library:
    names: list[str]
    shingles: list[np.ndarray]
    own: list[list[np.ndarray]]  # for each similar template, the shingles it has not
    levels: list[Level]


def _own(names: list[str], found: list[np.ndarray]) -> list[list[np.ndarray]]:
    own: list[list[np.ndarray]] = []
    for name, shingles in zip(names, found):
        others = (np.setdiff1d(shingles, s) for n, s in zip(names, found) if n != name)
        most = (1 - SIMILAR) * len(shingles)
        own.append([o for o in others if 0 < len(o) <= most])
    return own


def build_library(templates: Sequence[tuple[str, str]]) -> Library:
    names, found = [], []
    for chunk in chunks(pa.array([text for _, text in templates], pa.string())):
        lowered = chunk.lower()
        words = lowered.words(NOT_ALNUM)
        hashes = lowered.hashes(words)
        starts = words.windows(SHINGLE)
        keys = window_hashes(hashes, starts, SHINGLE)
        for i in range(len(chunk)):
            own = np.unique(keys[words.text_of[starts] == i])
            if not len(own):
                raise ValueError(f"a template has at least {SHINGLE} words")
            names.append(templates[chunk.first + i][0])
            found.append(own)
    levels = []
    exponents = [int(np.ceil(np.log2(len(s)))) for s in found]
    for k in sorted(set(exponents)):
        chosen = [i for i, e in enumerate(exponents) if e == k]
        level = Level(1 << k, chosen, [])
        window = level.stride * level.blocks
        least = min(least_similarity(len(found[i]), window) for i in chosen)
        for band in range(bands_for(least)):
            seed = _seed(band)
            level.minima.append(np.array([_hashed(found[i], seed).min() for i in chosen]))
        levels.append(level)
    return Library(names, found, _own(names, found), levels)


@lru_cache(maxsize=4)
def _library(templates: tuple) -> Library:
    return build_library(templates)


@dataclass
class Blocks:
    """The shingles of some texts in disjoint blocks of one stride; a window is a run of
    `level.blocks` of them in one text."""

    level: Level
    starts: np.ndarray  # first shingle of each block
    text: np.ndarray
    finer: np.ndarray  # first block of the next finer stride

    @staticmethod
    def cut(level: Level, bounds: np.ndarray, finer: Blocks | None) -> Blocks:
        counts = -(-np.diff(bounds) // level.stride)
        text = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = bounds[text] + number * level.stride
        below = starts if finer is None else np.searchsorted(finer.starts, starts)
        return Blocks(level, starts, text, below)

    def windows(self, minima: np.ndarray) -> np.ndarray:
        """Least value of each window, from those of its blocks. At the end of a text a window
        takes in blocks of the next one; that retrieves more, and is verified without them."""
        found = minima.copy()
        for step in range(1, self.level.blocks):
            np.minimum(found[:-step], minima[step:], out=found[:-step])
        return found


def _retrieve(levels: list[Level], shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(first shingle, end, text, template) of windows with a minimum in common.

    For each band the minima of finer blocks give those of coarser ones."""
    if not len(shingles):
        return np.zeros((0, 4), dtype=np.int64)
    cuts: list[Blocks] = []
    for level in levels:
        cuts.append(Blocks.cut(level, bounds, cuts[-1] if cuts else None))
    hits: list[list[np.ndarray]] = [[] for _ in levels]
    for band in range(max(len(level.minima) for level in levels)):
        minima = _hashed(shingles, _seed(band))
        for i, blocks in enumerate(cuts):
            if blocks.level.stride > 1:
                minima = np.minimum.reduceat(minima, blocks.finer)
            if band < len(blocks.level.minima):
                window = blocks.windows(minima)
                for template, least in zip(blocks.level.templates, blocks.level.minima[band]):
                    at = np.flatnonzero(window == least)
                    hits[i].append(np.stack([at, np.full(len(at), template)], axis=1))
    found = []
    for blocks, pairs in zip(cuts, hits):
        if pairs:
            at, template = np.unique(np.concatenate(pairs), axis=0).T
            text = blocks.text[at]
            ends = blocks.starts[at] + blocks.level.stride * blocks.level.blocks
            ends = np.minimum(ends, bounds[text + 1])
            found.append(np.stack([blocks.starts[at], ends, text, template], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)


MATCH = pa.struct(
    [("license", pa.string()), ("share", pa.float64()), ("first_word", pa.int64())]
)
MATCHES_SQL = "array<struct<license: string, share: double, first_word: long>>"


def _densest(places: np.ndarray, length: int) -> np.ndarray:
    """Of sorted places those in the stretch of this length that holds most of them."""
    ends = np.searchsorted(places, places + length)
    first = int((ends - np.arange(len(places))).argmax())
    return places[first : ends[first]]


def _scan(texts: pa.Array, library: Library, min_share: float) -> pa.Array:
    out: list[list[dict]] = []
    for chunk in chunks(texts):
        lowered = chunk.lower()
        words = lowered.words(NOT_ALNUM)
        starts = words.windows(SHINGLE)
        shingles = window_hashes(lowered.hashes(words), starts, SHINGLE)
        bounds = np.searchsorted(starts, words.bounds)
        matches: list[tuple] = []
        for start, end, text, template in _retrieve(library.levels, shingles, bounds):
            wanted, window = library.shingles[template], shingles[start:end]
            hit = np.isin(window, wanted)
            share = len(np.unique(window[hit])) / len(wanted)
            if share < min_share:
                continue
            at = _densest(np.flatnonzero(hit), len(wanted) * 5 // 4 + 1)
            had = np.unique(window[at])
            if all(np.isin(o, had).sum() >= OWN_SHARE * len(o) for o in library.own[template]):
                matches.append((-len(had), -share, start, template, text, start + at))
        matches.sort(key=lambda m: m[:4])
        best: list[dict[str, tuple[float, int]]] = [{} for _ in range(len(chunk))]
        codes = {name: i for i, name in enumerate(dict.fromkeys(library.names))}
        taken = np.full(len(shingles), -1)
        for _, less, _, template, text, at in matches:
            name = library.names[template]
            others = (taken[at] >= 0) & (taken[at] != codes[name])
            if 2 * others.sum() >= len(at):
                continue
            taken[at[~others]] = codes[name]
            if -less > best[text].get(name, (0.0, 0))[0]:
                best[text][name] = (-less, int(starts[at[0]] - words.bounds[text]))
        out.extend(
            [
                {"license": name, "share": share, "first_word": first}
                for name, (share, first) in sorted(found.items())
            ]
            for found in best
        )
    return pa.array(out, pa.list_(MATCH))


def scan(
    text: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, min_share: float = MIN_SHARE
) -> Column:
    """Licenses of each text, sorted by name: array of (license, share, first_word), the
    greatest share of any template of the license and the word where that match's first
    matching shingle starts."""
    fixed = tuple(templates)

    def find(texts: pa.Array) -> pa.Array:
        return _scan(texts, _library(fixed), min_share)

    return F.arrow_udf(find, MATCHES_SQL)(text)
