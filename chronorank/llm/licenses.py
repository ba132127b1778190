"""Licence notices in texts: MinHash bands over overlapping windows, verified by shingle containment."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import shingles_in_order, word_hashes

#: Words of a shingle, and share of a template's shingles that a match has.
K, CONTAINMENT = 5, 0.8
#: Chance that no band of a window that holds just that share of a template agrees with it, at most.
MISS = 1e-4
#: Templates that are scanned for at most; they are sent to every task.
TEMPLATES = 20_000

#: Notices of common licences, as published.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    # what the licences of two and three clauses have in common, and the clause that only the latter has
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    "CC0-1.0": ("has waived all copyright and related or neighboring rights to this work",),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}

_WORD = re.compile(r"[^\W_]+")


def license_words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in _WORD.findall((text or "").lower())]


@dataclass
class Scale:
    """Templates of more than ``half`` to ``2 * half`` shingles, and the bands of windows they lie in.

    Windows are three blocks of ``half`` shingles, one block apart, so that one of
    them holds any run of two blocks.  A window that holds ``CONTAINMENT`` of a
    template has at least the Jaccard similarity that the shortest template's part
    has to a window with the missing rest.  One minimum is a band, and as many
    bands are taken as make a miss of all of them as unlikely as ``MISS``.
    """

    half: int
    flips: np.ndarray
    times: np.ndarray
    minima: np.ndarray  # templates x bands
    members: list[int]

    @staticmethod
    def bands(half: int, shortest: int) -> int:
        similar = CONTAINMENT * shortest / (3 * half + (1 - CONTAINMENT) * shortest)
        return math.ceil(math.log(MISS) / math.log1p(-min(similar, 0.9)))

    def mixed(self, shingles: np.ndarray) -> np.ndarray:
        """Bands x shingles."""
        return (shingles[None] ^ self.flips) * self.times


class Scanner:
    """Templates, compiled for scanning texts window by window."""

    def __init__(self, notices: Mapping[str, tuple[str, ...]]) -> None:
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        by_half: dict[int, list[int]] = {}
        lengths = []
        for name in sorted(notices):
            for text in notices[name]:
                words = license_words(text)
                if not words:
                    continue
                length = max(1, len(words) - K + 1)
                by_half.setdefault(max(1, 1 << (length - 1).bit_length() >> 1), []).append(len(self.names))
                self.names.append(name)
                lengths.append(length)
                self.sets.append(np.unique(shingles_in_order(word_hashes(words), min(K, len(words)))))
        if len(self.names) > TEMPLATES:
            raise ValueError(f"at most {TEMPLATES} templates can be scanned for")
        self.scales = []
        for half, members in sorted(by_half.items()):
            bands = Scale.bands(half, min(lengths[m] for m in members))
            draw = np.random.default_rng([3, half])
            scale = Scale(
                half,
                draw.integers(1, 1 << 63, (bands, 1), dtype=np.uint64),
                draw.integers(1, 1 << 63, (bands, 1), dtype=np.uint64) | np.uint64(1),
                np.zeros(0, np.uint64),
                members,
            )
            scale.minima = np.stack([scale.mixed(self.sets[m]).min(axis=1) for m in members])
            self.scales.append(scale)

    def scan(self, text: str | None, step: int = 8_192) -> list[tuple[str, float, int, int]]:
        """(licence, containment, first word, end) of every notice in the whole text, by place.

        Of matches that overlap, the fullest stays, of these the longest.
        """
        words = license_words(text)
        if not words or not self.names:
            return []
        shingles = shingles_in_order(word_hashes(words), K)
        found: list[tuple[float, int, int, int]] = []
        for scale in self.scales:
            half = scale.half
            blocks = -(-len(shingles) // half)
            hits: dict[int, list[int]] = {}
            for low in range(0, blocks, max(1, step // half)):
                # windows that start in this stretch reach two blocks further
                high = min(blocks, low + max(1, step // half))
                part = shingles[low * half : (high + 2) * half]
                least = np.minimum.reduceat(scale.mixed(part), np.arange(0, len(part), half), axis=1)
                windows = np.minimum(least, _ahead(least, 1))
                windows = np.minimum(windows, _ahead(least, 2))[:, : high - low]
                for m, minima in zip(scale.members, scale.minima, strict=True):
                    (places,) = np.nonzero((windows == minima[:, None]).any(axis=0))
                    if len(places):
                        hits.setdefault(m, []).extend((low + places).tolist())
            for m, places in hits.items():
                for start, end in _stretches(places):
                    found += [(share, last - first, -first, m) for share, first, last in self._occurrences(
                        m, shingles, start * half, (end + 3) * half, 3 * half
                    )]
        taken: list[tuple[int, int, str, float]] = []
        for share, size, start, m in sorted(found, reverse=True):
            first, end = -start, -start + size
            at = bisect.bisect(taken, (first,))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (first, end, self.names[m], share))
        return [(name, share, first, end) for first, end, name, share in taken]

    def _occurrences(self, m: int, shingles: np.ndarray, start: int, end: int, reach: int) -> Iterator[tuple[float, int, int]]:
        """(containment, first word, end) of places with enough of template ``m`` within ``reach`` shingles, from left to right.

        Of the overlapping places the first with most of the template is taken, as
        short as it goes; the next one starts behind it.
        """
        part = shingles[start:end]
        (places,) = np.nonzero(np.isin(part, self.sets[m]))
        codes = np.searchsorted(self.sets[m], part[places]).tolist()
        places = places.tolist()
        total, enough = len(self.sets[m]), CONTAINMENT * len(self.sets[m])
        behind = 0
        while behind < len(places):
            counts: dict[int, int] = {}
            best, stop, high = (0, 0, 0), len(places), behind
            for low in range(behind, len(places)):
                if low >= stop:
                    break
                while high < len(places) and places[high] - places[low] < reach:
                    counts[codes[high]] = counts.get(codes[high], 0) + 1
                    high += 1
                if len(counts) >= enough:
                    if not best[0]:
                        stop = high
                    if len(counts) > best[0]:
                        best = (len(counts), low, high)
                if counts[codes[low]] == 1:
                    del counts[codes[low]]
                else:
                    counts[codes[low]] -= 1
            if not best[0]:
                return
            size, low, high = best
            seen: set[int] = set()
            for last in range(low, high):
                seen.add(codes[last])
                if len(seen) == size:
                    break
            # a start that recurs before the end isn't needed
            rest = codes[low : last + 1]
            first = low
            while rest.count(codes[first]) > 1:
                rest.pop(0)
                first += 1
            yield size / total, start + places[first], start + places[last] + K
            behind = last + 1


def _stretches(places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of the runs of windows (sorted) that overlap or touch."""
    first = last = places[0]
    for place in places[1:]:
        if place > last + 3:
            yield first, last
            first = place
        last = place
    yield first, last


def _ahead(blocks: np.ndarray, by: int) -> np.ndarray:
    out = np.full_like(blocks, np.iinfo(np.uint64).max)
    out[:, : blocks.shape[1] - by] = blocks[:, by:]
    return out


def scan_licenses(docs: DataFrame, notices: Mapping[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """doc_id, licenses of every row of ``docs`` (doc_id, text).

    ``licenses`` has (license, containment, first, end) of every notice in the
    text, by place: the share of the notice's shingles of ``K`` words that lie in
    one window, and the words it spans.  Of notices that overlap, the fullest
    stays, so a licence that shares a sentence with another isn't told for it.  Case,
    punctuation and line breaks don't matter.  A text or notice of fewer words is
    one shingle, so such a notice only matches a text of just its words.
    Null and blank texts have no matches.  Rows stay where they are.
    """
    kind = "doc_id long, licenses array<struct<license:string,containment:double,first:int,end:int>>"
    names = ("license", "containment", "first", "end")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for rows in batches:
            matches = [[dict(zip(names, m, strict=True)) for m in scanner.scan(text)] for text in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "licenses": matches})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scan, kind)
