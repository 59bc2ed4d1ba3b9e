"""License scans by conditional compression.

The words around each cue, over line ends, are candidate blocks. Windows of about each template's length are compressed alone and
with the template as raw zstandard dictionary. A window is a candidate if the dictionary saves at least ``LEAST_SAVED`` of
what it saves on the template itself, so the words around a notice play no role. Candidates are ranked by the bytes
saved. In this order the template is laid along the window word by word, and the wording confirms or refuses:

* at most ``MOST_DIFFERENT`` of the template's words may be missing or added;
* the words that name a licence (names and version numbers in the template) must all be there;
* no word may be added that names another licence with a like wording (Affero, Lesser).

A confirmed part refuses later ones that overlap it; a block may hold several licences.

Defined results: null and empty texts, and texts without a cue, have no findings; repeated rows are scanned
alike; of templates that save equally much the one listed first counts; an empty table gives an empty one; columns
of the input are kept, and the added ``licenses`` replaces a column of the same name. Lines of any length
are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_text, per_process

# Wordings of licence notices and headers; fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("Released to the public domain under CC0 1.0 Universal.",),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
}
# Identifiers that stand in SPDX lines, and the licence each one names; fixed values.
SPDX_LINE = "SPDX-License-Identifier: {}"
SPDX = {
    "Apache-2.0": ("Apache-2.0",),
    "MIT": ("MIT",),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL-2.0": ("MPL-2.0",),
    "EPL-2.0": ("EPL-2.0",),
    "BSL-1.0": ("BSL-1.0",),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "ISC": ("ISC",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("Zlib",),
    "CC0-1.0": ("CC0-1.0",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
}
# Words that make a line a candidate, and capitalised words that name no licence; fixed values.
CUES = r"(?i)licen[sc]|copyright|permission|warrant|public\W+domain|redistribut|copyleft|spdx|creative\W+commons"
GENERIC = {"license", "version", "software", "source", "code", "form", "january", "you", "in", "no", "the", "this"}
MOST_DIFFERENT = 0.25  # of the template's words
LEAST_SAVED = 0.15  # of the bytes that the template saves on itself; by measurement, see the README
FOUND = "licenses array<struct<license:string,start:long,end:long,reduction:double,missing:int,extra:int>>"

# A word with hyphens may go on in the next line, after its comment mark.
_WORD = re.compile(r"\w+(?:[.'-]\w+|-[ \t]*\r?\n[\s#*/]*+\w+)*")
_BROKEN = re.compile(r"-\W+")
_CUE = re.compile(CUES.removeprefix("(?i)"), re.I)
_NUMBER = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")


class Finding(NamedTuple):
    license: str
    start: int
    end: int
    reduction: float
    missing: int  # words of the template that the block lacks
    extra: int  # words of the matched part that the template lacks


@dataclass
class Template:
    license: str
    words: list[str]
    needed: Counter  # words that name the licence
    refused: set[str]  # words that name another one


def _plain(word: str) -> str:
    """A word in lower case; ``v2.0`` and ``2.0`` are ``2``."""
    word = _BROKEN.sub("-", word.lower())
    number = _NUMBER.fullmatch(word)
    return number.group(1) if number else word


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; runs without end are plain words too."""
    return [(_plain(m.group()), m.start(), m.end()) for m in _WORD.finditer(text)]


def _names(text: str) -> Counter:
    """Words of a template that name something: numbers, and capitalised words inside a sentence or before another one."""
    found: Counter = Counter()
    for m in _WORD.finditer(text):
        word, before, after = m.group(), text[: m.start()].rstrip(" ('"), text[m.end() :].lstrip()
        inside = bool(before) and before[-1] not in ".;" or after[:1].isupper() or word[1:] != word[1:].lower()
        if _plain(word) not in GENERIC and (any(c.isdigit() for c in word) or word[0].isupper() and inside):
            found[_plain(word)] += 1
    return found


def prepared(templates: dict[str, tuple[str, ...]]) -> list[Template]:
    """Templates with the words that tell them from each other."""
    made = []
    for licence, wordings in templates.items():
        lines = [SPDX_LINE.format(i) for i in SPDX.get(licence, ())]
        for text in (*wordings, *lines):
            made.append(Template(licence, [w for w, _, _ in words_of(text)], _names(text), set()))
    for one in made:
        for other in made:
            if other.license != one.license and _parts(one.words, other.words, 2 * MOST_DIFFERENT * len(one.words)):
                one.refused |= {w for w in set(other.needed) - set(one.words) if not w[0].isdigit()}
    return made


def blocks_of(text: str, reach: int) -> Iterator[tuple[int, str]]:
    """Candidate blocks: ``reach`` words before and after each cue, over line ends; blocks that meet are one."""
    words = words_of(text)
    ends = [e for _, _, e in words]
    low = high = 0
    for m in _CUE.finditer(text):
        k = bisect.bisect_right(ends, m.start())
        if high and k - reach > high:
            yield words[low][1], text[words[low][1] : words[high - 1][2]]
            high = 0
        if not high:
            low = max(0, k - reach)
        high = min(len(words), k + reach + 1)
    if high:
        yield words[low][1], text[words[low][1] : words[high - 1][2]]


class Compressors:
    """Compressed sizes alone and with each template as dictionary."""

    def __init__(self, templates: list[Template]) -> None:
        import zstandard as zs

        plain = dict(level=3, write_content_size=False, write_checksum=False)
        self.alone = zs.ZstdCompressor(**plain)
        self.given = []
        for t in templates:
            words = zs.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zs.DICT_TYPE_RAWCONTENT)
            self.given.append(zs.ZstdCompressor(dict_data=words, write_dict_id=False, **plain))
        self.whole = [max(1, sum(self.sizes(t.words, k)) - 2 * self.sizes(t.words, k)[1]) for k, t in enumerate(templates)]

    def sizes(self, words: list[str], k: int) -> tuple[int, int]:
        data = " ".join(words).encode("utf-8", "surrogatepass")
        return len(self.alone.compress(data)), len(self.given[k].compress(data))


def candidates(own: list[str], templates: list[Template], engines: Compressors) -> list[tuple[float, int, int, int]]:
    """Windows of a block in the order of the bytes saved: (-bytes, number of the template, first word, end)."""
    held, found = Counter(own), []
    for k, t in enumerate(templates):
        if not t.needed <= held:  # cannot be confirmed anywhere in the block
            continue
        size = len(t.words)
        span, step = size + size // 2 + 1, max(1, size // 4)
        for low in range(0, max(1, len(own) - span + step), step):
            alone, given = engines.sizes(own[low : low + span], k)
            if alone - given >= LEAST_SAVED * engines.whole[k]:
                found.append((given - alone, k, low, min(low + span, len(own))))
    return sorted(found)


def confirmed(part: list[str], template: Template, most: float) -> Iterator[tuple[int, int, int]]:
    """Cost, first word and end of the places in the words whose wording confirms the template, the nearest first."""
    for cost, first, end in _parts(template.words, part, most):
        words = Counter(part[first:end])
        if template.needed <= words and not template.refused & set(words):
            yield cost, first, end


def _parts(template: list[str], words: list[str], most: float) -> list[tuple[int, int, int]]:
    """For each end the part of the words nearest to the template, by cost: cost, first word and end.

    The whole template is laid along any part of the words; a missing or an extra word costs 1, and at most ``most``.
    """
    # cost, start per end; the part may start anywhere at no cost
    row = [(0, j) for j in range(len(words) + 1)]
    for i, t in enumerate(template, 1):
        new = [(i, 0)]
        for j, w in enumerate(words, 1):
            best = (row[j][0] + 1, row[j][1])
            if t == w and row[j - 1] <= best:
                best = row[j - 1]
            if new[-1][0] + 1 < best[0]:
                best = (new[-1][0] + 1, new[-1][1])
            new.append(best)
        row = new
    return sorted((cost, start, end) for end, (cost, start) in enumerate(row) if cost <= most and end > start)


def _engines(templates: dict[str, tuple[str, ...]]) -> tuple[list[Template], Compressors]:
    made = prepared(templates)
    return made, Compressors(made)


def scan(text: str | None, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[Finding]:
    """The licences of a text in order; a block may hold several."""
    if not text or not _CUE.search(text):
        return []
    made, engines = per_process(f"licence-engines-{hash(tuple(templates.items()))}", lambda: _engines(templates))
    found: list[Finding] = []
    # A notice with extra words may reach further from its cue than the template.
    reach = 1 + int((1 + MOST_DIFFERENT) * max((len(t.words) for t in made), default=0))
    for offset, block in blocks_of(text, reach):
        words = words_of(block)
        own = [w for w, _, _ in words]
        kept: list[tuple[int, int]] = []
        for _, k, low, high in candidates(own, made, engines):
            template = made[k]
            # A window may begin or end inside the notice: it is laid along some more words, but has to meet the window.
            around = max(0, low - len(template.words))
            wider = own[around : high + len(template.words)]
            for cost, first, end in confirmed(wider, template, MOST_DIFFERENT * len(template.words)):
                first, end = around + first, around + end
                if first < high and low < end and not any(first < b and a < end for a, b in kept):
                    break
            else:
                continue
            kept.append((first, end))
            alone, given = engines.sizes(own[first:end], k)
            matched = (len(template.words) + (end - first) - cost) // 2
            where = (offset + words[first][1], offset + words[end - 1][2])
            found.append(Finding(template.license, *where, round(1 - given / alone, 6), len(template.words) - matched, end - first - matched))
    return sorted(found, key=lambda f: f.start)


KIND = pa.list_(
    pa.struct(
        [
            ("license", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("reduction", pa.float64()),
            ("missing", pa.int32()),
            ("extra", pa.int32()),
        ]
    )
)


def find_licenses(docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The documents with the licences found in them. Only texts with a cue reach Python."""

    def run(*columns: pa.Array) -> list[pa.Array]:
        found = [[f._asdict() for f in scan(t.as_py(), templates)] if t.is_valid else [] for t in columns[0]]
        return [pa.array(found, KIND)]

    asked = "_candidate_text"
    while asked in [c.lower() for c in docs.columns]:
        asked += "_"
    source = docs.withColumn(asked, F.when(F.col(text).rlike(CUES), F.col(text)))
    return map_text(source, run, FOUND, asked)
