import random
import textwrap

import pytest
from pyspark.sql import functions as F

from maillake.llm import licenses as li
from maillake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


ALL = [(name, text) for name, texts in li.TEMPLATES.items() for text in texts]
ALL += [(name, li.SPDX_LINE.format(i)) for name, ids in li.SPDX.items() for i in ids]


def test_every_template_finds_itself():
    for name, text in ALL:
        for framed in (text, f"Some words here.\n{text}\nand more words.", text.upper(), text.replace(", ", "  ,  ")):
            assert name in [f.license for f in li.scan(framed)], (name, framed)
        (found,) = [f for f in li.scan(f"Ab.\n{text}") if f.license == name][:1]
        assert (found.missing, found.extra) == (0, 0) and found.start == 4


@pytest.mark.parametrize(
    "text,want",
    [
        ("This program is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This program is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This library is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This library is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This program is licensed under the GNU General Public License, version 1.", []),
        ("Released under the License.", []),
        ("Released under the BSD License.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the Apache License v2.0", ["Apache-2.0"]),
        ("Licensed under CC BY 3.0.", []),
        ("Licensed under CC 4.0.", []),
        ("Licensed under CC BY-NC-SA 4.0.", []),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", ["GPL-2.0"]),
        ("# SPDX-License-Identifier: Nobody-1.0", []),
        ("MIT License\n\nCopyright (c) 2020 Somebody", ["MIT"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
    ],
)
def test_names_and_versions_decide(text, want):
    assert [f.license for f in li.scan(text)] == want


def test_headers_of_real_files():
    gpl = """
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
    assert [f.license for f in li.scan(gpl)] == ["GPL-3.0"]
    assert [f.license for f in li.scan(gpl.replace("GNU General", "GNU Affero General"))] == ["AGPL-3.0"]
    assert [f.license for f in li.scan(gpl.replace("version 3", "version 2"))] == ["GPL-2.0"]
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
    assert [f.license for f in li.scan(bsd)] == ["BSD"]


def test_findings_need_the_compression(monkeypatch):
    """With dictionaries that save nothing no wording is looked at, and the best of like wordings is the one that saves most."""
    monkeypatch.setattr(li, "per_process", lambda name, make: make())
    text = li.TEMPLATES["GPL-3.0"][0]
    assert li.scan(text)
    real = li.Compressors.sizes
    monkeypatch.setattr(li.Compressors, "sizes", lambda self, words, k: (real(self, words, k)[0],) * 2)
    assert all(li.scan(t) == [] for _, t in ALL)


def test_ranking_is_by_bytes_saved():
    made, engines = li._engines(li.TEMPLATES)
    words = [w for w, _, _ in li.words_of("Ours is a library. " + li.TEMPLATES["LGPL-3.0"][0])]
    ranked = li.candidates(words, made, engines)
    assert ranked == sorted(ranked) and made[ranked[0][1]].license == "LGPL-3.0"
    for gain, k, low, high in ranked:
        alone, given = engines.sizes(words[low:high], k)
        assert -gain == alone - given >= li.LEAST_SAVED * engines.whole[k]


def test_changed_wordings_are_still_candidates():
    """A fifth of a long notice's words lost or added, but none that names the licence: nearly all are found."""
    made, _ = li._engines(li.TEMPLATES)
    rng, good, tried = random.Random(3), 0, 0
    for t in made:
        if len(t.words) < 10:
            continue
        for _ in range(20):
            words = list(t.words)
            for _ in range(len(words) // 5):
                i = rng.randrange(len(words))
                if rng.random() < 0.5 and words[i] not in t.needed and not li._CUE.search(words[i]):
                    words.pop(i)
                else:
                    words.insert(i, "other")
            found = [f.license for f in li.scan(" ".join(PROSE[:5] + words + PROSE[5:9]))]
            tried += 1
            good += t.license in found
    assert good / tried > 0.97


def test_close_wordings_are_told_apart():
    assert [f.license for f in li.scan("Licensed under CC BY-SA 4.0.")] == ["CC-BY-SA-4.0"]
    assert [f.license for f in li.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    changed = li.scan("This work is licensed under the terms of the GNU General Public License, version 3.")
    assert changed[0].license == "GPL-3.0" and changed[0].extra + changed[0].missing <= 3


def test_a_notice_inside_a_very_long_line_is_found():
    text = "alpha beta " * 50000 + li.TEMPLATES["MIT"][0] + " gamma delta" * 50000
    assert [f.license for f in li.scan(text)] == ["MIT"]


def test_other_texts_have_none():
    for text in (None, "", "license", "copyright permission warranty", "The license plate was blue and the driver left."):
        assert li.scan(text) == []


PROSE = (
    "Our crew measured seventeen rivers before winter while Greta drew maps with charcoal and nobody complained about cold "
    "soup near Lisbon until a quiet engineer brought better kettles from Oslo last Thursday evening"
).split(" ")


def test_notices_between_varied_words_of_a_line():
    for name, notice in ALL:
        for before, after in ((3, 3), (9, 6), (14, 16)):
            line = " ".join(PROSE[:before]) + " " + notice + " " + " ".join(PROSE[before : before + after])
            (found,) = li.scan(line)
            assert found.license == name and line[found.start : found.end] == notice.rstrip(".:)") and found.missing + found.extra == 0


def test_all_notices_of_a_line_are_found():
    line = f"{' '.join(PROSE[:5])} {li.TEMPLATES['MIT'][0]} {' '.join(PROSE[5:9])} {li.TEMPLATES['Apache-2.0'][0]} {li.TEMPLATES['MIT'][0]}"
    assert [f.license for f in li.scan(line)] == ["MIT", "Apache-2.0", "MIT"]


def test_notices_wrapped_over_lines():
    for name, notice in ALL:
        if len(notice) > 400 or "SPDX" in notice:
            continue
        for width in range(40, 81, 3):
            for mark in ("", "# ", " * "):
                lines = textwrap.wrap(" ".join(PROSE[:7]) + " " + notice + " " + " ".join(PROSE[7:20]), width)
                (found,) = li.scan("\n".join(mark + line for line in lines))
                assert found.license == name and found.missing + found.extra <= 3, (name, width)  # a hyphen may end a line


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, li.TEMPLATES["MIT"][0]), (3, li.TEMPLATES["MIT"][0]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("Licenses", "_text", "c0", "t", "a0", "_candidate_text")])
    assert set(li.find_licenses(docs).columns) == {*docs.columns, "licenses"} - {"Licenses"}
    got = sorted((str(r["doc_id"]), [x["license"] for x in r["licenses"]]) for r in li.find_licenses(docs).collect())
    assert got == [("1", []), ("2", []), ("3", ["MIT"]), ("3", ["MIT"]), ("None", [])]
    assert li.find_licenses(docs.limit(0)).count() == 0


def test_the_query_against_plain_lines(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_licenses"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines = {name for name, t in ALL if t in (d["text"] or "").split("\n")}
        assert got[d["doc_id"]]["license_ids"] == ",".join(sorted(lines))
