"""Short license notices, places in the text itself, and the whole scan against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from editlens.llm.licenses import GRAM, TEMPLATES, WINDOW, Taken, Templates, _words, align, license_scan


@pytest.fixture(scope="module")
def index():
    return Templates()


@pytest.mark.parametrize(
    "notice,license_",
    [
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("This code is MIT licensed.", "MIT"),
        ("you may use it under the terms of the MIT License", "MIT"),
        ("It is licensed under MIT.", "MIT"),
        ("Licensed under the GPLv3", "GPL-3.0"),
        ("Released under the GNU General Public License.", "GPL"),
        ("Released under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the Artistic License 2.0", "Artistic-2.0"),
        ("Distributed under the Apache Software License, Version 1.1", "Apache-1.1"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.", "0BSD"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "LGPL-2.0-or-later"),
        ("He spoke of licensed trades and of the terms of the peace.", None),
        ("The code is here, licensed staff only.", None),
    ],
)
def test_short_notices(index, notice, license_):
    words = "some words that stand before {} and others that are behind it"
    for text in (notice, words.format(notice)):
        assert [x[1] for x in index.search(pa.array([text]), 0.8)] == ([license_] if license_ else [])


def test_places_are_those_of_the_text(spark):
    text = "İSTANBUL İİ ẞ K 🙂 Released under the MIT License. İ ẞ SPDX-License-Identifier: ISC"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.start, r.end, r.license, r.span) for r in license_scan(docs).collect())
    assert [text.encode()[a:b].decode() for a, b, _, _ in got] == ["Released under the MIT License", "SPDX-License-Identifier: ISC"]
    assert [x[2:] for x in got] == [("MIT", "released under the mit license"), ("ISC", "spdx-license-identifier: isc")]


def brute_force(index, text, run, least=0.8):
    """How often each license stands in a text: every template aligned from wherever ``run`` words in a row are equal, without an index."""
    words, rows = _words(pa.array([text])).hash, []
    for t, template in enumerate(index.words):
        if not index.needed[t] <= set(words.tolist()):
            continue
        spans = set()
        for place in range(len(template)):
            for at in range(len(words)):
                if template[place : place + run].tolist() == words[at : at + run].tolist() and place + run <= len(template):
                    _, pairs = align(template, words, place, at)
                    if index.covered(t, pairs, least):
                        spans.add((len(pairs), pairs[0][1], pairs[-1][1] + 1))
        rows += [(n, index.ids[t], len(template), a, b) for n, a, b in spans]
    taken = Taken()
    return Counter(r[1] for r in sorted(rows, key=lambda r: (-r[0], r[2], r[1], r[3])) if taken.add(r[3], r[4]))


def test_the_scan_is_brute_force():
    """What shares enough words in a row to be sure of a fingerprint is found, and nothing that shares less than one. Notices stand more than two bands apart: of nearer ones, a stretched alignment may take words of both, and which of the
    equal beginnings are fingerprints decides whether it is looked for."""
    r = random.Random(8)
    few = [t for t in TEMPLATES if t[0] in ("MIT", "GPL", "GPL-3.0", "GPL-2.0-or-later", "0BSD", "ISC", "CC-BY-4.0", "MPL-2.0") and len(t[1]) < 300]
    index, found = Templates(tuple(few)), 0
    for _ in range(60):
        parts = []
        for _, wording in r.choices(few, k=2):
            braced = False
            for word in wording.split():
                braced |= "{" in word
                if braced or r.random() > 0.08:
                    parts.append(re.sub("[{}]", "", word))
                elif r.random() < 0.5:
                    parts.append("other")
                braced &= "}" not in word
            parts += [f"w{r.randrange(50)}" for _ in range(20 + r.randrange(12))]
        text = " ".join(parts)
        sure, most = brute_force(index, text, GRAM + WINDOW - 1), brute_force(index, text, GRAM)
        found += sure.total()
        assert sure <= Counter(x[1] for x in index.search(pa.array([text]), 0.8)) <= most, text
    assert found > 60
