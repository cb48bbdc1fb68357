"""License scans: winnowed fingerprints pick candidates, banded alignment reports what is covered and where.

Templates and texts are runs of letters, digits and non-ASCII characters in lower case. Fingerprints are the smallest hashes
of GRAM-word shingles in every window of WINDOW shingles, so texts that share GRAM + WINDOW - 1 words in a row share one.
An inverted index from fingerprint to (template, place) gives hits. From each hit that no span of its template has yet,
template and text are aligned to both sides within a band of BAND words (match +2, other -1) as far as that pays; the words that
match, as a share of the template, are its coverage, and the aligned span of the text is reported. The words that tell a
license from its kin (its name, version, conditions) stand in braces in a template: they must match one after another, without
a gap. The best span counts first; others that overlap it are left out.

The templates are a parameter; a list like TEMPLATES makes an index of some hundred kilobytes, which each task builds.

Results for odd rows: null and empty texts have no licenses; an empty table gives no rows; repeated rows give repeated
results; a null doc_id is reported as null; texts are whole, however long; of spans that tie the shorter template, then the name,
then the earlier place counts first; other columns are not read."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chain, ship, slices, tidy, utf8

GRAM, WINDOW, BAND = 3, 2, 8
LEAST_COVERAGE = 0.8

#: Wordings of licenses (id, text); what is in braces must match word for word.
WORDINGS = (
    ("MIT", "{Permission is hereby granted, free of charge, to any person obtaining a copy of this software} and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to {deal in the Software} without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "{Licensed under the Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "{Apache License Version 2.0}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either {version 3 of the License}, or (at your option) {any later version}."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation; either {version 2 of the License}, or (at your option) {any later version}."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public License version 2} as published by the Free Software Foundation."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either {version 3 of the License}, or (at your option) {any later version}."),
    ("LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version 3 of the License}, or (at your option) {any later version}."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version 2.1 of the License}, or (at your option) {any later version}."),
    ("LGPL-2.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Library General Public License} as published by the Free Software Foundation; either {version 2 of the License}, or (at your option) {any later version}."),
    ("LGPL-2.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version 2 of the License}, or (at your option) {any later version}."),
    ("GPL-3.0", "{GNU GENERAL PUBLIC LICENSE Version 3}, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "{GNU GENERAL PUBLIC LICENSE Version 2}, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "{GNU AFFERO GENERAL PUBLIC LICENSE Version 3}, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "{GNU LESSER GENERAL PUBLIC LICENSE Version 3}, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "{GNU LESSER GENERAL PUBLIC LICENSE Version 2.1}, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("BSD-2-Clause", "{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors {may be used to endorse or promote products} derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "{Mozilla Public License Version 2.0} 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0} which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "{Eclipse Public License - v 2.0} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("ISC", "{Permission to use, copy, modify, and/or distribute this software for any purpose} with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "{Permission to use, copy, modify, and distribute this software for any purpose} with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "{Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED} \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("Apache-1.1", "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"This product includes {software developed by the Apache Software Foundation} (http://www.apache.org/).\""),
    ("Artistic-2.0", "{The Artistic License 2.0} Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: {The origin of this software must not be misrepresented}; you must not claim that you wrote the original software."),
    ("BSL-1.0", "{Boost Software License - Version 1.0} - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Unlicense", "This is free and unencumbered software {released into the public domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated {all copyright and related and neighboring rights} to this software {to the public domain} worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "To the extent possible under law, the person who associated {CC0} with this work has waived {all copyright and related or neighboring rights} to this work."),
    ("CC0-1.0", "{CC0 1.0 Universal} Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."),
)
#: How notices name licenses (id, name).
NAMES = (
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License 1.0"), ("BSD", "BSD License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"),
    ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-2.0", "GNU General Public License v2"), ("GPL-2.0", "GNU GPL version 2"), ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3"), ("GPL-3.0", "GNU GPL version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("CC0-1.0", "CC0 1.0 Universal License"),
    ("GPL", "GNU General Public License"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"), ("AGPL-3.0", "AGPLv3"), ("LGPL-2.1", "LGPLv2.1"), ("LGPL-3.0", "LGPLv3"), ("0BSD", "0BSD License"),
    ("Apache-1.1", "Apache Software License, Version 1.1"), ("Apache-2.0", "Apache-2.0 license"), ("Artistic-2.0", "Artistic License 2.0"), ("Unlicense", "Unlicense License"),
)
LEADS = ("Released under the", "Licensed under the", "Distributed under the", "This work is licensed under the", "This software is licensed under the", "under the terms of the")
#: Names short enough for "is licensed under MIT" and "code is MIT licensed", and what such notices speak of.
SHORT = (("MIT", "MIT"), ("ISC", "ISC"), ("BSD", "BSD"), ("Apache-2.0", "Apache 2.0"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"), ("MPL-2.0", "MPL 2.0"), ("0BSD", "0BSD"))
THINGS = ("code", "software", "project", "library", "package", "program", "work", "and")
#: Identifiers of notices by tag, beside those that have templates.
TAGS = ("MIT-0", "BSD-3-Clause-Clear", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later")
_CREATIVE = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def templates() -> tuple[tuple[str, str], ...]:
    """WORDINGS, and notices made of LEADS and names, of SHORT names, and of tags; those of Creative Commons from their conditions
    and versions. None has fewer than GRAM + WINDOW - 1 words, which are sure to share a fingerprint with a text ("Licensed under
    MIT", of three words, isn't sure to, and is no template)."""
    out = [*WORDINGS, *((i, f"{lead} {{{name}}}") for i, name in NAMES for lead in LEADS)]
    out += [(i, f"{{{name}}}") for i, name in NAMES if len(name.split()) > 5]  # long enough without a lead
    out += [(i, f"is licensed under {{{name}}}") for i, name in SHORT] + [(i, f"{thing} is {{{name} licensed}}") for i, name in SHORT for thing in THINGS]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        words = "-".join(_CREATIVE[k] for k in kind.split("-"))
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            name = f"Creative Commons {words} {version}"
            out += [(f"CC-{kind}-{version}", f"{lead} {{CC {kind} {version}}}") for lead in ("Licensed under", "Released under", "This work is licensed under")]
            out.append((f"CC-{kind}-{version}", f"This work is licensed under a {{{name}}} {port} License."))
            out.append((f"CC-{kind}-{version}", f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {{{name}}} {port} Public License (\"Public License\")."))
    tags = sorted({i for i, _ in out if i not in ("BSD", "GPL")} | set(TAGS))
    return (*out, *((i, f"{{SPDX-License-Identifier: {i}}}") for i in tags))


TEMPLATES = templates()


def _words(texts: pa.Array) -> Words:
    return Words(*utf8(pc.utf8_lower(texts)), "letters")


def winnowed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place in all words, text) of consecutive texts; texts of fewer than GRAM words have none."""
    h = words.hash
    n = len(h) - GRAM + 1
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if n <= 0:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = h[:n].copy()
    for j in range(1, GRAM):
        gram = chain(gram, h[j : n + j])
    fits = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    gram, of = gram[fits], doc[fits]
    # the smallest of each window within a text (of equals the last); a text of fewer shingles is one window
    size = np.bincount(of, minlength=len(words.first) - 1) if len(of) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    count = np.where(size > 0, np.maximum(size - WINDOW + 1, 1), 0)
    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    end = np.minimum(start + WINDOW, np.repeat(first + size, count))
    best = start.copy()
    for j in range(1, WINDOW):
        at = np.minimum(start + j, end - 1)
        best = np.where(gram[at] <= gram[best], at, best)
    best = np.unique(best)
    return gram[best], fits[best], of[best]


def extend(template: np.ndarray, text: np.ndarray, band: int = BAND) -> tuple[int, list[tuple[int, int]]]:
    """(score, matching places) of the best alignment of a beginning of the template with a beginning of the text, whose
    places differ by at most ``band``: +2 for a match, -1 for every other word of either."""
    width, n = 2 * band + 1, len(text)
    columns = np.arange(width)
    low = -(1 << 20)
    score = np.full((len(template) + 1, width), low, np.int32)
    score[0, band:] = np.where(np.arange(band + 1) <= n, -np.arange(band + 1), low)
    for i, word in enumerate(template):
        at = i - band + columns  # the place in the text that row i + 1 ends with
        there = (at >= 0) & (at < n)
        same = there & (text[np.clip(at, 0, max(n - 1, 0))] == word) if n else there
        now = np.where(there, score[i] + np.where(same, 2, -2), low)
        np.maximum(now, np.where((at >= -1) & (at < n), np.append(score[i][1:], low) - 1, low), out=now)  # the template's word is missing
        # words of the text that the template lacks
        now = np.maximum.accumulate(now + columns) - columns
        score[i + 1] = np.where((at >= -1) & (at < n), now, low)
        if now.max() < score[: i + 2].max() - 2 * (len(template) - i):
            break  # nothing behind can be better
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    best, pairs = int(score[i, j]), []
    while i > 0:
        at = i - 1 - band + j
        same = 0 <= at < n and text[at] == template[i - 1]
        if 0 <= at < n and score[i, j] == score[i - 1, j] + (2 if same else -2):
            if same:
                pairs.append((int(i) - 1, int(at)))
            i -= 1
        elif j + 1 < width and score[i, j] == score[i - 1, j + 1] - 1:
            i, j = i - 1, j + 1
        else:
            j -= 1
    return best, pairs[::-1]


def align(template: np.ndarray, text: np.ndarray, place: int, at: int, band: int = BAND) -> tuple[int, list[tuple[int, int]]]:
    """(score, matching places) of the best banded alignments from template[place] and text[at] on and back from there."""
    start = at - place
    if start >= 0 and np.array_equal(text[start : start + len(template)], template):
        return 2 * len(template), [(i, start + i) for i in range(len(template))]
    # no more of the text than the band can reach
    before = text[max(0, at - place - band) : at]
    right, ahead = extend(template[place:], text[at : at + len(template) - place + band], band)
    left, behind = extend(template[:place][::-1], before[::-1], band)
    return left + right, [(place - 1 - i, at - 1 - j) for i, j in reversed(behind)] + [(place + i, at + j) for i, j in ahead]


class Templates:
    """Words, required spans and the inverted index of the templates."""

    def __init__(self, templates=TEMPLATES):
        self.ids = [t[0] for t in templates]
        w = _words(pa.array([re.sub("[{}]", " ", t[1]) for t in templates], pa.string()))
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.required = [list(_spans(t[1])) for t in templates]
        self.plain = [x.tolist() for x in self.words]
        self.needed = [{x[i] for a, b in spans for i in range(a, b)} for x, spans in zip(self.plain, self.required)]
        h, place, of = winnowed(w)
        order = np.argsort(h, kind="stable")
        self.hash, self.of, self.place = h[order], of[order], (place - w.first[of])[order]

    def covered(self, t: int, pairs: list[tuple[int, int]], least: float) -> bool:
        """Whether enough of a template matches, and its required spans word by word."""
        if len(pairs) < least * len(self.words[t]):
            return False
        there = dict(pairs)
        return all(all(i in there and there[i] == there[a] + i - a for i in range(a, b)) for a, b in self.required[t])

    def search(self, texts: pa.Array, least: float):
        """(text, license, matched, template words, first and last byte) of spans that cover enough of a template."""
        w = _words(texts)
        h, place, doc = winnowed(w)
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
        hits = sorted((int(doc[k]), int(self.of[x]), int(place[k] - w.first[doc[k]]), int(self.place[x])) for k in np.flatnonzero(hi > lo).tolist() for x in range(lo[k], hi[k]))
        found: dict[int, list] = {}
        last = None
        for d, t, at, there in hits:
            if (d, t) != last:
                last, seen, tried = (d, t), -1, set()
            # words of a span that is found; a diagonal that led nowhere up to here
            if at < seen or any(at < end and at - there == shift for shift, end in tried):
                continue
            text, words = w.hash[w.first[d] : w.first[d + 1]], self.words[t]
            # no alignment is looked for where too few words are near, or one that must match isn't
            near = set(text[max(0, at - there - BAND) : at + len(words) - there + BAND].tolist())
            if not self.needed[t] <= near or sum(map(near.__contains__, self.plain[t])) < least * len(words):
                tried = {(at - there, at + len(words) - there)} | {x for x in tried if x[1] > at}
                continue
            _, pairs = align(words, text, there, at)
            if self.covered(t, pairs, least):
                a, b = pairs[0][1], pairs[-1][1] + 1
                seen = b
                found.setdefault(d, []).append((len(pairs), self.ids[t], len(words), a, b))
            else:
                tried = {(at - there, pairs[-1][1] + 1)} | {x for x in tried if x[1] > at}
        for d, rows in found.items():
            taken = Taken()
            for matched, name, size, a, b in sorted(rows, key=lambda r: (-r[0], r[2], r[1], r[3])):
                if taken.add(a, b):
                    yield d, name, matched, size, int(w.start[w.first[d] + a]), int(w.end[w.first[d] + b - 1])


class Taken:
    """Spans that don't overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Takes the span if it overlaps none taken before."""
        k = bisect.bisect_left(self.ends, a + 1)  # the first that ends behind a
        if k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def _spans(template: str):
    """Numbers of the words that stand in braces: (first, behind the last)."""
    n = 0
    for k, part in enumerate(re.split("[{}]", template)):
        size = int(_words(pa.array([part])).first[-1])
        if k % 2:
            yield n, n + size
        n += size


def characters(text: np.ndarray) -> np.ndarray:
    """Where each character of UTF-8 bytes begins, and their end. Lower case has other bytes, but as many characters."""
    return np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))


_FOUND = "doc_id long, license string, words_matched int, template_words int, coverage double, start int, end int, span string"


def license_scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """docs(doc_id, text) -> a row for each span of a text that covers a template; start and end are bytes of the
    UTF-8 text, span is what stands there in lower case."""
    ship(docs.sparkSession)

    def run(batches):
        index = Templates(templates)
        for batch in batches:
            for part in slices(batch, "text"):
                (data, offs), (lower, low_offs) = utf8(part.column(1)), utf8(pc.utf8_lower(part.column(1)))
                rows, last = [], None
                for d, name, matched, size, a, b in index.search(part.column(1), least):
                    if d != last:
                        last = d
                        at, low_at = characters(data[offs[d] : offs[d + 1]]), characters(lower[low_offs[d] : low_offs[d + 1]])
                    span = lower[a:b].tobytes().decode("utf-8", "replace")
                    a, b = (int(at[np.searchsorted(low_at, x - low_offs[d])]) for x in (a, b))
                    rows.append((part.column(0)[d].as_py(), name, matched, size, matched / size, a, b, span))
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), _FOUND)
