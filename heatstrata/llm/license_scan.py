"""License scans: winnowed fingerprints find candidates, banded alignment decides.

Of the hashes of all runs of K words, winnowing keeps the least of every WINDOW in a row, so that any
K + WINDOW - 1 equal words share a fingerprint. The fingerprints of the templates are an inverted index
of (template, place). Hits of a document on diagonals of a template no wider apart than the band are one
candidate. It is aligned word by word inside a band around them, again and again beside the words
already aligned, until no hit is left.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words

K, WINDOW = 3, 2
#: Words that an alignment may shift, either way.
BAND = 8
#: Share of a template's words that must be matched.
COVERAGE = 0.7
#: The templates are handed to every task; more text than this is refused.
MAX_TEMPLATE_BYTES = 8 << 20

# Common license notices and short licenses in full, as they are written. Of Apache-2.0, the
# (L/A)GPL, MPL-2.0, EPL-2.0 and Creative Commons the notices that their texts recommend are here, not the texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
)
_RESULT = "doc_id long, license string, template int, doc_begin long, doc_end long, n_matched long, template_words long, coverage double"


def _winnow(hashes: np.ndarray, text_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the kept runs of K words."""
    begin, grams = words.hash_windows(hashes, text_first, K)
    if not len(grams):
        return begin, grams
    text = np.searchsorted(text_first, begin, "right") - 1
    kept = np.zeros(len(grams), bool)
    kept[np.concatenate([[True], text[1:] != text[:-1]]) & np.concatenate([text[1:] != text[:-1], [True]])] = True  # a text of one run
    for i in range(WINDOW - 1):
        a, b = slice(i, len(grams) - WINDOW + 1 + i), slice(i + 1, len(grams) - WINDOW + 2 + i)
        same = text[a] == text[b]
        kept[a] |= same & (grams[a] <= grams[b])
        kept[b] |= same & (grams[b] < grams[a])
    return begin[kept], grams[kept]


def _index(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    items = [words.hash_text(t, lower=True, plain=True) for t in texts]
    rows = []
    for i, item in enumerate(items):
        begin, grams = _winnow(item, np.array([0, len(item)]))
        rows.append((grams, np.full(len(grams), i), begin))
    hashes, item, at = (np.concatenate(c) if rows else np.zeros(0, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.uint64),) * 3
    order = np.argsort(hashes, kind="stable")
    return items, hashes[order], item[order], at[order]


def _align(template: list, doc: list, low: int, high: int, done: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment on diagonals low to high, off the words done: matched words, first and after-last document word.

    A match counts 1, a difference or gap -1.
    """
    none = (0, 0, 0, 0)  # score, matched, first, end
    before, best = [none] * (high - low + 3), none
    for i, word in enumerate(template):
        row = [none]
        for at, j in enumerate(range(i + low, i + high + 1), 1):
            if 0 <= j < len(doc) and not done[j]:
                score, matched, first, _ = before[at]
                equal = doc[j] == word
                cell = (score + (1 if equal else -1), matched + equal, first if matched else j, j + 1)
                if cell[0] <= 0:
                    cell = none
                for other in (before[at + 1], row[-1]):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                if cell[0] > best[0]:
                    best = cell
                row.append(cell)
            else:
                row.append(none)
        before = [*row, none]
    return best[1], best[2], best[3]


def _alignments(template: np.ndarray, doc: np.ndarray, low: int, high: int, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """All alignments around the diagonals low to high that share no word of the document and match enough; hits: first words."""
    low, high = low - BAND, high + BAND
    start = max(0, low)
    part = doc[start : max(start, high + len(template))].tolist()
    done, hits = np.zeros(len(part), bool), hits - start
    while len(hits := hits[~done[hits]]):
        matched, a, b = _align(template.tolist(), part, low - start, high - start, done)
        if not matched:
            return
        done[a:b] = True
        if matched >= COVERAGE * len(template):
            yield matched, a + start, b + start


def _clusters(new: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of sorted hits no wider than the band; new: where another text or template begins."""
    found = []
    for x, y in zip(np.flatnonzero(new).tolist(), np.append(np.flatnonzero(new)[1:], len(new)).tolist()):
        while x < y:
            end = x + int(np.searchsorted(diagonal[x:y], diagonal[x] + BAND, "right"))
            found.append((x, end))
            x = end
    return found


def _scan(batches: Iterator[pa.RecordBatch], names: list[str], texts: list[str]) -> Iterator[pa.RecordBatch]:
    items, table, item_of, at_of = _index(texts)
    run = blocks.runs(table)
    ends = np.append(run[1:], len(table))
    for batch in batches:
        rows = []
        numbers = batch.column("doc_id").to_pylist()
        data, starts = words.text_bytes(batch.column("text"))
        for first, part, begins in words.chunks(data, starts):
            found = words.find_words(part, begins, plain=True)
            hashes = words.hash_words(part, found, lower=True)
            begin, grams = _winnow(hashes, found.text_first)
            place = blocks.member(grams, table[run])
            hit = np.flatnonzero(place >= 0)
            times = (ends - run)[place[hit]]
            word = np.repeat(begin[hit], times)
            entry = np.repeat(run[place[hit]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            text = np.searchsorted(found.text_first, word, "right") - 1
            diagonal = word - found.text_first[text] - at_of[entry]
            order = np.lexsort((diagonal, item_of[entry], text))
            text, item, diagonal, word = text[order], item_of[entry][order], diagonal[order], word[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
            by_text: dict[int, set[tuple]] = {}
            for x, y in _clusters(new, diagonal):
                t, i = int(text[x]), int(item[x])
                own = hashes[found.text_first[t] : found.text_first[t + 1]]
                for matched, a, b in _alignments(items[i], own, int(diagonal[x]), int(diagonal[y - 1]), word[x:y] - found.text_first[t]):
                    by_text.setdefault(t, set()).add((matched, matched / len(items[i]), -i, a, b))
            for t, matches in sorted(by_text.items()):
                taken = np.zeros(found.text_first[t + 1] - found.text_first[t], bool)
                for matched, coverage, i, a, b in sorted(matches, reverse=True):
                    if not taken[a:b].any():
                        taken[a:b] = True
                        rows.append((numbers[first + t], names[-i], -i, a, b, matched, len(items[-i]), coverage))
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.float64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _RESULT.split(", ")])


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per license notice found: doc_id, license, template, doc_begin, doc_end, n_matched, template_words, coverage.

    ``templates`` are (license, text) pairs; template is the pair's number. Words are runs of letters
    and digits, A-Z lower-cased; doc_begin and doc_end count them. A notice is an alignment of a
    template near hits, with 70 % of the template's words matched; each of a document's notices is a
    row, and of those that overlap the one with more matched words stays. Templates of fewer than three words are never
    found. Null and empty texts have none. Repeated rows give rows each; null ids are kept; an empty
    table or no templates give no rows. Other columns are ignored.
    """
    if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("too many templates for one scan")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names, texts = [n for n, _ in templates], [t for _, t in templates]
    return own.mapInArrow(functools.partial(_scan, names=names, texts=texts), _RESULT)
