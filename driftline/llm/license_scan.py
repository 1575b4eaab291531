"""License scans: normalised sentences are known licence sentences or not; ordered rules match the sequences of their identifiers.

A text is cut into sentences at line ends and behind ``. ; !`` and a space; a sentence is normalised (lower case, only letters,
digits, dots inside numbers and single spaces; years, e-mail addresses and holders of a copyright line become ``copyright``) and
looked up, over as many lines as it is wrapped to. A rule is an ordered list of identifiers; it matches where these stand in order
with at most ``GAP`` other sentences between two. Of rules that match at one place the longest counts. Identifiers in no match are
reported as ``clue``. Sentences and rules are tables that a caller can extend (``Book``).

Defined results: null and empty texts and texts without a known sentence give no rows; a text that holds a licence twice gives a
row for each; null and repeated doc_ids and repeated rows are reported as they are; very long texts are scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

GAP = 2
_CUT = re.compile(r"[\r\n]+|(?<=[.;!])\s+")
_KEEP = re.compile(r"[^\w.]+|\.(?!\d)|_+")
_COPYRIGHT = re.compile(r"^\W*(?:copyright\b|\(c\)\s|©)", re.I)

#: Known sentences by identifier, as published in the licences' own texts.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "grant-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "notice-mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "asis-mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "liability-mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-secure": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-licensed": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software;",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "ccbync-licensed": "Licensed under CC BY-NC 4.0.",
    "ccby-licensed": "Licensed under CC BY 4.0.",
    "ccbysa-licensed": "Licensed under CC BY-SA 4.0.",
    "ccby-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-work": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "version-3": "Version 3, 29 June 2007",
    "version-2": "Version 2, June 1991",
    "version-2.1": "Version 2.1, February 1999",
    "agpl-version": "Version 3, 19 November 2007",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "all-rights": "All rights reserved.",
    "copyright": "copyright",
}
for _name in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "Zlib", "0BSD", "BSL-1.0"):
    SENTENCES[f"spdx-{_name}"] = f"SPDX-License-Identifier: {_name}"

#: (licence, kind, identifiers in order).
RULES = [
    ("MIT", "text", ("grant-mit", "notice-mit", "asis-mit", "liability-mit")),
    ("MIT", "text", ("grant-mit", "notice-mit", "asis-mit")),
    ("MIT", "reference", ("mit-released",)),
    ("MIT", "reference", ("mit-licensed",)),
    ("MIT", "title", ("mit-title",)),
    ("MIT", "title", ("mit-title-the",)),
    ("Apache-2.0", "notice", ("apache-header", "apache-use", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", "notice", ("apache-header", "apache-use", "apache-copy-secure", "apache-asis", "apache-see")),
    ("Apache-2.0", "notice", ("apache-header", "apache-use")),
    ("Apache-2.0", "reference", ("apache-licensed",)),
    ("GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-or-later", "notice", ("gpl-free",)),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl2-terms", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl2-terms", "gpl2-version")),
    ("GPL-3.0-only", "reference", ("gpl3-licensed",)),
    ("GPL-2.0-only", "reference", ("gpl2-licensed",)),
    ("CC-BY-NC-4.0", "reference", ("ccbync-licensed",)),
    ("CC-BY-NC-4.0", "reference", ("ccbync-work",)),
    ("CC-BY-4.0", "reference", ("ccby-licensed",)),
    ("CC-BY-4.0", "reference", ("ccby-work",)),
    ("CC-BY-SA-4.0", "reference", ("ccbysa-licensed",)),
    ("CC-BY-SA-4.0", "reference", ("ccbysa-work",)),
    ("CC0-1.0", "reference", ("cc0-work",)),
    ("BSD-3-Clause", "text", ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "text", ("bsd-use", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant", "isc-asis")),
    ("MPL-2.0", "notice", ("mpl-header", "mpl-copy")),
    ("MPL-2.0", "notice", ("mpl-header",)),
    ("LGPL-2.1-or-later", "notice", ("lgpl-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", "notice", ("lgpl-free",)),
    ("AGPL-3.0-or-later", "notice", ("agpl-free", "gpl-hope", "gpl-implied", "agpl-details")),
    ("AGPL-3.0-or-later", "notice", ("agpl-free",)),
    ("GPL-3.0-only", "text", ("gpl-title", "version-3")),
    ("GPL-2.0-only", "text", ("gpl-title", "version-2")),
    ("LGPL-2.1-only", "text", ("lgpl-title", "version-2.1")),
    ("LGPL-3.0-only", "text", ("lgpl-title", "version-3")),
    ("AGPL-3.0-only", "text", ("agpl-title", "agpl-version")),
    ("Apache-2.0", "text", ("apache-title", "apache-version")),
    ("EPL-2.0", "notice", ("epl-terms",)),
    ("Zlib", "text", ("zlib-asis", "zlib-grant")),
    ("Unlicense", "text", ("unlicense",)),
    ("proprietary", "reference", ("all-rights",)),
    *[(k[5:], "identifier", (k,)) for k in SENTENCES if k.startswith("spdx-")],
]


def normalise(sentence: str) -> str:
    if _COPYRIGHT.match(sentence):
        # A holder's line; a whole sentence about copyright keeps its words.
        short = sentence.strip()
        if len(short) <= 120 and not re.search(r"notice|holders?\b|licen[sc]e", short, re.I):
            return "copyright"
    return _KEEP.sub(" ", sentence.lower()).strip()


_BULLET = re.compile(r"^(?:[#*/>;-]+|\d+\.(?!\d)|\([a-z0-9]\))\s*")


class Book:
    """Known sentences and ordered rules, ready for matching; ``extended`` gives a book with more of both.

    Sentences are kept as a tree of their words, so that a text's words are followed one by one however they are wrapped. The hint
    is made from the sentences: it holds, of each, the rarest-looking word, one of which a text with a known sentence must have."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: list[tuple[str, str, tuple[str, ...]]] | None = None) -> None:
        self.sentences, self.rules = dict(SENTENCES if sentences is None else sentences), list(RULES if rules is None else rules)
        self.tree: dict = {}
        hints = set()
        for name, sentence in self.sentences.items():
            words = normalise(sentence).split()
            at = self.tree
            for w in words:
                at = at.setdefault(w, {})
            at[None] = name
            if name == "copyright":
                hints |= {"copyright", "(c)", "©"}
            else:
                hints.add(max((re.sub(r"\W.*", "", w) for w in words), key=lambda w: (w not in _PLAIN, len(w), w)))
        self.hint = re.compile("|".join(re.escape(w) for w in sorted(hints) if not any(o != w and o in w for o in hints)), re.I)
        self.by_first: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {}
        for r in sorted(self.rules, key=lambda r: -len(r[2])):
            self.by_first.setdefault(r[2][0], []).append(r)

    def extended(self, sentences: dict[str, str], rules: list[tuple[str, str, tuple[str, ...]]]) -> "Book":
        return Book(self.sentences | sentences, [*self.rules, *rules])

    def identify(self, text: str) -> list[tuple[int, int, int, str, int]]:
        """(first piece, from, to, identifier, last piece) of known sentences, in order; from and to are characters.

        A sentence opens with a piece and may go on over any number of pieces, as wrapped texts have line ends inside sentences;
        the longest known one counts."""
        pieces, at = [], 0
        for m in _CUT.finditer(text):
            pieces.append((at, m.start()))
            at = m.end()
        pieces.append((at, len(text)))
        pieces = [(a, b) for a, b in pieces if text[a:b].strip()]
        norm: dict[int, list[str]] = {}

        def words(k: int) -> list[str]:
            if k not in norm:
                norm[k] = normalise(_BULLET.sub("", text[pieces[k][0] : pieces[k][1]].strip())).split()
            return norm[k]

        out, k = [], 0
        while k < len(pieces):
            node, j, found = self.tree, k, None
            while j < len(pieces):
                for w in words(j):
                    node = node.get(w)
                    if node is None:
                        break
                if node is None:
                    break
                if None in node and node is not self.tree:
                    found = (j, node[None])
                j += 1
            if found:
                out.append((k, pieces[k][0], pieces[found[0]][1], found[1], found[0]))
                k = found[0] + 1
            else:
                k += 1
        return out

    def licences(self, text: str | None) -> list[dict]:
        """licence, kind, sentence identifiers, from and to (characters) of each match."""
        if not text or not self.hint.search(text):
            return []
        ids, out, k = self.identify(text), [], 0
        used = [False] * len(ids)
        for k in range(len(ids)):
            if used[k]:
                continue
            for licence, kind, rule in self.by_first.get(ids[k][3], ()):
                hits = [k]
                for want in rule[1:]:
                    # The next of this identifier, at most GAP other pieces behind the last hit.
                    j = next((j for j in range(hits[-1] + 1, len(ids)) if ids[j][3] == want or ids[j][0] - ids[hits[-1]][4] > GAP + 1), len(ids))
                    if j == len(ids) or used[j] or ids[j][0] - ids[hits[-1]][4] > GAP + 1:
                        break
                    hits.append(j)
                if len(hits) == len(rule):
                    for h in hits:
                        used[h] = True
                    out.append({"licence": licence, "kind": kind, "sentences": list(rule), "first_char": ids[k][1], "end_char": ids[hits[-1]][2]})
                    break
            else:
                if ids[k][3] != "copyright":
                    out.append({"licence": None, "kind": "clue", "sentences": [ids[k][3]], "first_char": ids[k][1], "end_char": ids[k][2]})
        return out


#: Words too common to tell that a text may hold a licence.
_PLAIN = frozenset("distribution documentation international conditions particular restriction following without software version program source general public this with".split())
BOOK = Book()


def licences(text: str | None, book: Book = BOOK) -> list[dict]:
    return book.licences(text)


FOUND = "licence string, kind string, sentences array<string>, first_char long, end_char long"


def scan(docs: DataFrame, book: Book = BOOK) -> DataFrame:
    """(doc_id, licence, kind, sentences, first_char, end_char): one pass over whole texts, without a shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, rows = [], []
            for k, t in enumerate(part.column("text").to_pylist()):
                found = licences(t, book)
                keys += [k] * len(found)
                rows += found
            kinds = {"licence": pa.string(), "kind": pa.string(), "sentences": pa.list_(pa.string()), "first_char": pa.int64(), "end_char": pa.int64()}
            yield pa.record_batch([part.column("doc_id").take(pa.array(keys, pa.int64())), *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]], names=["doc_id", *kinds])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
