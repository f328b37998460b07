"""License scans by sentence rules.

A text is cut into sentences, each is normalised (letters and digits in lower case, everything else a blank) and looked
up in a table of known licence sentences. The identifiers found, in the order of the text, are matched against ordered
rules: at each place the longest rule whose sequence stands there wins, the first of the table among equals, and the
scan goes on behind it. Between the sentences of one rule others may stand only if they are no licence sentences.
A sentence may be wrapped at any of its blanks and stand in a comment block; marks and lines without words end it.

Bound: only the sentences of ``SENTENCES`` are known, word for word. Licences that aren't there, other versions and
sentences with other names in them (of holders, projects) give no identifiers.

One narrow pass over whole texts; the tables are constants. Special input: a null or empty text has no sentences; a null
``doc_id`` is carried through; repeated rows are scanned each by itself; a licence that is named twice is listed once but
counted twice; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of widely used licences and notices, by identifier.
SENTENCES = {
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-not-except": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-line": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "Licensed under CC0 1.0.",
}

# Ordered rules, sequences of sentence identifiers and the licence they stand for.
RULES = (
    (("apache-not-except", "apache-copy", "apache-as-is", "apache-limits"), "Apache-2.0"),
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-warranty", "bsd-liability"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("isc-grant", "isc-warranty", "isc-liability"), "ISC"),
    (("isc-grant-and", "isc-warranty", "isc-liability"), "ISC"),
    (("isc-grant-and",), "ISC"),
    (("0bsd-grant", "isc-warranty", "isc-liability"), "0BSD"),
    (("0bsd-grant",), "0BSD"),
    (("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"), "Zlib"),
    (("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"), "Zlib"),
    (("unlicense-domain", "unlicense-free", "mit-warranty", "mit-liability"), "Unlicense"),
    (("unlicense-domain", "unlicense-free"), "Unlicense"),
    (("unlicense-domain",), "Unlicense"),
    (("boost-line",), "BSL-1.0"),
    (("boost-grant",), "BSL-1.0"),
    (("mpl-notice", "mpl-copy"), "MPL-2.0"),
    (("epl-notice",), "EPL-2.0"),
    (("agpl-free", "gpl-hope", "agpl-details"), "AGPL-3.0-or-later"),
    (("agpl-free",), "AGPL-3.0-or-later"),
    (("lgpl3-free", "lgpl-hope", "lgpl-details"), "LGPL-3.0-or-later"),
    (("lgpl3-free",), "LGPL-3.0-or-later"),
    (("lgpl-free", "lgpl-hope", "lgpl-details"), "LGPL-2.1-or-later"),
    (("cc-by-work",), "CC-BY-4.0"),
    (("cc-by-sa-work",), "CC-BY-SA-4.0"),
    (("cc-by-nc-work",), "CC-BY-NC-4.0"),
    (("cc-by-nc-sa-work",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nd-work",), "CC-BY-ND-4.0"),
    (("gpl-free", "gpl-hope", "gpl-details"), "GPL-3.0-or-later"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-details"), "GPL-2.0-or-later"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("gpl2-only",), "GPL-2.0-only"),
    (("lgpl-free",), "LGPL-2.1-or-later"),
    (("isc-grant",), "ISC"),
    (("mpl-notice",), "MPL-2.0"),
    (("apache-not-except",), "Apache-2.0"),
    (("apache-line",), "Apache-2.0"),
    (("mit-line",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("mit-grant",), "MIT"),
    (("gpl3-line",), "GPL-3.0-only"),
    (("cc-by-nc-line",), "CC-BY-NC-4.0"),
    (("cc-by-line",), "CC-BY-4.0"),
    (("cc-by-sa-line",), "CC-BY-SA-4.0"),
    (("cc0-line",), "CC0-1.0"),
)

# The short form of every licence that a rule can find.
_SPDX = {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in dict.fromkeys(name for _, name in RULES)}
SENTENCES |= _SPDX
RULES += tuple(((k,), k.removeprefix("spdx-")) for k in _SPDX)

_NOT_WORD = re.compile(r"[^0-9a-z]+")
#: A text is cut at a mark that white space follows and at each line's end; the known sentences may be wrapped over any lines.
_END = re.compile(r"(?<=[.;:!?])\s+|\n+")
#: Comment signs that are words; others are no letters.
_COMMENT = re.compile(r"^[ \t]*@?(?:rem|dnl)\b", re.M)
#: One of these is in every known sentence; each is one word, which no line end can part.
HINTS = ("license", "permission", "copyright", "redistribut", "warrant", "liable", "unencumbered", "anyone", "misrepresented", "altered", "advertising", "mpl")


def normalised(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


def _parts(text: str) -> list[tuple[str, bool]]:
    """Parts with words, and whether a sentence surely ends behind each: at a mark or at a line without words, but not before an address."""
    out: list[tuple[str, bool]] = []
    at, mark, blank = 0, False, False
    for m in (*_END.finditer(text), None):
        raw = text[at : m.start() if m else len(text)]
        if part := normalised(raw):
            if out:
                out[-1] = (out[-1][0], mark or blank and not part.startswith("http"))
            out.append((part, True))
            mark = blank = False
        else:
            blank = True
        if m:
            mark, blank, at = mark or bool(part) and raw[-1] in ".;:!?", blank or m[0].count("\n") > 1, m.end()
    return out


#: Known sentences, as the parts that they are cut into at marks, by their first word; the longest first.
KNOWN: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _id, _text in SENTENCES.items():
    _p = tuple(p for p, _ in _parts(_text))
    KNOWN.setdefault(_p[0].split()[0], []).append((_p, _id))
for _list in KNOWN.values():
    _list.sort(key=lambda x: -len(" ".join(x[0])))


def _end(parts: list[tuple[str, bool]], i: int, known: tuple[str, ...]) -> int | None:
    """Where ``known`` ends that begins at part ``i``; lines may end anywhere in it, sentences only where its own parts do."""
    k, have = 0, ""
    for j in range(i, len(parts)):
        have = f"{have} {parts[j][0]}" if have else parts[j][0]
        if have == known[k]:
            k, have = k + 1, ""
            if k == len(known):
                return j + 1
        elif parts[j][1] or not known[k].startswith(have + " "):
            return None
    return None


def identifiers(text: str | None) -> list[str]:
    """Identifiers of the licence sentences of ``text``, in its order."""
    if not text:
        return []
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    parts, out, i = _parts(_COMMENT.sub("", low)), [], 0
    while i < len(parts):
        for known, name in KNOWN.get(parts[i][0].split(" ", 1)[0], ()):
            if end := _end(parts, i, known):
                out.append(name)
                i = end
                break
        else:
            i += 1
    return out


def licences(ids: list[str]) -> list[str]:
    """Licences of the rules that match ``ids``, in order; a sentence that no rule takes is passed over."""
    out, i = [], 0
    while i < len(ids):
        best = max((r for r in RULES if tuple(ids[i : i + len(r[0])]) == r[0]), key=lambda r: len(r[0]), default=None)
        if best:
            out.append(best[1])
        i += len(best[0]) if best else 1
    return out


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_ids, licences (in order) of every row."""
    source = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(f"{key}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [identifiers(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.string())), pa.array([licences(x) for x in ids], pa.list_(pa.string()))], names=[key, "sentence_ids", "licences"])

    return source.mapInArrow(run, f"{key} long, sentence_ids array<string>, licences array<string>")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_licences and the sorted distinct licences, joined by commas, of every document."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.size("licences").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"))
