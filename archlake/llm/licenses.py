"""License scans by conditional compression.

A candidate block is a stretch of a text whose runs of three words are also in a license wording. It is compressed alone
and with each wording as a zstandard raw dictionary; wordings are ranked by what they save. The winners are confirmed, in
that order, by the exact differences in wording: of those that say most of the block, with all their key words and none of their
relatives', the one with the fewest differences names the license. Only the span that it covers is taken; what is left before and after is judged again, and so are the spans that
wordings cover in a block that none of them says as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from archlake.llm.blocks import KEYS_LOWER, pieces, shingle_keys, span_keys, word_spans

# License names, the key words that a block must say (and after a ! those that it must not), and public wordings.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FSF = "Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Creative Commons: what the short names stand for; lines of versions 3.0 and 4.0 are made by rule.
_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_VERSIONS = {"4.0": "International", "3.0": "Unported"}

WORDINGS = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "This software is licensed under the MIT License. See the LICENSE file for details."),
    (
        "MIT",
        "permission hereby granted free charge software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "apache 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "gnu general public 3 !lesser !affero !29 !19", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "gnu general public 3 !lesser !affero !29 !19",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "gnu general public 2 !lesser !june", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "gnu general public 2 !lesser !june",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "BSD",  # what all its kinds begin with
        "redistribution binary forms modification !reproduce !endorse",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "BSD",
        "redistributions binary form reproduce documentation !retain !endorse",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "MIT",
        "software provided without warranty kind merchantability",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "permission use copy modify distribute software purpose fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "LGPL-2.1",
        "gnu lesser general public 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "gnu affero general public 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("EPL-2.0", "eclipse public 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    (
        "CC0-1.0",
        "dedicated copyright public domain worldwide",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
        "domain worldwide. This software is distributed without any warranty.",
    ),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *[(f"CC-{k}-{v}", f"{k.lower()} {v}", f"Licensed under CC {k} {v}.") for v in _VERSIONS for k in _COMMONS],
    *[
        (f"CC-{k}-{v}", f"commons {name.lower()} {v}", f"This work is licensed under a Creative Commons {name} {v} {place} License.")
        for v, place in _VERSIONS.items() for k, name in _COMMONS.items()
    ],
    ("BSD-2-Clause", "redistribution retain reproduce documentation !endorse", _BSD_HEAD),
    ("BSD-2-Clause", "redistribution retain reproduce documentation !endorse", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", "redistribution retain reproduce endorse promote", _BSD_HEAD + _BSD_THIRD),
    ("BSD-3-Clause", "redistribution retain reproduce endorse promote", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    (
        "MIT-0",
        "permission hereby granted free charge software !subject !organization",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ),
    (
        "BSL-1.0",
        "permission hereby granted organization derivative works",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    ("0BSD", "permission use copy modify distribute purpose fee !appear", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "Zlib",
        "authors held liable permission granted anyone restrictions misrepresented",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "free unencumbered software public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    ("WTFPL", "do what fuck you want public", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    (
        "LGPL-3.0",
        "gnu lesser general public 3 !29",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "gnu lesser general public 3 !29", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "gnu lesser general public 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "gnu affero general public 3 !19", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", "gnu general public 3 29 june 2007 !lesser", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _FSF),
    ("LGPL-3.0", "gnu lesser general public 3 29 june 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _FSF),
    ("AGPL-3.0", "gnu affero general public 3 19 november 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _FSF),
    ("GPL-2.0", "gnu general public 2 june 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + _FSF.replace("2007", "1989, 1991")),
    (
        "Apache-2.0",
        "apache 2.0 january 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. "
        "Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    (
        "MPL-2.0",
        "mozilla 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-1.0",
        "eclipse public v1.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
        "distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    (
        "CDDL-1.0",
        "common development distribution",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this "
        "file except in compliance with the License.",
    ),
    ("Artistic-2.0", "artistic 2.0", "This program is free software; you may redistribute and modify it under the terms of the Artistic License 2.0."),
)

#: A line that names a license by its identifier, or several of them.
_SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)")

#: Words of a run; words without a run that end a block; words judged at once (longer stretches are read in windows).
RUN, GAP, LONGEST = 3, 12, 400

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


@dataclass(frozen=True)
class Settings:
    least_same: float = 0.75  # of a block's words, the share that the wording has to say in order
    least_words: int = 4


def plain_words(text: str) -> list[str]:
    """Lower-cased words without the signs around them."""
    return [w for w in (_EDGE.sub("", x.lower()) for x in re.split(r"[ \t-\r]+", text)) if w]


def _alnum_keys() -> np.ndarray:
    keys = KEYS_LOWER.copy()
    for b in range(128):
        if not chr(b).isalnum():
            keys[b] = 0
    return keys


_KEYS = _alnum_keys()


class Scanner:
    def __init__(self, wordings: tuple[tuple[str, str, str], ...] = WORDINGS, settings: Settings = Settings()):
        self.settings, self.wordings = settings, wordings
        self.words = [plain_words(t) for _, _, t in wordings]
        self.keys = [{w for w in k.split() if w[0] != "!"} for _, k, _ in wordings]
        self.bars = [{w[1:] for w in k.split() if w[0] == "!"} for _, k, _ in wordings]
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode().lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, t in wordings
        ]
        raw = b"".join(t.encode() for _, _, t in wordings)
        offs = np.concatenate(([0], np.cumsum([len(t.encode()) for _, _, t in wordings])))
        self.runs = np.unique(self._runs(np.frombuffer(raw, np.uint8), offs)[0])

    @staticmethod
    def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = word_spans(data, offs)
        runs, at = shingle_keys(span_keys(data, starts, _KEYS), first, RUN)
        return runs, at, starts, ends, first

    def blocks(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, from byte, to byte of the row's text) of all candidate blocks."""
        runs, at, starts, ends, first = self._runs(data, offs)
        hit = np.flatnonzero(np.isin(runs, self.runs))
        if not len(hit):
            return
        row = np.searchsorted(at, hit, "right") - 1
        word = hit - at[row] + first[row]
        cut = np.flatnonzero((row[1:] != row[:-1]) | (word[1:] - word[:-1] > GAP)) + 1
        for part in np.split(np.arange(len(hit)), cut):
            r, lo = int(row[part[0]]), int(word[part[0]])
            last = min(int(word[part[-1]]) + RUN, int(first[r + 1]))
            yield r, int(starts[lo] - offs[r]), int(ends[last - 1] - offs[r])

    def able(self, k: int, said: set[str]) -> bool:
        """Whether words say all the key words of wording k, and none that tells it from its relatives."""
        return self.keys[k] <= said and not self.bars[k] & said

    def judge(self, block: bytes) -> dict | None:
        """The confirmed wording of a block with the fewest differences, the one that saves most of equal ones; or None."""
        said = plain_words(block.decode("utf-8", "replace"))
        if len(said) < min(self.settings.least_words, min(map(len, self.words))):
            return None
        alone = len(self.alone.compress(block.lower()))
        best, words = None, set(said)
        for rank, (saved, k) in enumerate(self._ranked(block, alone), 1):
            if saved <= 0:
                break
            if not self.able(k, words):
                continue
            ops = SequenceMatcher(None, said, self.words[k], autojunk=False).get_opcodes()
            same = sum(b - a for op, a, b, _, _ in ops if op == "equal")
            if same < self.settings.least_same * len(said):
                continue
            apart = len(said) + len(self.words[k]) - 2 * same
            if best is None or apart < best[0]:
                changes = [(" ".join(said[a:b]), " ".join(self.words[k][c:d])) for op, a, b, c, d in ops if op != "equal"]
                best = apart, {
                    "license": self.wordings[k][0], "wording": k, "rank": rank, "plain_bytes": alone, "saved_bytes": saved, "words": len(said), "same_words": same,
                    "added_words": len(said) - same, "missing_words": len(self.words[k]) - same, "differences": [f"{a} / {b}" for a, b in changes if a],
                }
        return best and best[1]

    def _ranked(self, block: bytes, alone: int) -> list[tuple[int, int]]:
        """(saved bytes, wording), the most saved first."""
        block = block.lower()  # A-Z only; wordings are lower-cased in the dictionaries, too
        return sorted(((alone - len(c.compress(block)), k) for k, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def _spans(self, words: list[str], k: int) -> list[tuple[int, int]]:
        """Spans of words that wording k says, that with the most words said and the fewest others first.

        They reach from one matching run to another; a run at either end may be a stray one, so that the shorter one is left
        out step by step.
        """
        runs = [m for m in SequenceMatcher(None, words, self.words[k], autojunk=False).get_matching_blocks() if m.size]
        found = []
        while runs:
            a, b, same = runs[0].a, runs[-1].a + runs[-1].size, sum(m.size for m in runs)
            if same >= self.settings.least_same * (b - a) and self.able(k, set(words[a:b])):
                found.append((b - a - 2 * same, a, b))
            runs = runs[1:] if runs[0].size <= runs[-1].size else runs[:-1]
        return [x[1:] for x in sorted(found, key=lambda x: x[0])]

    def _best(self, block: bytes, at: list[tuple[int, int]], words: list[str]) -> tuple[int, int, dict] | None:
        """The first span of the words that is confirmed alone, best-ranked wordings first."""
        whole = block[at[0][0] : at[-1][1]]
        got = self.judge(whole)
        ranked = [got["wording"]] if got else [k for saved, k in self._ranked(whole, len(self.alone.compress(whole.lower()))) if saved > 0]
        for k in ranked:
            for a, b in self._spans(words, k) if self.keys[k] <= set(words) else ():  # a relative's words may be outside of the span
                if alone := self.judge(block[at[a][0] : at[b - 1][1]]):
                    return a, b, alone
        return (0, len(at), got) if got else None

    def confirmed(self, block: bytes) -> Iterator[tuple[int, int, dict]]:
        """(from byte, to byte, confirmed wording) of all spans of the block that wordings say, in order."""
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", block)]
        at = [(a, b, w) for a, b in at if (w := _EDGE.sub("", block[a:b].decode("utf-8", "replace").lower()))]
        words, at = [x[2] for x in at], [x[:2] for x in at]
        longest, done = max(map(len, self.words)), 0
        while done < len(at):
            end = min(len(at), done + max(LONGEST, 4 * longest))
            found, todo = [], [(done, end)]
            while todo:
                lo, hi = todo.pop()
                if lo < hi and (best := self._best(block, at[lo:hi], words[lo:hi])):
                    a, b, got = best
                    found.append((lo + a, lo + b, got))
                    todo += [(lo, lo + a), (lo + b, hi)]
            found.sort(key=lambda x: x[:2])
            # what the end of a window may have cut off is read again in the next one
            whole = found if end == len(at) else [x for x in found if x[1] <= end - longest]
            yield from ((at[a][0], at[b - 1][1], got) for a, b, got in whole)
            cut_off = [x[0] for x in found[len(whole) :]]
            done = end if end == len(at) else max(done + longest, min([end - longest, *cut_off]), whole[-1][1] if whole else 0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", wordings: tuple[tuple[str, str, str], ...] = WORDINGS, settings: Settings = Settings()) -> DataFrame:
    """One row per confirmed span of a text: key, start and end (UTF-8 byte offsets in the text), the license and its evidence.

    A line with an SPDX identifier names its license itself, so that its row has no wording and no figures.
    Texts that are null, empty or without a license give no row; repeated rows give theirs each; keys may be null. Ties in
    saved bytes go to the wording that is listed first. Nothing is shuffled, and a block is judged in windows of about LONGEST
    words, so that a long text costs its length only.
    """
    long, names = T.LongType(), T.StringType()
    schema = T.StructType(
        [docs.schema[key], T.StructField("start", long), T.StructField("end", long), T.StructField("license", names)]
        + [T.StructField(c, long) for c in ("wording", "rank", "plain_bytes", "saved_bytes", "words", "same_words", "added_words", "missing_words")]
        + [T.StructField("differences", T.ArrayType(names))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings, settings)
        for batch in batches:
            for lo, _, data, offs in pieces(batch.column(1)):
                found = []
                for r, a, b in scanner.blocks(data, offs):
                    for c, d, got in scanner.confirmed(data[offs[r] + a : offs[r] + b].tobytes()):
                        found.append({"_row": lo + r, "start": a + c, "end": a + d} | got)
                raw = data.tobytes()
                for m in _SPDX.finditer(raw):
                    r = int(np.searchsorted(offs, m.start(), "right")) - 1
                    if m.end() <= offs[r + 1]:
                        found.append({"_row": lo + r, "start": m.start() - int(offs[r]), "end": m.end() - int(offs[r]), "license": m[1].decode(), "differences": []})
                if found:
                    keys = batch.column(0).take(pa.array([x["_row"] for x in found]))
                    kinds = {"license": pa.string(), "differences": pa.list_(pa.string())}
                    yield pa.record_batch(
                        [keys, *[pa.array([x.get(c) for x in found], kinds.get(c, pa.int64())) for c in schema.names[1:]]], names=schema.names
                    )

    return docs.select(key, text).mapInArrow(run, schema)
