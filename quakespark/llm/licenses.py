"""License scans by template-markup matching.

A template is a license's wording as words, with markup: ``[[ ... ]]`` is an
optional region, ``{{n-m}}`` stands for n to m words of any wording,
``((a|b))`` for one of some words, and ``!(a|b)`` at the end for words that
must not follow, ``#`` among them for any number. A plus sign right after a
digit (version 2+) is a word of its own for templates, not for base phrases. It is compiled to an automaton over words: one state for each
word or replaceable place, and skips over what may be left out; all states of
a run are the bits of one integer. A run starts where the template's opening
words stand, and a text is accepted where all mandatory wording follows
exactly. Of acceptances one within another the longest decides. The base
phrases are found beside it, at every place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_FSF = "[[as published by the free software foundation]]"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and [[non]] ((noninfringement|infringement)) in no event shall {{1-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC_TAIL = "the software is provided as is and {{1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "[[3]] neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = "this software is provided by {{1-14}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-14}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"


def _forms(version: str) -> list[str]:
    """The ways to write a version: version 2.1, v 2.1 or v2.1; 3 or 3.0. A bare number is none."""
    first, rest = version.split(".")
    tail = rest if rest != "0" else "[[0]]"
    return [f"((version|v)) {first} {tail}", f"v{first} {tail}"]


def _gnu(label: str, name: str, versions: tuple[str, ...]) -> list[tuple[str, str]]:
    """The notices of a GNU license: of a version only, and of that or a later one."""
    out = []
    for version, words in ((v, form) for v in versions for form in _forms(v)):
        out.append((f"{label}-{version}-only", f"{name} public license {_FSF} {words} [[only]] [[of the license]] !(or|and|+|#)"))
        out.append((f"{label}-{version}-only", f"{name} public license {words} [[only]] {_FSF} !(or|and|+|#)"))
        out.append((f"{label}-{version}-or-later", f"{name} public license {_FSF} [[either]] {words} [[of the license]] or [[at your option]] [[any]] ((later|newer)) [[version]]"))
        out.append((f"{label}-{version}-or-later", f"{name} public license {_FSF} {words} + !(#)"))
    return out


def _gnu_text(label: str, name: str, dated: str, years: str) -> tuple[str, str]:
    """The head of a GNU license's own text: its version and date, its owner, and that it may not be changed."""
    return (f"{label}-text", f"{name} public license version {dated} copyright c {years} free software foundation inc {{{{0-16}}}} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed")


def _spdx(identifiers: str) -> list[tuple[str, str]]:
    """Tags of source files that name a license by its short identifier."""
    folded = ((name, name.lower().replace("-", " ").replace(".", " ")) for name in identifiers.split())
    return [("mit-notice" if name == "MIT" else name.lower(), f"spdx license identifier {words}" + ("" if words[-1].isalpha() else " !(only|or|+|#)")) for name, words in folded]


#: Wordings of licenses and their notices, in lower case, and their labels.
TEMPLATES = [
    *_gnu("gpl", "general", ("1.0", "2.0", "3.0")),
    *_gnu("lgpl", "library general", ("2.0",)),
    *_gnu("lgpl", "lesser general", ("2.1", "3.0")),
    *_gnu("agpl", "affero general", ("3.0",)),
    _gnu_text("gpl-2.0", "general", "2 june 1991", "1989 1991"),
    _gnu_text("gpl-3.0", "general", "3 29 june 2007", "2007"),
    _gnu_text("lgpl-2.0", "library general", "2 june 1991", "1991"),
    _gnu_text("lgpl-2.1", "lesser general", "2 1 february 1999", "1991 1999"),
    _gnu_text("lgpl-3.0", "lesser general", "3 29 june 2007", "2007"),
    _gnu_text("agpl-3.0", "affero general", "3 19 november 2007", "2007"),
    *_spdx("GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 MPL-2.0 BSD-2-Clause BSD-3-Clause MIT ISC 0BSD Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"),
    ("apache-2.0", "licensed under the apache license [[version]] 2 0"),
    ("apache-2.0", "apache license [[version]] 2 0 [[the license]] you may not use this {{1-3}} except in compliance with the license [[you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 [[txt]] [[html]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license]]"),
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("mit-text", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("isc-text", f"permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_TAIL}"),
    ("0bsd-text", f"permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted {_ISC_TAIL}"),
    ("bsd-2-clause-text", f"{_BSD} {_BSD_TAIL}"),
    ("bsd-3-clause-text", f"{_BSD} {_BSD_NAME} {_BSD_TAIL}"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an ((acknowledgment|acknowledgement)) in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense-text", f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law [[{_AS_IS}]]"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] [[attribution]] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-4.0", "shared under [[a]] [[creative commons]] [[attribution]] cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 [[international]] [[public]] license"),
    ("cc-by-sa-4.0", "creative commons attribution ((sharealike|share)) [[alike]] 4 0 [[international]] [[public]] license"),
    ("cc0-1.0", "cc0 1 0 universal"),
]

#: A plus sign after a version's digit.
_PLUS = re.compile(rb"(?<=[0-9])\+(?![0-9A-Za-z+=])")

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|\(\(([^()]+)\)\)|!\(([^()]+)\)|[^\s\[\]{}()!]+")

#: Bytes of a text: A-Z to lower case, ASCII other than letters and digits to a space; a word's other bytes are those of non-ASCII characters.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(bytes(ord(chr(c).lower()) if c < 0x80 else c for c in range(256)))


class Automaton:
    """A compiled template. State i is before step i; the last state accepts."""

    def __init__(self, label: str, markup: str):
        self.label = label
        steps: list[tuple[bytes, ...] | None] = []
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        self.not_before: frozenset[bytes] = frozenset()
        for m in _MARK.finditer(markup):
            if m[0] == "[[":
                opened.append(len(steps))
            elif m[0] == "]]":
                skips.append((opened.pop(), len(steps)))
            elif m[1]:
                least, most = int(m[1]), int(m[2])
                first = len(steps)
                steps += [None] * most
                skips += [(first + least + i, first + most) for i in range(most - least)]
            elif m[3]:
                steps.append(tuple(w.encode() for w in m[3].split("|")))
            elif m[4]:
                self.not_before = frozenset(w.encode() for w in m[4].split("|"))
            else:
                steps.append((m[0].encode(),))
        if opened:
            raise ValueError(f"an optional region isn't closed: {markup}")
        self.accept = 1 << len(steps)
        jump = {i: 1 << i for i in range(len(steps) + 1)}
        for at in range(len(steps), -1, -1):
            for a, b in skips:
                if a == at:
                    jump[a] |= jump[b]
        self.jump = [jump[i] for i in range(len(steps) + 1)]
        self.plain = [j == 1 << i for i, j in enumerate(self.jump)]
        self.on: dict[bytes, int] = {}
        self.any = sum(1 << i for i, s in enumerate(steps) if s is None)
        for i, s in enumerate(steps):
            for word in s or ():
                self.on[word] = self.on.get(word, 0) | 1 << i
        opening = 0
        while opening < len(steps) and steps[opening] is not None and len(steps[opening]) == 1 and self.plain[opening]:
            opening += 1
        if not opening:
            raise ValueError(f"a template must open with mandatory words: {markup}")
        self.opening = b" " + b" ".join(s[0] for s in steps[:opening]) + b" "
        self.entry = self._closed(1 << opening)
        self.entered = opening

    def _closed(self, states: int) -> int:
        out = states
        while states:
            low = states & -states
            out |= self.jump[low.bit_length() - 1]
            states ^= low
        return out

    def run(self, words: list[bytes], start: int) -> int:
        """The end of the longest acceptance of words[start:], which has the opening words; else, or before a barred word, -1."""
        states, at, end = self.entry, start + self.entered, -1
        if states & self.accept:
            end = at
        while at < len(words):
            states = (states & (self.on.get(words[at], 0) | self.any)) << 1
            if not states:
                break
            states, at = self._closed(states), at + 1
            if states & self.accept:
                end = at
        return -1 if 0 <= end < len(words) and (words[end] in self.not_before or b"#" in self.not_before and words[end].isdigit()) else end


def places(line: bytes, needle: bytes) -> list[int]:
    """Word numbers at which the words of the needle stand; both have a space around each word."""
    out, at, word, seen = [], line.find(needle), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = line.find(needle, at + 1)
    return out


def longest(found: list[tuple[int, int, str]]) -> set[str]:
    """The labels of the acceptances (start, end, label) that lie within no longer one."""
    out: set[str] = set()
    last, reach = None, -1
    for start, end, label in sorted(found, key=lambda x: (x[0], -x[1])):
        if end > reach or (start, end) == last:
            out.add(label)
            last, reach = (start, end), end
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None):
        self.phrases = [(f" {p} ".encode(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.templates = [Automaton(*t) for t in (TEMPLATES if templates is None else templates)]

    def __call__(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
        words = text.encode().translate(_FOLD).split() if text else []
        n_words, line = len(words), b" " + b" ".join(words) + b" "
        base: set[str] = set()
        starts: list[int] = []
        for needle, label in self.phrases:
            if at := places(line, needle):
                base.add(label)
                starts += at
        if text and _PLUS.search(text.encode()):
            words = b" + ".join(part.translate(_FOLD) for part in _PLUS.split(text.encode())).split()
            line = b" " + b" ".join(words) + b" "
        found = [(at, end, t.label) for t in self.templates for at in places(line, t.opening) if (end := t.run(words, at)) >= 0]
        own = longest(found)
        score = 1.0 if own else 0.5 if base else 0.0
        return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each input row: identifier and what was found.

    Null or empty text has no words, empty labels and score 0. The score is 1
    where a template accepts, 0.5 where only a base phrase stands. first_word
    and last_word are null without a base phrase. Repeated rows are scanned
    each; extra columns are ignored.
    """

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for texts in batches:
            yield pd.DataFrame([scanner(t) for t in texts], columns=columns).astype({"first_word": "Int64", "last_word": "Int64"})

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(find, FOUND)(F.col(f"`{text_col}`").cast("string"))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), found.alias("_found")).select(id_col, "_found.*")
