"""License scan: ordered signature rules over normalised words.

A text is lower-cased and cut into words; rules are regular expressions over
the words joined by single spaces, so ``Apache-2.0`` and ``apache 2 0`` are the
same to them.  A prefilter decides which rules run on a text at all: those of
whose pattern a text holds a literal that every match must contain.
Detections that overlap are resolved by priority: a detection whose words lie
inside those of a better rule's detection is dropped.

One pass over the rows, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import pairwise
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_texts

#: What each byte becomes: A-Z lower case, [0-9a-z] and all beyond ASCII as they are, the rest a blank.
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed values, one line a family: label; name as a pattern over words; versions.
FAMILIES = """
agpl; (?:gnu )?affero general public licen[cs]e; 1.0 3.0
lgpl; (?:gnu )?(?:lesser|library) general public licen[cs]e; 2.0 2.1 3.0
gpl; (?:gnu )?general public licen[cs]e; 1.0 2.0 3.0
gfdl; (?:gnu )?free documentation licen[cs]e; 1.1 1.2 1.3
apache; apache (?:software )?licen[cs]e; 1.0 1.1 2.0
mit; (?:the )?mit licen[cs]e;
x11; x11 licen[cs]e;
isc; isc licen[cs]e;
bsd; (?:(?:new|simplified|revised|modified|original) )?bsd(?: style)? licen[cs]e; 2-clause 3-clause 4-clause
0bsd; (?:zero clause|bsd zero clause|0 clause) bsd(?: licen[cs]e)?;
mpl; mozilla public licen[cs]e; 1.0 1.1 2.0
epl; eclipse public licen[cs]e; 1.0 2.0
edl; eclipse distribution licen[cs]e; 1.0
cddl; common development and distribution licen[cs]e; 1.0 1.1
cpl; common public licen[cs]e; 1.0
ipl; ibm public licen[cs]e; 1.0
eupl; european union public licen[cs]e; 1.0 1.1 1.2
cecill; cecill(?: free software)? licen[cs]e; 1.0 2.0 2.1
artistic; (?:perl )?artistic licen[cs]e; 1.0 2.0
psf; python software foundation licen[cs]e; 2.0
zlib; zlib(?: libpng)? licen[cs]e;
libpng; libpng licen[cs]e; 2.0
boost; boost software licen[cs]e; 1.0
unlicense; (?:the )?unlicense;
wtfpl; (?:do what the fuck you want to public licen[cs]e|wtfpl);
openssl; openssl licen[cs]e;
php; php licen[cs]e; 3.0 3.01
zend; zend licen[cs]e; 2.0
ruby; ruby licen[cs]e;
w3c; w3c software (?:notice and )?licen[cs]e;
unicode; unicode(?: data files and software)? licen[cs]e; 3.0
ofl; (?:sil )?open font licen[cs]e; 1.0 1.1
postgresql; postgresql licen[cs]e;
ncsa; (?:university of illinois )?ncsa open source licen[cs]e;
afl; academic free licen[cs]e; 1.1 2.0 2.1 3.0
osl; open software licen[cs]e; 1.0 2.0 2.1 3.0
ms-pl; microsoft public licen[cs]e;
ms-rl; microsoft reciprocal licen[cs]e;
sspl; server side public licen[cs]e; 1.0
busl; business source licen[cs]e; 1.1
elastic; elastic licen[cs]e; 2.0
vim; vim licen[cs]e;
tcl; tcl tk licen[cs]e;
upl; universal permissive licen[cs]e; 1.0
apsl; apple public source licen[cs]e; 1.0 2.0
nasa; nasa open source agreement; 1.3
odbl; open (?:data commons open )?database licen[cs]e; 1.0
odc-by; open data commons attribution licen[cs]e; 1.0
pddl; public domain dedication and licen[cs]e; 1.0
""".strip().splitlines()

# Parts of the Creative Commons names, and their versions.
_CC = {"cc-by": "by", "cc-by-sa": "by sa", "cc-by-nd": "by nd", "cc-by-nc": "by nc", "cc-by-nc-sa": "by nc sa", "cc-by-nc-nd": "by nc nd"}
_CC_LONG = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Sentences that stand in license texts and notices, without a name. Label; pattern; how sure.
SENTENCES = """
mit; permission is hereby granted free of charge to any person obtaining a copy of this software; 0.95
mit; the above copyright notice and this permission notice shall be included in all copies or substantial portions; 0.9
isc; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted; 0.95
bsd; redistribution and use in source and binary forms with or without modification are permitted; 0.9
bsd-3-clause; neither the name of (?:\\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse; 0.9
bsd-4-clause; all advertising materials mentioning features or use of this software must display; 0.9
zlib; the origin of this software must not be misrepresented; 0.9
gpl; (?:you can|may) redistribute it and or modify it under the terms of the gnu (?:\\S+ )?general public licen[cs]e; 0.9
gpl; see the gnu general public licen[cs]e for more details; 0.9
apache; unless required by applicable law or agreed to in writing software distributed under the licen[cs]e; 0.95
unlicense; this is free and unencumbered software released into the public domain; 0.95
boost; all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code; 0.9
mit; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability; 0.8
mit; in no event shall the authors or copyright holders be liable for any claim damages or other liability; 0.75
isc; the software is provided as is and the author disclaims all warranties with regard to this software; 0.8
isc; in no event shall the author be liable for any special direct indirect or consequential damages; 0.7
bsd; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer; 0.85
bsd; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer; 0.85
bsd; this software is provided by the (?:\\S+ ){1,8}as is and any express or implied warranties; 0.8
bsd-3-clause; the names? of (?:\\S+ ){1,12}may not be used to endorse or promote products derived from this software without specific prior written permission; 0.85
bsd-4-clause; this product includes software developed by; 0.6
zlib; altered source versions must be plainly marked as such and must not be misrepresented as being the original software; 0.9
zlib; this software is provided as is without any express or implied warranty; 0.6
gpl; this program is free software you can redistribute it and or modify it; 0.85
gpl; this program is distributed in the hope that it will be useful but without any warranty; 0.8
gpl; you should have received a copy of the gnu general public licen[cs]e along with; 0.9
gpl-2.0; gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2; 0.97
gpl-3.0; gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3; 0.97
gpl; everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document; 0.6
lgpl; this library is free software you can redistribute it and or modify it; 0.85
lgpl; you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with; 0.92
agpl; you should have received a copy of the gnu affero general public licen[cs]e along with; 0.92
agpl; if your software can interact with users remotely through a computer network; 0.85
gfdl; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e; 0.92
apache-2.0; you may not use this file except in compliance with the licen[cs]e; 0.7
apache-2.0; you may obtain a copy of the licen[cs]e at http www apache org licenses license 2 0; 0.97
apache; this product includes software developed (?:by|at) the apache software foundation; 0.8
mpl-2.0; this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0; 0.98
mpl-1.1; the contents of this file are subject to the mozilla public licen[cs]e version 1 1; 0.98
epl; this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e; 0.93
cddl; the contents of this file are subject to the terms of the common development and distribution licen[cs]e; 0.93
artistic; this package is free software you can redistribute it and or modify it under the terms of the artistic licen[cs]e; 0.93
perl; under the same terms as perl itself; 0.85
python; under the same terms as python itself; 0.7
boost-1.0; permission is hereby granted free of charge to any person or organization obtaining a copy of the software; 0.95
ncsa; neither the names of (?:\\S+ ){1,16}nor the names of its contributors may be used to endorse or promote products derived from this software without; 0.8
openssl; this product includes software developed by the openssl project; 0.9
postgresql; permission to use copy modify and distribute this software and its documentation for any purpose without fee; 0.85
ofl; this font software is licensed under the sil open font licen[cs]e; 0.97
ofl; the font software may be sold as part of a larger software package but no copy; 0.8
unicode; permission is hereby granted free of charge to any person obtaining a copy of the unicode data files; 0.95
wtfpl; everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document; 0.85
beerware; as long as you retain this notice you can do whatever you want with this stuff; 0.9
json; the software shall be used for good not evil; 0.9
cc-by; you are free to (?:share|copy) (?:\\S+ ){0,20}attribution; 0.5
cc-by-sa; text (?:is )?available under (?:the )?creative commons attribution sharealike licen[cs]e; 0.95
cc-by-nc; for non ?commercial purposes only; 0.4
cc0; to the extent possible under law (?:\\S+ ){1,12}(?:has|have) waived all copyright; 0.95
cc0; no rights reserved; 0.6
commons-clause; commons clause licen[cs]e condition; 0.95
proprietary; unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material); 0.8
proprietary; this (?:software|document|file) (?:contains|is) (?:\\S+ ){0,6}trade secrets?; 0.7
proprietary; for internal use only; 0.5
proprietary; reproduction in whole or in part (?:\\S+ ){0,4}(?:is )?prohibited; 0.6
evaluation; for evaluation (?:purposes|use) only; 0.6
eula; end user licen[cs]e agreement; 0.7
eula; by installing (?:\\S+ ){1,8}you agree to; 0.5
public-domain; no copyright is claimed; 0.6
public-domain; work of the (?:us|united states) government; 0.6
public-domain; (?:released|placed|dedicated) (?:in|into|to) the public domain; 0.8
public-domain; (?:is|are) in the public domain; 0.6
cc0; cc0(?: 1 0)?(?: universal)?; 0.9
cc0; waived all copyright and related or neighboring rights; 0.8
proprietary; proprietary and confidential; 0.8
proprietary; all rights reserved; 0.5
proprietary; (?:no part of this|may not be) (?:\\S+ ){0,8}(?:reproduced|copied|distributed) (?:\\S+ ){0,12}(?:without|prior) (?:\\S+ ){0,4}permission; 0.6
copyright; copyright (?:c )?(?:19|20)\\d\\d; 0.4
spdx; spdx license identifier; 0.3
unknown; licensed under (?:the )?(?:terms of )?\\S+; 0.2
""".strip().splitlines()


class Rule(NamedTuple):
    label: str
    needs: tuple[str, ...]  # a text without any of these has no match
    pattern: re.Pattern
    sure: float


def _version(v: str) -> str:
    """A version, with or without the word; its last part may be left out if it is 0 and no other number stands there."""
    parts = v.split(".")
    number = " ".join(parts[:-1]) + "(?: 0|(?! \\d))" if parts[-1] == "0" and len(parts) > 1 else " ".join(parts)
    return rf"(?: version)?(?: v)? ?v?{number}"


def needs(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of the pattern contains one at least: of all such choices, that with the longest shortest literal."""

    def of(seq) -> tuple[str, ...]:
        choices: list[tuple[str, ...]] = []
        run = ""
        for op, arg in seq:
            if op is _parser.LITERAL:
                run += chr(arg)
                continue
            choices.append((run,))
            run = ""
            if op is _parser.SUBPATTERN:
                choices.append(of(arg[3]))
            elif op is _parser.BRANCH:
                choices.append(tuple(x for branch in arg[1] for x in of(branch)))
            elif op is _parser.MAX_REPEAT and arg[0] > 0:
                choices.append(of(arg[2]))
        return max([*choices, (run,)], key=lambda c: min(map(len, c)))

    return of(_parser.parse(pattern))


@cache
def rules() -> tuple[Rule, ...]:
    """The signature rules, best first: the order is their priority."""
    made: list[tuple[float, str, str]] = []
    for line in FAMILIES:
        label, name, versions = (x.strip() for x in line.split(";"))
        licensed = rf"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?{name}"
        for v in versions.split():
            own = f"{label}-{v}"
            if "clause" in v:
                count = v[0]
                word = {"2": "(?:2|two)", "3": "(?:3|three)", "4": "(?:4|four)"}[count]
                made += [(0.99, own, rf"{word} clause {label}(?: licen[cs]e)?"), (0.99, own, rf"{label} {word} clause(?: licen[cs]e)?")]
            else:
                made += [(0.98, own, licensed + _version(v)), (0.96, own, name + _version(v)), (0.93, own, rf"{label.replace('-', ' ')} ?v?{_version(v)}(?: only| or later)?")]
        made += [(0.9, label, licensed), (0.85, label, name)]
        spdx = rf"spdx licen[cs]e identifier {label.replace('-', ' ')}"
        made += [(0.995, f"{label}-{v}", f"{spdx} {v.replace('-', ' ')}" if "clause" in v else f"{spdx}{_version(v)}(?: only| or later)?") for v in versions.split()]
        made.append((0.97, label, rf"{spdx}(?: \d+)*(?: only| or later)?"))
    for label, parts in _CC.items():
        long = " ".join(_CC_LONG[p] for p in parts.split())
        for v in _CC_VERSIONS:
            made += [(0.97, f"{label}-{v}", rf"cc {parts}{_version(v)}"), (0.97, f"{label}-{v}", rf"creative commons {long}{_version(v)}"), (0.97, f"{label}-{v}", rf"creativecommons org licenses {parts} {v.replace('.', ' ')}")]
        made += [(0.88, label, rf"cc {parts}"), (0.88, label, rf"creative commons {long}")]
    for line in SENTENCES:
        label, pattern, sure = (x.strip() for x in line.split(";"))
        made.append((float(sure), label, pattern))
    made.sort(key=lambda r: -r[0])
    return tuple(Rule(label, needs(f" {pattern}"), re.compile(rf"(?<!\S){pattern}(?!\S)"), sure) for sure, label, pattern in made)


@cache
def _needs() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """All literals of the rules: those with :data:`_COMMON`, and the others."""
    every = sorted({x for r in rules() for x in r.needs})
    return tuple(x for x in every if _COMMON in x), tuple(x for x in every if _COMMON not in x)


#: Most literals hold this, so a text without it is asked for the others only.
_COMMON = "licen"


def normal(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of [0-9a-z] and of what lies beyond ASCII, after lower-casing A-Z."""
    return raw.translate(_NORMAL).split()


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(word index, label) of each place of a base phrase, in words joined and enclosed by blanks."""
    out = []
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at, seen, word = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            out.append((word, label))
            seen, at = at, joined.find(needle, at + 1)
    return sorted(out)


class Cover:
    """Intervals, without those inside others: both ends ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, i: int, j: int) -> bool:
        """Adds an interval, unless it lies inside one that is there."""
        at = bisect_right(self.starts, i)
        if at and self.ends[at - 1] >= j:
            return False
        # those that lie inside the new one have no say any more
        begin, end = bisect_left(self.starts, i), bisect_right(self.ends, j)
        self.starts[begin : max(begin, end)] = [i]
        self.ends[begin : max(begin, end)] = [j]
        return True


_OTHER_BLANK = re.compile(r"[^\S ]")


def detect(joined: str) -> list[tuple[str, int, int, float]]:
    """(label, first character, end, how sure) of what the rules find, without detections inside a better one's."""
    # what counts as a blank before a rule's first word counts as one here
    flat = joined if joined.isascii() else _OTHER_BLANK.sub(" ", joined)
    common, others = _needs()
    met = {x for x in (*(common if _COMMON in flat else ()), *others) if x in flat}
    if not met:
        return []
    kept: list[tuple[str, int, int, float]] = []
    cover = Cover()
    for rule in rules():
        if not met.isdisjoint(rule.needs):
            for m in rule.pattern.finditer(joined):
                if cover.add(*m.span()):
                    kept.append((rule.label, *m.span(), rule.sure))
    return sorted(kept, key=lambda x: (x[1], -x[2], x[0]))


_FIELDS = [
    pa.field("n_words", pa.int64()),
    pa.field("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
    pa.field("detections", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("sure", pa.float64())]))),
]


def _scan(texts: pa.Array) -> list[list]:
    counts, bases, found = [], [], []
    for raw in texts.cast(pa.binary()).to_pylist():
        own = normal(raw) if raw else []
        counts.append(len(own))
        joined = b" ".join([b"", *own, b""]) if own else b""
        if not own:
            bases.append([])
            found.append([])
            continue
        bases.append([{"word": w, "label": label} for w, label in base_places(joined)])
        text = joined.decode(errors="replace")
        spans = detect(text)
        points = sorted({p for _, i, j, _ in spans for p in (i, j)})
        word = dict(zip(points, np.cumsum([text.count(" ", 0, points[0]) if points else 0, *(text.count(" ", a, b) for a, b in pairwise(points))]).tolist(), strict=False))
        found.append([{"label": label, "first_word": word[i] - 1, "end_word": word[j], "sure": sure} for label, i, j, sure in spans])
    return [counts, bases, found]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``n_words``, ``base`` places and ``detections`` of its whole text.

    Words count from 0; ``end_word`` is exclusive.  Null and empty texts have no
    words and empty lists.  Repeated rows and null ids stay; an empty table gives none.
    """
    fields = "n_words bigint, base array<struct<word:bigint,label:string>>, detections array<struct<label:string,first_word:bigint,end_word:bigint,sure:double>>"
    return map_texts(docs, {id_col: id_col}, text_col, _scan, fields, _FIELDS)
