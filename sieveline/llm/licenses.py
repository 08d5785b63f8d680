"""License scans: ordered signature rules behind a keyword filter."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .kernel import U, Words, blocks

#: Phrases that always count, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Licences: label; names as regular expressions over normalised text (words
#: of letters and digits, one space between); identifiers as in license tags.
LICENSES = """
gpl-1.0: gnu general public license(?: version)? (?:v ?)?1(?: 0)?: gpl 1 0(?: only| or later)?
gpl-2.0: gnu general public license(?: version)? (?:v ?)?2(?: 0)?: gpl ?v? ?2 0(?: only| or later)?
gpl-3.0: gnu general public license(?: version)? (?:v ?)?3(?: 0)?: gpl ?v? ?3 0(?: only| or later)?
lgpl-2.0: gnu library general public license(?: version)? (?:v ?)?2(?: 0)?: lgpl 2 0(?: only| or later)?
lgpl-2.1: gnu lesser general public license(?: version)? (?:v ?)?2 1: lgpl 2 1(?: only| or later)?
lgpl-3.0: gnu lesser general public license(?: version)? (?:v ?)?3(?: 0)?: lgpl 3 0(?: only| or later)?
lgpl: gnu (?:lesser|library) general public license: lgpl
agpl-3.0: gnu affero general public license(?: version)? (?:v ?)?3(?: 0)?: agpl 3 0(?: only| or later)?
agpl: gnu affero general public license: agpl
gfdl: gnu free documentation license(?: version 1 [123])?: gfdl 1 [123](?: only| or later)?
apache-1.0: apache (?:software )?license(?: version)? 1 0: apache 1 0
apache-1.1: apache (?:software )?license(?: version)? 1 1: apache 1 1
apache-2.0: apache (?:software )?license(?: version)? 2(?: 0)?: apache 2 0
mit: mit license: mit
mit-0: mit no attribution(?: license)?: mit 0
x11: x11 license: x11
expat: expat license: expat
bsd-1-clause: bsd 1 clause(?: license)?: bsd 1 clause
bsd-2-clause: (?:simplified bsd|bsd 2 clause|freebsd) license: bsd 2 clause(?: views| patent)?
bsd-3-clause: (?:new bsd|modified bsd|revised bsd|bsd 3 clause) license: bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause: (?:original bsd|bsd 4 clause|old bsd) license: bsd 4 clause(?: uc)?
bsd: bsd license: bsd
0bsd: zero clause bsd(?: license)?: 0bsd
isc: isc license: isc
mpl-1.0: mozilla public license(?: version)? 1 0: mpl 1 0
mpl-1.1: mozilla public license(?: version)? 1 1: mpl 1 1
mpl-2.0: mozilla public license(?: version)? (?:v ?)?2 0: mpl 2 0
mpl: mozilla public license: mpl
epl-1.0: eclipse public license(?: version)? (?:v ?)?1 0: epl 1 0
epl-2.0: eclipse public license(?: version)? (?:v ?)?2 0: epl 2 0
cddl-1.0: common development and distribution license(?: version)? 1 0: cddl 1 0
cddl: common development and distribution license: cddl(?: 1 1)?
cpl-1.0: common public license(?: version 1 0)?: cpl 1 0
eupl: european union public license: eupl 1 [012]
artistic-1.0: artistic license(?: version)? 1 0: artistic 1 0
artistic-2.0: artistic license(?: version)? 2 0: artistic 2 0
artistic: artistic license: artistic
zlib: zlib license: zlib
libpng: (?:png reference library|libpng) license: libpng(?: 2 0)?
bsl-1.0: boost software license(?: version 1 0)?: bsl 1 0
unlicense: the unlicense: unlicense
wtfpl: do what the fuck you want to public license: wtfpl
cc0-1.0: (?:creative commons zero|cc0)(?: 1 0)?(?: universal)?(?: license| public domain dedication): cc0 1 0
cc-by-nc-nd: (?:creative commons attribution|cc by) (?:noncommercial|nc) (?:noderivatives|noderivs|nd)(?: [1234] 0)?: cc by nc nd [1234] 0
cc-by-nc-sa: (?:creative commons attribution|cc by) (?:noncommercial|nc) (?:sharealike|share alike|sa)(?: [1234] 0)?: cc by nc sa [1234] 0
cc-by-nc: (?:creative commons attribution|cc by) (?:noncommercial|nc)(?: [1234] 0)?: cc by nc [1234] 0
cc-by-nd: (?:creative commons attribution|cc by) (?:noderivatives|noderivs|nd)(?: [1234] 0)?: cc by nd [1234] 0
cc-by-sa: (?:creative commons attribution|cc by) (?:sharealike|share alike|sa)(?: [1234] 0)?: cc by sa [1234] 0
cc-by-4.0: (?:creative commons attribution|cc by)(?: international)? 4 0(?: international)?(?: public)?(?: license)?: cc by 4 0
cc-by-3.0: (?:creative commons attribution|cc by)(?: unported)? 3 0(?: unported)?(?: license)?: cc by 3 0
cc-by: creative commons attribution license: cc by
ofl-1.1: sil open font license(?: version 1 [01])?: ofl 1 [01]
psf-2.0: (?:python software foundation|psf) license(?: version 2)?: (?:psf|python) 2 0
php-3.01: php license(?: version 3 01)?: php 3 0?1
ruby: ruby license: ruby
vim: vim license: vim
w3c: w3c software (?:notice and )?license: w3c
openssl: openssl license: openssl
postgresql: postgresql license: postgresql
ncsa: university of illinois(?: ncsa)? open source license: ncsa
ms-pl: microsoft public license: ms pl
ms-rl: microsoft reciprocal license: ms rl
afl-3.0: academic free license(?: version)?(?: [123] [012])?: afl [123] [012]
osl-3.0: open software license(?: version)?(?: [123] [012])?: osl [123] [01]
odbl: open (?:data commons open )?database license: odbl 1 0
odc-by: open data commons attribution license: odc by 1 0
pddl: open data commons public domain dedication(?: and license)?: pddl 1 0
upl: universal permissive license: upl 1 0
blueoak: blue oak model license: blueoak 1 0 0
mulan: mulan (?:permissive software|psl) license: mulanpsl [12] 0
sspl: server side public license: sspl 1 0
busl: business source license: busl 1 1
elastic: elastic license(?: 2 0)?: elastic 2 0
openrail: (?:creativeml|bigscience|bigcode) open ?rail(?: m)?(?: license)?: open ?rail(?: m)?
"""
#: Short names with a version as they stand in running text: label, name and
#: pattern of the version. They are also tried in the form FORMS calls "under".
SHORT = """
gpl-1.0: gpl: 1 0
gpl-2.0: gpl: 2(?: 0)?(?: only| or later)?
gpl-3.0: gpl: 3(?: 0)?(?: only| or later)?
lgpl-2.0: lgpl: 2 0(?: only| or later)?
lgpl-2.1: lgpl: 2 1(?: only| or later)?
lgpl-3.0: lgpl: 3(?: 0)?(?: only| or later)?
agpl-3.0: agpl: 3(?: 0)?(?: only| or later)?
apache-2.0: apache: 2 0
mpl-1.1: mpl: 1 1
mpl-2.0: mpl: 2 0
epl-1.0: epl: 1 0
epl-2.0: epl: 2 0
cddl-1.0: cddl: 1 0
eupl: eupl: 1 [012]
cc-by-sa: cc by sa: [1234] 0
cc-by-nc: cc by nc: [1234] 0
"""
#: Words of the same length that are read as another.
READ_AS = {"licence": "license", "licences": "licenses"}
#: Ways to state a license, with a confidence and a priority; the first is tried
#: with names and identifiers, the tag form with identifiers only.
FORMS = (
    ("tag", r"spdx license identifier {id}", 1.0, 40),
    ("under", r"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 0.95, 30),
    ("name", r"{name}", 0.85, 20),
    ("field", r"license {id}", 0.7, 10),
)
#: Sentences that licence texts and headers are known by: label, words all of
#: which must occur, pattern, confidence, priority.
TEXTS = (
    ("mit", "permission granted person copy", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?", 0.98, 60),
    ("mit", "notice substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.9, 50),
    ("gpl", "redistribute gnu", r"you can redistribute it and or modify it under the terms of the gnu general public license", 0.98, 60),
    ("gpl", "gnu general details", r"see the gnu general public license for more details", 0.9, 50),
    ("lgpl", "redistribute gnu", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.98, 61),
    ("agpl", "redistribute affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.98, 61),
    ("apache-2.0", "licensed apache", r"licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?", 0.98, 60),
    ("bsd", "redistributions source", r"redistributions of source code must retain the above copyright notice", 0.95, 60),
    ("bsd-3-clause", "endorse promote", r"neither the name of .{1,120}? may be used to endorse or promote products derived from this software", 0.95, 60),
    ("bsd-4-clause", "advertising acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", 0.95, 60),
    ("isc", "permission fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95, 60),
    ("zlib", "misrepresented origin", r"the origin of this software must not be misrepresented", 0.95, 60),
    ("mpl-2.0", "mozilla public", r"subject to the terms of the mozilla public license v 2 0", 0.98, 60),
    ("unlicense", "unencumbered domain", r"this is free and unencumbered software released into the public domain", 0.98, 60),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0", 0.98, 60),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1234] 0)?(?: international| unported)? license", 0.9, 15),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1234] 0", 0.95, 45),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1234] 0", 0.95, 46),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1234] 0", 0.95, 46),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 0.95, 46),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8, 25),
    ("proprietary", "rights reserved", r"all rights reserved", 0.4, 1),
    ("proprietary", "proprietary confidential", r"proprietary and confidential", 0.7, 15),
    ("wtfpl", "wtfpl", r"wtfpl version 2", 0.9, 30),
)


#: More sentences, that no other licence has: label and pattern.
SENTENCES = """
mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit: to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit: released under the (?:terms of the )?mit licence
mit-0: and to permit persons to whom the software is furnished to do so the software is provided as is
gpl-2.0: either version 2 of the license or at your option any later version
gpl-2.0: under the terms of version 2 of the gnu general public license
gpl-2.0: the gnu general public license is intended to guarantee your freedom to share and change free software
gpl-3.0: either version 3 of the license or at your option any later version
gpl-3.0: the gnu general public license is a free copyleft license for software and other kinds of works
gpl: you should have received a copy of the gnu general public license along with this (?:program|software|file|package)
gpl: may be distributed under the terms of the (?:gnu )?gpl
lgpl: you should have received a copy of the gnu (?:lesser|library) general public license
lgpl: this (?:library|program) is free software licensed under the lgpl
lgpl-2.1: either version 2 1 of the license or at your option any later version
lgpl-3.0: this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl-3.0: the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation
agpl: you should have received a copy of the gnu affero general public license
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
apache-2.0: you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0: terms and conditions for use reproduction and distribution 1 definitions
apache-1.1: this product includes software developed by the apache software foundation
bsd-2-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd: this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd: use of this source code is governed by a bsd style license that can be found in the license file
bsd-3-clause: the names? of (?:its|any) contributors? may not be used to endorse or promote products
bsd-4-clause: this product includes software developed by the university of california
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
isc: provided that the above copyright notice and this permission notice appear in all copies
x11: except as contained in this notice the name of the x consortium shall not be used in advertising
expat: copyright .{1,60}? thai open source software center
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib: this notice may not be removed or altered from any source distribution
libpng: the contributing authors and group 42 inc disclaim all warranties
mpl-2.0: this source code form is subject to the terms of the mozilla public license
mpl-2.0: if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl: the contents of this file are subject to the terms of the common development and distribution license
cddl: when distributing covered code include this cddl header notice in each file
cpl-1.0: the accompanying program is provided under the terms of this common public license
eupl: licensed under the eupl(?: version)? 1 [012] or as soon they will be approved by the european commission
artistic-2.0: this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-1.0: the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense: anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense: the author or authors of this code dedicate any and all copyright interest in the software to the public domain
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl: you just do what the fuck you want to
cc0-1.0: the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0: to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights
cc0-1.0: no copyright this work has been dedicated to the public domain
cc-by: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by: attribution you must give appropriate credit
cc-by: licensed under a creative commons attribution
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc: you may not use the material for commercial purposes
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
cc-by-nc-nd: creativecommons org licenses by nc nd [1234] 0
cc-by-nc-sa: creativecommons org licenses by nc sa [1234] 0
cc-by-nd: creativecommons org licenses by nd [1234] 0
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-3.0: creativecommons org licenses by 3 0
ofl-1.1: this font software is licensed under the sil open font license
ofl-1.1: the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
psf-2.0: this license agreement is between the python software foundation psf and the individual or organization
php-3.01: this product includes php software freely available from
ruby: you can redistribute it and or modify it under either the terms of the 2 clause bsdl
vim: there are no restrictions on distributing unmodified copies of vim except that they must include this license text
w3c: by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
openssl: this product includes cryptographic software written by eric young
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
afl-3.0: licensed under the academic free license version [23] [01]
osl-3.0: licensed under the open software license version [23] [01]
odbl: this .{1,60}? is made available under the open database license
odc-by: this .{1,60}? is made available under the open data commons attribution license
pddl: this .{1,60}? is made available under the public domain dedication and license
upl: subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
blueoak: in order to receive this license you must agree to its rules
sspl: if you make the functionality of the program or a modified version available to third parties as a service
busl: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic: you may not provide the software to third parties as a hosted or managed service
openrail: use based restrictions as referenced in paragraph 5
json: the software shall be used for good not evil
beerware: if we meet some day and you think this stuff is worth it you can buy me a beer in return
commons-clause: the license does not grant to you the right to sell the software
commons-clause: commons clause license condition
polyform: polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) license
llama: llama (?:2|3|3 1|3 2|3 3) community license(?: agreement)?
gemma: gemma terms of use
fair: usage of the works is permitted provided that this instrument is retained with the works
curl: curl license
icu: icu license
jpeg: this software is based in part on the work of the independent jpeg group
freetype: portions of this software are copyright .{1,40}? the freetype project
sunpro: permission to use copy modify and distribute this software is freely granted provided that this notice is preserved
hpnd: that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
public-domain: this (?:work|file|software|code) is (?:hereby )?(?:in the public domain|public domain)
proprietary: unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document) .{0,40}?(?:is )?strictly prohibited
proprietary: no part of this (?:publication|document|book) may be reproduced
proprietary: this software is the confidential and proprietary information of
"""


class Rule(NamedTuple):
    label: str
    needs: tuple[tuple[str, ...], ...]  # any of these, all of its words
    body: str
    score: float
    priority: int
    order: int

    @property
    def pattern(self) -> re.Pattern:
        """Compiled when a text first needs it."""
        return _compiled(self.body)


@functools.cache
def _compiled(body: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{body})(?![^ ])")


def _spellings(flat: str) -> list[str]:
    """A pattern without groups, with and without each optional character."""
    m = re.search(r"(.)\?", flat)
    return [x for c in (m[1], "") for x in _spellings(flat[: m.start()] + c + flat[m.end() :])] if m else [flat]


def _needs(pattern: str) -> set[frozenset[str]]:
    """Sets of words, one of which every match of a pattern holds: those outside
    of groups, and whole; a set for each spelling."""
    flat = re.sub(r"\.\{\d+,\d+\}\??", "\0", pattern)  # any text
    flat = re.sub(r"\(\?:(?: [^()|]*(?:\||(?=\))))+\)\??", " \0", flat)  # groups that begin with a space
    for _ in range(2):
        flat = re.sub(r"\(\?:[^()]*\)\??", "\0", flat)
    words = lambda x: re.findall(r"(?<![\w\0\]\[])[a-z0-9]{2,}(?![\w\0\]\[*+{(])", x)
    return {frozenset(words(x)) - {"the", "of", "under"} for x in _spellings(flat)}


def _gates(pattern: str, more: str = "") -> tuple[tuple[str, ...], ...]:
    """Sets of words, one of which is in every text that the pattern matches."""
    always = {x | {*more.split()} for x in _needs(pattern)}
    if all(always):
        return tuple(sorted(tuple(sorted(x)) for x in always if not any(y < x for y in always)))
    choices = re.match(r"\(\?:([^()]*)\)", pattern)
    return tuple(tuple(re.findall(r"[a-z0-9]+", c)) for c in choices[1].split("|"))


def rules() -> list[Rule]:
    out = []
    for line in LICENSES.strip().splitlines():
        label, name, tag = re.split(r"(?<!\(\?): ", line)
        for form, shape, score, priority in FORMS:
            body = shape.format(name=f"(?:{name})" if form == "under" else name, id=f"(?:{tag})")
            needs = _gates(name if "{name}" in shape else tag, {"tag": "spdx license identifier", "field": "license"}.get(form, ""))
            out.append((label, needs, body, score, priority))
    under = next(f for f in FORMS if f[0] == "under")
    for label, name, version in (re.split(r"(?<!\(\?): ", line) for line in SHORT.strip().splitlines()):
        for short in (rf"{name}(?: version)? (?:v ?)?{version}", rf"{name}v?{version}"):
            out += [(label, _gates(short), under[1].format(name=rf"(?:(?:gnu )?{short}(?: license)?)"), *under[2:]), (label, _gates(short), short, 0.8, 18)]
    out += [(label, (tuple(needs.split()),), body, score, priority) for label, needs, body, score, priority in TEXTS]
    out += [(label, _gates(body), body, 0.95, 55) for label, body in (line.split(": ", 1) for line in SENTENCES.strip().splitlines())]
    return [Rule(a, n, b, s, p, k) for k, (a, n, b, s, p) in enumerate(out)]


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop detections that lie inside one of higher priority, or of equal
    priority that is longer or comes earlier in the rules.

    Those that stand enter a tree of largest ends by start, so that one look-up
    says whether any of them starts before and ends behind a detection."""
    starts = sorted({s for s, _, _ in found})
    far = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for s, e, r in sorted(found, key=lambda x: (-x[2].priority, -(x[1] - x[0]), x[2].order, x[0])):
        at = k = bisect.bisect_left(starts, s) + 1
        end = -1
        while k:
            end = max(end, far[k])
            k &= k - 1
        if end < e:
            kept.append((s, e, r))
            while at < len(far):
                far[at] = max(far[at], e)
                at += at & -at
    return kept


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
_rules: list[Rule] = []


def _read(text: str) -> list[str]:
    return [READ_AS.get(w, w) for w in _WORD.findall(text.translate(_FOLD))]


def detect(text: str, open_rules: list[Rule] | None = None) -> list[tuple[int, int, Rule]]:
    """Detections that stand, as (first word, end word, rule). open_rules: those
    whose gates the text passes, if that is known."""
    if not _rules:
        _rules.extend(rules())
    words = _read(text)
    flat = " ".join(words)
    if open_rules is None:
        have = set(words)
        open_rules = [r for r in _rules if any(have.issuperset(need) for need in r.needs)]
    found = [(m.start(), m.end(), r) for r in open_rules for m in r.pattern.finditer(flat)]
    first = list(itertools.accumulate((len(w) + 1 for w in words), initial=0)) if found else []  # where words begin
    return [(bisect.bisect_right(first, s) - 1, bisect.bisect_left(first, e), r) for s, e, r in resolve(found)]


def _word_keys(words: list[str]) -> np.ndarray:
    enc = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(e) for e in enc])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(enc), np.uint8), at, alnum=True).key


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _rules:
        _rules.extend(rules())
    phrases = [(_word_keys(p.split()), label) for p, label in BASE]
    gates = sorted({n for r in _rules for need in r.needs for n in need})
    index = {g: k for k, g in enumerate(gates)}
    alias = [w for w, as_ in READ_AS.items() if as_ in index]
    gate_keys = _word_keys(gates + alias)
    by_key = np.argsort(gate_keys)
    gate_sorted, order = gate_keys[by_key], np.array([*range(len(gates)), *(index[READ_AS[w]] for w in alias)])[by_key]
    near = np.zeros(1 << 16, bool)
    near[(gate_keys >> U(48)).astype(np.int64)] = True
    wants = list(dict.fromkeys(need for r in _rules for need in r.needs))
    columns = [[index[n] for n in want] for want in wants]
    number = {want: k for k, want in enumerate(wants)}
    # the wants of all rules one after the other, and where each rule's begin
    of_rules = np.array([number[need] for r in _rules for need in r.needs])
    begins = np.cumsum([0, *(len(r.needs) for r in _rules[:-1])])
    for batch in batches:
        for i, j, buf, at in blocks(batch.column(1)):
            w = Words(buf, at, alnum=True)
            n = j - i
            n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for keys, label in phrases:
                p = np.flatnonzero(w.key == keys[0])
                p = p[p + len(keys) <= len(w.key)]
                for k in range(1, len(keys)):
                    p = p[w.key[p + k] == keys[k]]
                p = p[w.doc[p] == w.doc[p + len(keys) - 1]]
                d = w.doc[p]
                place = p - w.ofs[d]
                n_base += np.bincount(d, minlength=n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(low, d, place)
                np.maximum.at(high, d, place)
                first = np.where(high >= 0, np.where(first < 0, low, np.minimum(first, low)), first)
                last = np.maximum(last, high)
                for x in np.unique(d).tolist():
                    base[x].add(label)
            p = np.flatnonzero(near[(w.key >> U(48)).astype(np.int64)])
            g = np.minimum(np.searchsorted(gate_sorted, w.key[p]), len(gate_sorted) - 1)
            m = gate_sorted[g] == w.key[p]
            have = np.zeros((n, len(gates)), bool)
            have[w.doc[p[m]], order[g[m]]] = True
            rows = np.flatnonzero(have.any(axis=1))
            passed = np.stack([have[rows][:, c].all(axis=1) for c in columns], axis=1)
            opened = np.logical_or.reduceat(passed[:, of_rules], begins, axis=1)
            labels = [set(b) for b in base]
            score = np.where(n_base > 0, 0.85, 0.0)
            spans: list[list] = [[] for _ in range(n)]
            for k in np.flatnonzero(opened.any(axis=1)).tolist():
                x = int(rows[k])
                for s, e, r in detect(buf[at[x] : at[x + 1]].tobytes().decode("utf-8", "replace"), [_rules[i] for i in np.flatnonzero(opened[k]).tolist()]):
                    labels[x].add(r.label)
                    score[x] = max(score[x], r.score)
                    spans[x].append({"label": r.label, "start": s, "end": e, "score": r.score})
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), pa.array(np.diff(w.ofs)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b)) for b in labels]), pa.array(score), pa.array([sorted(s, key=lambda d: (d["start"], d["end"])) for s in spans], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in every text; one row per input row.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and
    non-ASCII characters. n_base counts all places where a BASE phrase stands,
    first_word and last_word are their smallest and largest start (null without
    any). Signature rules run over the normalised text of those rows whose words
    pass a rule's keyword filter; of overlapping detections one that lies inside
    another of higher priority falls away. labels joins both; score is the
    highest confidence among them, 0 without any; detections lists the spans.

    Null or empty texts: no words, no labels, score 0. Very long texts are taken
    whole, in time n log n of their detections. Repeated rows and ids get a row
    each; no rows give no rows; extra columns, whatever their names, are
    ignored. A map-only pass.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,score:double>>")
