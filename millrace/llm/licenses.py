"""License scan by ordered signature rules.

Rules are regexes over a text's normalised words: signatures written one by one (titles, headers, clauses, addresses and
versioned names, which outrank the bare ones), and those that families of license names make with the phrasings that cite
them. A rule runs only where a text holds its keyword, a word that every match has.
Detections are resolved in the order of the rules, by falling priority: one that overlaps a kept detection of a higher
priority goes, and so does one contained in the interval of a kept one of the same priority (of equal intervals the
earlier rule's stays). Base phrases are places where a phrase's words stand consecutively; they are counted before any
suppression, and their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import alnum_words, text_function

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Families: label, and the names by which texts call the license. Names are regexes over words that are joined by single
# spaces.
FAMILIES = (
    ("mit", ("mit", "mit x11", "expat mit")),
    ("apache-2.0", ("apache(?: software)?(?: license)? (?:version |v)?2(?: 0)?", "asl 2 0", "apache 2 0")),
    ("apache-1.1", ("apache(?: software)?(?: license)? (?:version |v)?1 1",)),
    ("gpl-3.0", ("(?:gnu )?general public license (?:version |v)?3(?: 0)?", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?")),
    ("gpl-2.0", ("(?:gnu )?general public license (?:version |v)?2(?: 0)?", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?")),
    ("lgpl-3.0", ("(?:gnu )?lesser general public license (?:version |v)?3(?: 0)?", "lgpl ?(?:version |v)?3(?: 0)?")),
    ("lgpl-2.1", ("(?:gnu )?lesser general public license (?:version |v)?2 1", "lgpl ?(?:version |v)?2 1")),
    ("agpl-3.0", ("(?:gnu )?affero general public license (?:version |v)?3(?: 0)?", "agpl ?(?:version |v)?3(?: 0)?")),
    ("lgpl", ("(?:gnu )?lgpl",)),
    ("lgpl", ("(?:gnu )?lesser general public license",)),
    ("agpl", ("(?:gnu )?affero general public license",)),
    ("gpl", ("(?:gnu )?gpl",)),
    ("gpl", ("gnu public license", "gnu general public license")),
    ("bsd-3-clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("bsd-2-clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd")),
    ("bsd-4-clause", ("bsd 4 clause", "4 clause bsd", "original bsd")),
    ("0bsd", ("0bsd", "zero clause bsd")),
    ("bsd", ("bsd", "berkeley software distribution bsd")),
    ("mpl-2.0", ("mozilla public license (?:version |v)?2(?: 0)?", "mpl ?(?:version |v)?2(?: 0)?")),
    ("mpl-1.1", ("mozilla public license (?:version |v)?1 1", "mpl ?(?:version |v)?1 1")),
    ("mpl", ("mozilla public license",)),
    ("epl-2.0", ("eclipse public license (?:version |v)?2(?: 0)?", "epl ?(?:version |v)?2(?: 0)?")),
    ("epl-1.0", ("eclipse public license (?:version |v)?1(?: 0)?", "epl ?(?:version |v)?1 0")),
    ("cddl-1.0", ("cddl", "common development and distribution license cddl")),
    ("eupl-1.2", ("european union public licen[cs]e (?:version |v)?1 2", "eupl ?(?:version |v)?1 2")),
    ("cc0-1.0", ("cc0(?: 1 0)?", "creative commons zero cc0")),
    ("cc-by-nc-nd", ("cc by nc nd(?: [1-4] [05])?", "creative commons attribution noncommercial noderivatives nd")),
    ("cc-by-nc-sa", ("cc by nc sa(?: [1-4] [05])?",)),
    ("cc-by-nc", ("cc by nc(?: [1-4] [05])?",)),
    ("cc-by-nd", ("cc by nd(?: [1-4] [05])?",)),
    ("cc-by-sa", ("cc by sa(?: [1-4] [05])?",)),
    ("cc-by", ("cc by(?: [1-4] [05])?",)),
    ("cc-by", ("creative commons attribution",)),
    ("isc", ("isc",)),
    ("zlib", ("zlib(?: libpng)?",)),
    ("unlicense", ("unlicense",)),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public license wtfpl")),
    ("artistic-2.0", ("artistic(?: license)? 2 0",)),
    ("artistic-1.0", ("artistic(?: license)? 1 0", "perl artistic")),
    ("bsl-1.0", ("boost software", "boost")),
    ("python-2.0", ("python software foundation", "python 2 0")),
    ("ofl-1.1", ("sil open font license ofl", "ofl ?(?:version |v)?1 1", "sil ofl")),
    ("odbl-1.0", ("odbl(?: 1 0)?", "open database license odbl")),
    ("afl-3.0", ("academic free license(?: (?:version |v)?3 0)?",)),
    ("ms-pl", ("microsoft public",)),
    ("ms-rl", ("microsoft reciprocal",)),
    ("postgresql", ("postgresql",)),
    ("openssl", ("openssl",)),
    ("php-3.01", ("php 3 01", "php")),
    ("ruby", ("ruby",)),
    ("x11", ("x11",)),
    ("ncsa", ("university of illinois ncsa", "ncsa")),
    ("sspl-1.0", ("server side public license(?: (?:version |v)?1)?",)),
    ("busl-1.1", ("business source license(?: 1 1)?",)),
    ("elastic-2.0", ("elastic license(?: 2 0)?",)),
    ("public-domain", ("public domain",)),
)
#: Phrasings around a name, with the priority of what they detect: {} is the name.
PHRASINGS = (
    (40, "spdx license identifier {}"),
    (30, "(?:re)?(?:licensed|released|distributed|published|available) (?:under|subject to) (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (30, "(?:dedicated|placed) (?:to|in|into) the {}"),
    (20, "(?:the )?{} licen[cs]e(?:d)?"),
    (20, "licen[cs]e (?:is )?(?:the )?{}"),
)
#: Rules that no family makes: label, priority, regex.
SINGLE = (
    ("mit", 35, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 34, "to deal in the software without restriction including without limitation the rights to use"),
    ("mit", 34, "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 33, "the software is provided as is without warranty of any kind express or implied"),
    ("x11", 36, "except as contained in this notice the name of the x consortium shall not be used"),
    ("isc", 35, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 34, "the author disclaims all warranties with regard to this software"),
    ("bsd", 35, "redistribution and use in source and binary forms with or without modification"),
    ("bsd", 34, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 34, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 36, "neither the name of .{1,60}? nor the names of its contributors may be used"),
    ("bsd-4-clause", 36, "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 35, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 36, "www apache org licenses license 2 0"),
    ("apache-2.0", 34, "distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", 25, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 24, "you should have received a copy of the gnu general public license"),
    ("gpl-2.0", 26, "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 26, "either version 3 of the license or at your option any later version"),
    ("gpl", 22, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", 35, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1", 36, "either version 2 1 of the license or at your option any later version"),
    ("agpl", 35, "you should have received a copy of the gnu affero general public license"),
    ("mpl-2.0", 36, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", 34, "you can obtain one at https? mozilla org mpl"),
    ("epl", 34, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", 35, "free and unencumbered software released into the public domain"),
    ("unlicense", 34, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", 35, "altered source versions must be plainly marked as such"),
    ("zlib", 34, "the origin of this software must not be misrepresented"),
    ("bsl-1.0", 35, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("cc0-1.0", 35, "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 36, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 35, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", 36, "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 37, "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", 37, "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", 37, "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", 38, "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 38, "creativecommons org licenses by nc nd [1-4] [05]"),
    ("wtfpl", 35, "you just do what the fuck you want to"),
    ("artistic", 34, "you may make and give away verbatim copies of the source form"),
    ("ofl-1.1", 35, "this font software is licensed under the sil open font license"),
    ("ofl-1.1", 34, "fonts are allowed to remain under this license"),
    ("postgresql", 35, "in no event shall the university of california be liable to any party"),
    ("ncsa", 35, "to deal with the software without restriction"),
    ("openssl", 35, "this product includes software developed by the openssl project"),
    ("json", 35, "the software shall be used for good not evil"),
    ("beerware", 35, "you can buy me a beer in return"),
    ("sspl-1.0", 35, "making the functionality of the program available to third parties as a service"),
    ("busl-1.1", 35, "effective on the change date"),
    ("proprietary", 10, "all rights reserved"),
    ("proprietary", 10, "proprietary and confidential"),
    ("proprietary", 12, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 11, "may not be reproduced without (?:the )?(?:prior )?written permission"),
    # versioned names by themselves: the commonest citations of all
    ("apache-2.0", 25, "apache(?: software)? licen[cs]e (?:version |v)?2(?: 0)?"),
    ("apache-2.0", 25, "apache 2 0"),
    ("apache-2.0", 25, "asl 2 0"),
    ("apache-1.1", 25, "apache(?: software)? licen[cs]e (?:version |v)?1 1"),
    ("apache-1.0", 25, "apache(?: software)? licen[cs]e (?:version |v)?1 0"),
    ("gpl-3.0", 25, "(?:gnu )?general public licen[cs]e(?: gpl)? (?:version |v)?3(?: 0)?"),
    ("gpl-3.0", 25, "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", 25, "(?:gnu )?general public licen[cs]e(?: gpl)? (?:version |v)?2(?: 0)?"),
    ("gpl-2.0", 25, "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-1.0", 25, "(?:gnu )?general public licen[cs]e(?: gpl)? (?:version |v)?1(?: 0)?"),
    ("lgpl-3.0", 25, "(?:gnu )?lesser general public licen[cs]e(?: lgpl)? (?:version |v)?3(?: 0)?"),
    ("lgpl-3.0", 25, "(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", 25, "(?:gnu )?lesser general public licen[cs]e(?: lgpl)? (?:version |v)?2 1"),
    ("lgpl-2.1", 25, "(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("lgpl-2.0", 25, "(?:gnu )?library general public licen[cs]e(?: lgpl)? (?:version |v)?2(?: 0)?"),
    ("agpl-3.0", 25, "(?:gnu )?affero general public licen[cs]e(?: agpl)? (?:version |v)?3(?: 0)?"),
    ("agpl-3.0", 25, "(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("gfdl-1.3", 25, "(?:gnu )?free documentation licen[cs]e(?: gfdl)? (?:version |v)?1 3"),
    ("gfdl-1.2", 25, "(?:gnu )?free documentation licen[cs]e(?: gfdl)? (?:version |v)?1 2"),
    ("mpl-2.0", 25, "mozilla public licen[cs]e(?: mpl)? (?:version |v)?2(?: 0)?"),
    ("mpl-2.0", 25, "mpl ?(?:version |v)?2 0"),
    ("mpl-1.1", 25, "mozilla public licen[cs]e(?: mpl)? (?:version |v)?1 1"),
    ("epl-2.0", 25, "eclipse public licen[cs]e(?: epl)? (?:version |v)?2(?: 0)?"),
    ("epl-1.0", 25, "eclipse public licen[cs]e(?: epl)? (?:version |v)?1(?: 0)?"),
    ("cpl-1.0", 25, "common public licen[cs]e(?: cpl)? (?:version |v)?1 0"),
    ("ipl-1.0", 25, "ibm public licen[cs]e (?:version |v)?1 0"),
    ("eupl-1.2", 25, "european union public licen[cs]e(?: eupl)? (?:version |v)?1 2"),
    ("eupl-1.1", 25, "european union public licen[cs]e(?: eupl)? (?:version |v)?1 1"),
    ("osl-3.0", 25, "open software licen[cs]e(?: osl)? (?:version |v)?3 0"),
    ("bsl-1.0", 25, "boost software licen[cs]e (?:version |v)?1 0"),
    ("cddl-1.1", 25, "common development and distribution licen[cs]e(?: cddl)? (?:version |v)?1 1"),
    ("cddl-1.0", 25, "common development and distribution licen[cs]e(?: cddl)? (?:version |v)?1 0"),
    ("zpl-2.1", 25, "zope public licen[cs]e(?: zpl)? (?:version |v)?2 1"),
    ("lppl-1.3c", 25, "latex project public licen[cs]e(?: lppl)?(?: (?:version |v)?1 3c)?"),
    ("ecl-2.0", 25, "educational community licen[cs]e (?:version |v)?2 0"),
    ("upl-1.0", 25, "universal permissive licen[cs]e(?: upl)?(?: (?:version |v)?1 0)?"),
    ("cecill-2.1", 25, "cecill(?: free software licen[cs]e agreement)? (?:version |v)?2 1"),
    ("mulan-psl-2.0", 25, "mulan permissive software licen[cs]e (?:version |v)?2"),
    ("blueoak-1.0.0", 25, "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("odc-by-1.0", 25, "open data commons attribution licen[cs]e(?: (?:version |v)?1 0)?"),
    ("pddl-1.0", 25, "(?:open data commons )?public domain dedication and licen[cs]e"),
    ("cdla-permissive-2.0", 25, "community data licen[cs]e agreement permissive(?: (?:version |v)?2 0)?"),
    ("openrail", 25, "(?:creativeml )?open rail ?m licen[cs]e"),
    # names, titles and sentences of the creative commons
    ("cc-by", 15, "cc by [1-4] [05]"),
    ("cc-by-sa", 15, "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", 15, "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", 15, "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", 15, "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", 15, "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", 26, "creative commons attribution [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-sa", 27, "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", 27, "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nd", 27, "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-sa", 28, "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-nd", 28, "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc0-1.0", 27, "cc0 1 0 universal"),
    ("cc0-1.0", 34, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("creative-commons", 24, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("creative-commons", 24, "you must distribute your contributions under the same license as the original"),
    ("creative-commons", 24, "you may not use the material for commercial purposes"),
    ("creative-commons", 24, "you may not distribute the modified material"),
    # clauses of the mit, isc and bsd families
    ("mit-0", 36, "mit no attribution"),
    ("mit", 32, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("hpnd", 35, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", 33, "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("isc", 33, "in no event shall (?:isc|the author) be liable for any special direct indirect or consequential damages"),
    ("0bsd", 36, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", 33, "this software is provided by the (?:copyright holders|regents|author) and contributors as is"),
    ("bsd", 32, "procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-3-clause-clear", 36, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", 36, "subject to the terms and conditions of this license each copyright holder and contributor hereby grants"),
    ("zlib", 33, "this notice may not be removed or altered from any source distribution"),
    ("libpng", 36, "the png reference library is supplied as is"),
    ("curl", 35, "the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("icu", 35, "icu license icu 1 8 1 and later"),
    ("unicode-dfs-2016", 35, "unicode data files and any associated documentation"),
    ("vim", 35, "is charityware you can use and copy it as much as you like"),
    ("fair", 35, "usage of the works is permitted provided that this instrument is retained with the works"),
    ("sleepycat", 35, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ijg", 35, "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 35, "portions of this software are copyright .{1,40}? the freetype project"),
    ("psf-2.0", 35, "psf is making python available to licensee on an as is basis"),
    ("tcl", 35, "the authors hereby grant permission to use copy modify distribute and license this software"),
    ("w3c", 35, "by obtaining using and or copying this work you the licensee agree"),
    ("naist-2003", 35, "nara institute of science and technology"),
    ("upl-1.0", 35, "larger work to which the software is contributed by such licensors"),
    ("afl-3.0", 35, "licensed under the academic free license version 3 0"),
    ("osl-3.0", 35, "licensed under the open software license version 3 0"),
    # clauses of licenses with conditions on derived works
    ("apache-2.0", 33, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 33, "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", 35, "this product includes software developed by the apache software foundation"),
    ("gpl", 23, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", 27, "when we speak of free software we are referring to freedom not price our general public licenses"),
    ("gpl-2.0", 36, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", 37, "gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", 35, "protecting users legal rights from anti circumvention law"),
    ("lgpl-2.1", 37, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", 37, "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", 38, "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", 35, "remote network interaction use with the gnu general public license"),
    ("gpl-classpath", 38, "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gfdl", 35, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", 35, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 35, "if a copy of the mpl was not distributed with this file"),
    ("cddl-1.0", 35, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-2.0", 36, "eclipse org legal epl 2 0"),
    ("epl-1.0", 36, "eclipse org legal epl v10 html"),
    ("eupl", 35, "you may not use this work except in compliance with the licence"),
    ("artistic-2.0", 35, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes"),
    ("artistic-1.0", 35, "the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl-1.1", 33, "the font software may be sold as part of a larger software package"),
    ("ofl-1.1", 36, "scripts sil org ofl"),
    ("odbl-1.0", 35, "this (?:database|data) is made available under the open database license"),
    ("odbl-1.0", 36, "opendatacommons org licenses odbl"),
    ("sspl-1.0", 36, "mongodb com licensing server side public license"),
    ("busl-1.1", 34, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2.0", 35, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 35, "the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial-1.0.0", 35, "polyform noncommercial license"),
    ("hippocratic-2.1", 35, "hippocratic license"),
    ("llama", 35, "llama (?:2|3|3 1|3 2|3 3) community license"),
    ("public-domain", 34, "the author hereby disclaims copyright to this source code"),
    ("public-domain", 33, "this (?:work|file|software) (?:is|has been) (?:in|released into|placed in) the public domain"),
    # statements of rights kept
    ("proprietary", 12, "this software is the confidential and proprietary information of"),
    ("proprietary", 12, "no part of this (?:publication|document|book|work) may be reproduced"),
    ("proprietary", 12, "no license express or implied is granted"),
    ("proprietary", 12, "you may not reverse engineer decompile or disassemble"),
    ("proprietary", 11, "this software is licensed not sold"),
    ("proprietary", 11, "trade secrets? and confidential information"),
    ("mit", 5, "mit license"),
    ("apache", 5, "apache license"),
    ("gpl", 5, "general public license"),
)


def keyword(pattern: str) -> bytes:
    """The longest word that every match of a rule holds: what is left without optional parts, choices and classes."""
    plain = re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\]\??|\.\{[^}]*\}\??|.\?", " ", pattern)
    return max(plain.replace("(", " ").replace(")", " ").split(), key=len).encode()


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    #: No match is longer.
    longest: int


def rules() -> list[Rule]:
    """All rules, by falling priority and then in the order of the tables."""
    made = [
        (label, priority, phrase.format(f"(?:{name})"), keyword(name))
        for label, names in FAMILIES
        for name in names
        for priority, phrase in PHRASINGS
    ]
    made += [(label, p, x, keyword(x)) for label, p, x in SINGLE]
    found = [Rule(label, p, k, re.compile(f"(?<![^ ]){x}(?![^ ])".encode()), len(x) + 64) for label, p, x, k in made]
    return sorted(found, key=lambda r: -r.priority)


def places(text: bytes, word: bytes) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.keywords: dict[bytes, list[tuple[int, Rule]]] = {}
        for k, r in enumerate(self.rules):
            self.keywords.setdefault(r.keyword, []).append((k, r))
        self.base = [(f" {phrase} ".encode(), len(phrase.split()), label) for phrase, label in BASE]

    def matches(self, joined: bytes) -> list[tuple[int, int, int, int, str]]:
        """(start, end, priority, rule, label) of every rule's matches, found around its keyword."""
        found = []
        for key, group in self.keywords.items():
            if key not in joined:
                continue
            reach = max(r.longest for _, r in group)
            windows: list[list[int]] = []
            for at in places(joined, key):
                lo, hi = max(0, at - reach), min(len(joined), at + reach)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for k, r in group:
                for lo, hi in windows:
                    # what ends with the window was cut off, and is no match around the keyword
                    found += [
                        (m.start(), m.end(), r.priority, k, r.label)
                        for m in r.pattern.finditer(joined, lo, hi)
                        if m.end() < hi or hi == len(joined)
                    ]
        return found

    def detections(self, joined: bytes) -> list[tuple[int, int, int, str]]:
        """(start, end, priority, label) of what stays, in order of place."""
        found = sorted(self.matches(joined), key=lambda x: (-x[2], x[0], -x[1], x[3]))
        kept: list[tuple[int, int, int, int, str]] = []
        for _, own in groupby(found, key=lambda x: x[2]):
            held: list[list[int]] = []  # the kept intervals so far, joined where they overlap
            for a, b, *_ in sorted(kept):
                if held and a < held[-1][1]:
                    held[-1][1] = max(held[-1][1], b)
                else:
                    held.append([a, b])
            starts, ends = [x[0] for x in held], [x[1] for x in held]
            reach, new = -1, []
            for x in own:
                k = bisect_right(ends, x[0])  # the first that ends after x starts
                if k < len(held) and starts[k] < x[1]:
                    continue
                if x[1] > reach:
                    new.append(x)
                    reach = x[1]
            kept += new
        return [(a, b, p, label) for a, b, p, _, label in sorted(kept)]

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text) if text else []
        out = {"n_words": len(words), "base": [], "spans": []}
        joined = b" " + b" ".join(words) + b" "
        found = [(at, n, label) for phrase, n, label in self.base for at in places(joined, phrase)]
        spans = self.detections(joined)
        if found or spans:
            # the word that starts after a space
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            for (_, n, label), k in zip(found, np.searchsorted(spaces, [x[0] for x in found]).tolist(), strict=True):
                out["base"].append((k, k + n, label))
            first = np.searchsorted(spaces, [x[0] for x in spans]) - 1
            last = np.searchsorted(spaces, [x[1] for x in spans])
            for (_, _, p, label), k, n in zip(spans, first.tolist(), last.tolist(), strict=True):
                out["spans"].append((k, n, p, label))
        return out


SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("priority", T.IntegerType()),
            T.StructField("label", T.StringType()),
        ]
    )
)
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("base", SPAN), T.StructField("spans", SPAN)])
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32()), ("label", pa.string())]))


def scanner():
    """A column function: the words, base places and kept detections of a text."""
    made: list[Scanner] = []

    def spans(rows: list) -> Iterator[list[dict]]:
        for row in rows:
            yield [{"start": x[0], "end": x[1], "priority": x[2] if len(x) > 3 else 0, "label": x[-1]} for x in row]

    def work(texts: list[str | None]) -> pa.Array:
        if not made:
            made.append(Scanner())
        found = [made[0].scan(t) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([x["n_words"] for x in found], pa.int64()),
                pa.array(list(spans([x["base"] for x in found])), ARROW_SPAN),
                pa.array(list(spans([x["spans"] for x in found])), ARROW_SPAN),
            ],
            ["n_words", "base", "spans"],
        )

    return text_function(FOUND, work)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every document.

    Null counts as empty: no words, no places, empty label lists and score 0. The score is 1 - 0.5 ** (evidence / 20),
    where evidence adds up the kept detections' priorities. Map-only.
    """
    r = docs.select("doc_id", scanner()(F.col("text")).alias("r")).select("doc_id", "r.*")
    starts = F.transform("base", lambda x: x["start"])
    own = F.transform("base", lambda x: x["label"])
    other = F.transform("spans", lambda x: x["label"])
    evidence = F.aggregate("spans", F.lit(0.0), lambda acc, x: acc + x["priority"])
    return r.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, other))), ",").alias("labels"),
        (1.0 - F.pow(F.lit(0.5), evidence / 20.0)).alias("score"),
        "spans",
    )
