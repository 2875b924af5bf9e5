"""Signature rules for licences, in the order in which they count.

A rule is written as words: ``a|b`` is either word, ``word?`` may be missing, ``\\d+`` and the like match within a word. Texts
are compared as lower-case words, so that marks, line breaks and spacing don't matter. Each rule has a keyword that a
text must hold before the rule is tried.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Phrases and their labels, of which all places count.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licences by their usual names. Label; names; identifiers, as words.
FAMILIES = (
    ("mit", ("mit", "expat"), ("mit",)),
    ("mit-0", ("mit no attribution",), ("mit 0",)),
    ("apache-1.1", ("apache software? license version? 1 1",), ("apache 1 1",)),
    ("apache-2.0", ("apache software? license version|v|v2? 2? 0?",), ("apache 2 0", "asl 2 0")),
    ("bsd-2-clause", ("simplified bsd", "freebsd", "two|2 clause bsd", "bsd two|2 clause"), ("bsd 2 clause",)),
    ("bsd-3-clause", ("modified bsd", "new|revised bsd", "three|3 clause bsd", "bsd three|3 clause"), ("bsd 3 clause",)),
    ("bsd-4-clause", ("original bsd", "four|4 clause bsd", "bsd four|4 clause"), ("bsd 4 clause",)),
    ("0bsd", ("zero clause bsd", "bsd zero clause"), ("0bsd",)),
    ("isc", ("isc", "internet systems consortium"), ("isc",)),
    ("gpl-2.0", ("gnu? general public license version|v? 2|v2 0?", "gnu? gpl version|v? 2|v2", "gplv2"), ("gpl 2 0 only|or? later?",)),
    ("gpl-3.0", ("gnu? general public license version|v? 3|v3 0?", "gnu? gpl version|v? 3|v3", "gplv3"), ("gpl 3 0 only|or? later?",)),
    ("lgpl-2.1", ("gnu? lesser|library general public license version|v? 2|v2 1?", "gnu? lgpl version|v? 2|v2 1?", "lgplv2"), ("lgpl 2 1 only|or? later?",)),
    ("lgpl-3.0", ("gnu? lesser general public license version|v? 3|v3", "gnu? lgpl version|v? 3|v3", "lgplv3"), ("lgpl 3 0 only|or? later?",)),
    ("agpl-3.0", ("gnu? affero general public license version|v? 3?|v3?", "gnu? agpl version|v? 3|v3", "agplv3"), ("agpl 3 0 only|or? later?",)),
    ("mpl-1.1", ("mozilla public license version? 1 1",), ("mpl 1 1",)),
    ("mpl-2.0", ("mozilla public license version|v? 2? 0?",), ("mpl 2 0",)),
    ("epl-1.0", ("eclipse public license version|v? 1 0",), ("epl 1 0",)),
    ("epl-2.0", ("eclipse public license version|v? 2 0",), ("epl 2 0",)),
    ("cddl-1.0", ("common development and distribution license version? 1? 0?",), ("cddl 1 0",)),
    ("cpl-1.0", ("common public license version? 1? 0?",), ("cpl 1 0",)),
    ("eupl-1.2", ("european union public licence|license version|v? 1? 2?",), ("eupl 1 2",)),
    ("artistic-2.0", ("artistic license version? 2? 0?",), ("artistic 2 0",)),
    ("bsl-1.0", ("boost software license version? 1? 0?",), ("bsl 1 0",)),
    ("busl-1.1", ("business source license version? 1? 1?",), ("busl 1 1",)),
    ("sspl-1.0", ("server side public license version|v? 1?",), ("sspl 1 0",)),
    ("elastic-2.0", ("elastic license version|v? 2? 0?",), ("elastic 2 0",)),
    ("zlib", ("zlib libpng?", "zlib"), ("zlib",)),
    ("unlicense", ("the unlicense", "unlicense"), ("unlicense",)),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("wtfpl",)),
    ("python-2.0", ("python software foundation license version? 2?", "psf license"), ("psf 2 0", "python 2 0")),
    ("postgresql", ("postgresql license|licence",), ("postgresql",)),
    ("openssl", ("openssl license",), ("openssl",)),
    ("ofl-1.1", ("sil open font license version? 1? 1?", "open font license"), ("ofl 1 1",)),
    ("ms-pl", ("microsoft public license",), ("ms pl",)),
    ("ms-rl", ("microsoft reciprocal license",), ("ms rl",)),
    ("odbl-1.0", ("open data commons open database license", "open database license version|v? 1? 0?"), ("odbl 1 0",)),
    ("gfdl-1.3", ("gnu? free documentation license version? 1? 2|3?",), ("gfdl 1 3 only|or? later?",)),
    ("cc0-1.0", ("cc0 1? 0? universal?", "creative commons zero", "creative commons cc0"), ("cc0 1 0",)),
    ("openrail-m", ("creativeml open rail m", "bigscience open? rail m", "open responsible ai licen[cs]e|licen[cs]es"), ("openrail",)),
    ("llama", ("llama 2|3 community license",), ("llama2|llama3",)),
)

#: The parts of the Creative Commons licences and their versions.
CREATIVE_COMMONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CREATIVE_COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CREATIVE_COMMONS_WORDS = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives|noderivs", "nc": "noncommercial"}

#: Signatures that aren't a licence's name. Label; keyword; words; weight.
OTHERS = (
    ("all-rights-reserved", "reserved", "all rights reserved", 0.8),
    ("all-rights-reserved", "reserved", "alle rechte vorbehalten", 0.8),
    ("public-domain", "domain", "released|dedicated|placed in|into|to the public domain", 0.9),
    ("public-domain", "domain", "is in the public domain", 0.8),
    ("public-domain", "domain", "public domain", 0.4),
    ("copyright", "copyright", "copyright c? (?:19|20)\\d\\d", 0.5),
    ("copyright", "copyright", "copyright holder|holders", 0.3),
    ("warranty-disclaimer", "warrant", "without warranty of any kind", 0.6),
    ("warranty-disclaimer", "warrant", "without warranties or conditions of any kind", 0.6),
    ("warranty-disclaimer", "warrant", "provided as is without warranty", 0.7),
    ("permission-notice", "permission", "permission is hereby granted free of charge", 0.8),
    ("permission-notice", "permission", "permission to use copy modify and or? distribute", 0.8),
    ("redistribution-notice", "redistribut", "redistribution and use in source and binary forms", 0.9),
    ("proprietary", "proprietary", "proprietary and confidential", 0.7),
    ("proprietary", "unauthori", "unauthori[sz]ed copying of this file", 0.8),
    ("non-commercial", "commercial", "for non commercial|noncommercial use only", 0.6),
    ("non-commercial", "commercial", "not for commercial use", 0.5),
    ("unknown-licence", "licen", "licen[cs]ed under the? terms of", 0.4),
    ("unknown-licence", "licen", "licen[cs]ed under", 0.2),
    ("unknown-licence", "licen", "see the? licen[cs]e file", 0.3),
)


#: Sentences and parts of sentences of licence texts, notices and headers, as they stand there. Label; words; weight.
WRITTEN = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("x11", "except as contained in this notice the name|names s? of the|a above? x|copyright consortium|holder|holders shall not be used in advertising", 0.9),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("0bsd", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2.0", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", 0.9),
    ("apache-2.0", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce", 0.9),
    ("apache-2.0", "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor", 0.9),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.8),
    ("bsd-clauses", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-clauses", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment this product includes software developed by", 0.9),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either? version 2", 1.0),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either? version 3", 1.0),
    ("lgpl-2.1", "under the terms of the gnu lesser|library general public license as published by the free software foundation either? version 2 1?", 1.0),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either? version 3", 1.0),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either? version 3", 1.0),
    ("gpl-notice", "you should have received a copy of the gnu lesser|library|affero? general public license along with this program|library", 0.9),
    ("gpl-notice", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", 0.8),
    ("gpl-notice", "this is free software and you are welcome to redistribute it under certain conditions", 0.8),
    ("gpl-notice", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works", 0.9),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it", 0.8),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations", 0.9),
    ("epl-2.0", "made available under the terms of the eclipse public license v? 2 0 which is available at", 1.0),
    ("epl-1.0", "made available under the terms of the eclipse public license v1|v? 1? 0? which accompanies this distribution", 1.0),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", 1.0),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", 0.9),
    ("gpl-notice", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.9),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights", 0.9),
    ("creative-commons", "this work is licensed under a creative commons", 0.6),
    ("creative-commons", "creative commons is not a law firm and does not provide legal services", 0.8),
    ("creative-commons", "by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons", 0.9),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit all rights reserved", 0.9),
    ("python-2.0", "this license agreement is between the python software foundation psf and the individual or organization", 1.0),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied", 1.0),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2|3", 1.0),
    ("odbl-1.0", "made available under the open database license", 1.0),
    ("eupl-1.2", "licensed under the eupl version? 1? 2? or as soon they will be approved by the european commission", 1.0),
    ("elastic-2.0", "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable license to use copy distribute make available and prepare derivative works of the software", 1.0),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available via network download to everyone at no charge under the terms of this license", 1.0),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("openrail-m", "the licensee may not use the model or the derivatives of the model for the specified restricted uses", 0.9),
    ("llama", "you are granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property", 0.9),
    ("json", "the software shall be used for good not evil the software is provided as is without warranty of any kind", 1.0),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software", 0.9),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied", 0.7),
    ("warranty-disclaimer", "the implied warranties of merchantability and fitness for a particular purpose", 0.6),
    ("warranty-disclaimer", "there is no warranty for the program to the extent permitted by applicable law", 0.7),
    ("liability-disclaimer", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.7),
    ("liability-disclaimer", "in no event shall the copyright owner|holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", 0.7),
    ("proprietary", "this document contains proprietary and? confidential? information", 0.7),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form without the prior written permission", 0.9),
    ("proprietary", "no part of this publication|book|work may be reproduced in any form without permission", 0.8),
    ("proprietary", "licensed not sold", 0.6),
    ("terms-of-use", "for personal and? non? commercial use only", 0.6),
    ("terms-of-use", "free for personal use contact for commercial", 0.6),
    ("public-domain", "the author|authors has|have dedicated the work to the public domain", 0.9),
    ("public-domain", "no known copyright restrictions", 0.7),
    ("public-domain", "a work of the united states government and is not subject to copyright protection", 0.9),
)


#: Parts of words by which a name speaks of a licence itself.
_SPEAKING = ("licen", "spdx", "creative", "gplv", "wtfpl", "openrail", "reserved", "vorbehalten", "domain", "copyright", "warrant", "permission", "redistribut", "proprietary", "unauthori", "commercial")
#: Names that are unambiguous without the word licence: by their version, parts or clauses. A bare "CC BY" or "new BSD" isn't.
_PLAIN = re.compile(r"^cc by \w|^cc0|gpl version|clause|no attribution|rail m$")
#: Substrings of which each rule needs one; a text without any isn't looked at further.
ROOTS = (*_SPEAKING, "gpl", "cc", "bsd", "attribution", "bigscience", "apache", "openssl", "advertis")
#: What rules that have no other root than this one need of a lower-case text.
NARROWED = {"cc": r"cc(?:0|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by)"}
_COMMON = {"license", "public", "version", "general", "software", "open"}


class Rule(NamedTuple):
    number: int
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool


def pattern(words: str) -> str:
    """A regular expression over texts in which every word has a space before and one after it."""
    out = []
    for token in words.split():
        optional = token.endswith("?")
        token = token[:-1] if optional else token
        one = f" (?:{token}) " if "|" in token else f" {token} "
        out.append(f"(?:{one})?" if optional else one)
    return "".join(out)


def _needed(words: str) -> list[str]:
    return [t for t in words.split() if re.fullmatch(r"[a-z0-9]+", t)]


def _keyword(words: str) -> str:
    """The most telling word that a rule can't do without, with the spaces around it."""
    return f" {max(_needed(words), key=lambda t: (t not in _COMMON, len(t)))} "


def _mentioned(name: str) -> bool:
    """Whether a name by itself, without the word licence, tells the licence."""
    tokens = [t.split("|") for t in name.split() if not t.endswith("?")]
    return bool(_PLAIN.search(name)) or any(all(any(root in t for root in _SPEAKING) for t in token) for token in tokens)


def families() -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """All licences, with the Creative Commons ones."""
    found = [*FAMILIES]
    for parts in CREATIVE_COMMONS:
        label = "cc-" + parts.replace(" ", "-")
        names = " ".join(CREATIVE_COMMONS_WORDS[p] for p in parts.split())
        for version in CREATIVE_COMMONS_VERSIONS:
            found.append((f"{label}-{version.replace(' ', '.')}", (f"cc {parts} {version}", f"creative commons {names} {version}", f"creativecommons org licenses {parts} {version}"), (f"cc {parts} {version}",)))
        found.append((label, (f"cc {parts}", f"creative commons {names}"), ()))
    return found


def rules() -> list[Rule]:
    """All rules: phrases with their base labels, identifiers, notices, titles and mentions of each licence, others, and written sentences."""
    found: list[tuple[str, str, str, int, float, bool]] = []
    for words, label in BASE:
        found.append((label, _keyword(words), words, 1, 0.7, True))
    for label, _, ids in families():
        for words in ids:
            found.append((label, " spdx ", f"spdx license identifier {words}", 5, 1.0, False))
    creative = {"cc-" + parts.replace(" ", "-") + version for parts in CREATIVE_COMMONS for version in ("", *("-" + v.replace(" ", ".") for v in CREATIVE_COMMONS_VERSIONS))}
    for label, names, _ in families():
        for name in names:
            found.append((label, _keyword(name), f"licen[cs]ed under the|a|an? terms? of? the? {name} licen[cs]e?", 4, 1.0, False))
            if label in creative:
                continue  # their names with a version or parts tell enough by themselves
            # without the word licensed, a name that doesn't speak of a licence itself needs the word after it
            end = "licen[cs]e?" if _mentioned(name) else "licen[cs]e"
            found.append((label, _keyword(name), f"released|distributed|available|published|provided|made under the|a|an? terms? of? the? {name} {end}", 4, 1.0, False))
    for label, names, _ in families():
        for name in names:
            if not re.search(r"licen|public", name):
                found.append((label, _keyword(name), f"{name} licen[cs]e", 3, 0.9, False))
            if _mentioned(name):
                found.append((label, _keyword(name), name, 2, 0.6, False))
    for label, keyword, words, weight in OTHERS:
        found.append((label, keyword, words, 1 if weight < 0.5 else 2, weight, False))
    for label, words, weight in WRITTEN:
        found.append((label, _keyword(words), words, 4 if weight >= 0.9 else 2, weight, False))
    return [Rule(n, label, keyword, pattern(words), priority, weight, base) for n, (label, keyword, words, priority, weight, base) in enumerate(found)]
