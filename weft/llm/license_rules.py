"""Signature rules of licences: notices, addresses and abbreviations written out
one by one, and families of names in the forms in which texts use them.

All rules are regular expressions over lower-case text; a blank stands for any
white space.  Each has a keyword: a single word, or part of one, that every match
contains.  A family is (label, keyword, name, SPDX id, whether the name stands
for itself, without the word licence); each form makes one rule of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The gate of most rules; families whose names can do without it, by label (those
#: of short names can, too).
COMMON = "licen"
BARE = ("mit-0", "0bsd", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "unicode", "hpnd", "cc0", "commons-clause", "openrail", "proprietary")
VERSION = r"(?:,? (?:version|v\.?|ver\.?))? ?"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int  # the lower, the stronger
    confidence: float
    gate: str  # what every match contains, as the keyword, but shared by many rules


def _blanks(pattern: str) -> str:
    """Blanks stand for any white space: one character in a class, else a run."""
    pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", r"\s"), pattern)
    return pattern.replace(" ?", r"\s*").replace(" ", r"\s+")


#: Sentences of licences and notices: (label, keyword, pattern).
NOTICES = [
    ("mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "substantial", r"this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsl-1.0", "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("postgresql", "agreement", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("hpnd", "supporting", r"that copyright notice and this permission notice appear in supporting documentation"),
    ("x11", "consortium", r"except as contained in this notice, the name of the x consortium"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "contributors", r"nor the names of (?:its|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed", r"software distributed under the license is distributed on an"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", r"this program is free software[:;] you can redistribute it and/or modify it"),
    ("lgpl", "redistribute", r"this library is free software[:;] you can redistribute it and/or modify it"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license"),
    ("gpl-2.0", "option", r"version 2 of the license, or \(at your option\) any later version"),
    ("gpl-3.0", "option", r"version 3 of the license, or \(at your option\) any later version"),
    ("lgpl-2.1", "option", r"version 2\.1 of the license, or \(at your option\) any later version"),
    ("gfdl", "invariant", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl-2.0", "source", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public license"),
    ("mpl", "multi-licensed", r"multi-licensed under the mpl"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("beerware", "beer", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("cc0", "neighbo", r"waived all copyright and related or neighbou?ring rights"),
    ("cc", "creative", r"this (?:work|article|book|page|dataset) is licensed under (?:a|the) creative commons"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("python", "psf", r"psf is making python available to licensee on an"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("busl", "non-production", r"redistribute, and make non-production use of the licensed work"),
    ("sspl", "functionality", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the license does not grant to you, the right to sell the software"),
    ("openrail", "restrictions", r"use-based restrictions as referenced in paragraph"),
    ("llama", "llama", r"llama [0-9](?:\.[0-9])? community license"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|donated|put) (?:in ?to|in|to) the public domain"),
    ("public-domain", "domain", r"(?:is|are|was|were) (?:hereby )?in the public domain"),
    ("public-domain", "domain", r"public domain mark"),
    ("public-domain", "copyright", r"no (?:known )?copyright restrictions"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|software|work)"),
    ("proprietary", "reproduced", r"may not be reproduced(?:,|(?: or)? (?:distributed|transmitted)) [a-z, ]*without (?:the )?(?:prior )?written (?:permission|consent)"),
    ("proprietary", "trade", r"contains trade secrets"),
    ("proprietary", "internal", r"for internal use only"),
]
#: Addresses of licence texts: (label, keyword, pattern).
ADDRESSES = [
    ("boost", "boost", r"boost\.org/license_1_0\.txt"),
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache.org", r"apache\.org/licenses/license-1\.1"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl"),
    ("gpl-1.0", "gnu.org", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)"),
    ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl", "gnu.org", r"gnu\.org/licenses/agpl"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("mpl-1.1", "mozilla.org", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("eupl", "eupl", r"joinup\.ec\.europa\.eu/[a-z0-9/_-]*eupl"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl\.net"),
    ("ofl", "sil.org", r"scripts\.sil\.org/ofl"),
    ("cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark"),
    ("odbl", "opendatacommons.org", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons.org", r"opendatacommons\.org/licenses/by"),
    ("pddl", "opendatacommons.org", r"opendatacommons\.org/licenses/pddl"),
    ("polyform", "polyformproject.org", r"polyformproject\.org/licenses"),
    ("mit", "opensource.org", r"opensource\.org/licen[cs]es?/mit"),
    ("isc", "opensource.org", r"opensource\.org/licen[cs]es?/isc"),
    ("bsd-2-clause", "opensource.org", r"opensource\.org/licen[cs]es?/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org", r"opensource\.org/licen[cs]es?/bsd-3-clause"),
    ("apache-2.0", "opensource.org", r"opensource\.org/licen[cs]es?/apache-2\.0"),
    ("gpl-2.0", "opensource.org", r"opensource\.org/licen[cs]es?/gpl-2\.0"),
    ("gpl-3.0", "opensource.org", r"opensource\.org/licen[cs]es?/gpl-3\.0"),
    ("artistic-2.0", "opensource.org", r"opensource\.org/licen[cs]es?/artistic-2\.0"),
]


def _families() -> list[tuple[str, str, str, str, bool]]:
    short = [
        ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?:,? version |[- ]?(?:v\.? ?)?)1(?:\.0)?(?!\.?[0-9])", "gpl-1.0"),
        ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?:,? version |[- ]?(?:v\.? ?)?)2(?:\.0)?(?:\+|[- ]or[- ]later|[- ]only)?(?!\.?[0-9])", "gpl-2.0"),
        ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?:,? version |[- ]?(?:v\.? ?)?)3(?:\.0)?(?:\+|[- ]or[- ]later|[- ]only)?(?!\.?[0-9])", "gpl-3.0"),
        ("gpl", "gpl", r"(?:gnu )?gpl\b", "gpl"),
        ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?:,? version |[- ]?(?:v\.? ?)?)2(?:\.0)?(?:\+|[- ]or[- ]later|[- ]only)?(?!\.?[0-9])", "lgpl-2.0"),
        ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?:,? version |[- ]?(?:v\.? ?)?)2\.1(?:\+|[- ]or[- ]later|[- ]only)?(?!\.?[0-9])", "lgpl-2.1"),
        ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?:,? version |[- ]?(?:v\.? ?)?)3(?:\.0)?(?:\+|[- ]or[- ]later|[- ]only)?(?!\.?[0-9])", "lgpl-3.0"),
        ("lgpl", "lgpl", r"(?:gnu )?lgpl\b", "lgpl"),
        ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?:,? version |[- ]?(?:v\.? ?)?)3(?:\.0)?(?:\+|[- ]or[- ]later|[- ]only)?(?!\.?[0-9])", "agpl-3.0"),
        ("agpl", "agpl", r"(?:gnu )?agpl\b", "agpl"),
        ("gfdl", "gfdl", r"(?:gnu )?gfdl\b", "gfdl"),
        ("apache-2.0", "apache", r"apache(?:[- ]licen[cs]e)?(?:,? version |[- ](?:v\.? ?)?)2(?:\.0)?(?: licen[cs]e)?(?!\.?[0-9])", "apache-2.0"),
        ("apache-2.0", "asl", r"asl(?: ?|-)(?:v\.? ?)?2(?:\.0)?(?!\.?[0-9])", "apache-2.0"),
        ("mpl-1.1", "mpl", r"mpl[- ]?(?:v\.? ?)?1\.1(?!\.?[0-9])", "mpl-1.1"),
        ("mpl-2.0", "mpl", r"mpl[- ]?(?:v\.? ?)?2(?:\.0)?(?!\.?[0-9])", "mpl-2.0"),
        ("epl-1.0", "epl", r"epl[- ]?(?:v\.? ?)?1(?:\.0)?(?!\.?[0-9])", "epl-1.0"),
        ("epl-2.0", "epl", r"epl[- ]?(?:v\.? ?)?2(?:\.0)?(?!\.?[0-9])", "epl-2.0"),
        ("cddl-1.0", "cddl", r"cddl[- ]?(?:v\.? ?)?1(?:\.0)?(?!\.?[0-9])", "cddl-1.0"),
        ("cddl", "cddl", r"cddl\b", "cddl"),
        ("eupl-1.2", "eupl", r"eupl[- ]?(?:v\.? ?)?1\.2(?!\.?[0-9])", "eupl-1.2"),
        ("bsl-1.0", "bsl-1.0", r"bsl-1\.0", "bsl-1.0"),
        ("busl-1.1", "busl", r"busl[- ]?1\.1", "busl-1.1"),
        ("sspl", "sspl", r"sspl\b", "sspl-1.0"),
        ("ofl-1.1", "ofl", r"ofl[- ]?(?:v\.? ?)?1\.1(?!\.?[0-9])", "ofl-1.1"),
        ("wtfpl", "wtfpl", r"wtfpl\b", "wtfpl"),
    ]
    plain = [
        ("mit", "mit", r"mit(?:/x11)? license", "mit"),
        ("mit", "expat", r"expat(?:/x11)? license", "mit"),
        ("mit-0", "attribution", r"mit no attribution", "mit-0"),
        ("mit-0", "mit-0", r"mit-0", "mit-0"),
        ("x11", "x11", r"x11 license", "x11"),
        ("isc", "isc", r"isc license", "isc"),
        ("0bsd", "bsd", r"zero-clause bsd|bsd zero clause license|0bsd", "0bsd"),
        ("bsd-1-clause", "bsd", r"(?:1|one)-clause bsd|bsd[ -]1-clause", "bsd-1-clause"),
        ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|(?:2|two)-clause) bsd|bsd[ -]2-clause", "bsd-2-clause"),
        ("bsd-3-clause", "bsd", r"(?:new|modified|revised|(?:3|three)-clause) bsd|bsd[ -]3-clause", "bsd-3-clause"),
        ("bsd-4-clause", "bsd", r"(?:original|old|(?:4|four)-clause) bsd|bsd[ -]4-clause", "bsd-4-clause"),
        ("bsd", "bsd", r"bsd(?:-style)? license", "bsd"),
        ("zlib", "zlib", r"zlib license|zlib/libpng license", "zlib"),
        ("libpng", "libpng", r"libpng license", "libpng"),
        ("unlicense", "unlicense", r"the unlicense|unlicense\.org", "unlicense"),
        ("wtfpl", "fuck", r"do what the fuck you want to public license", "wtfpl"),
        ("beerware", "beer", r"beer-?ware license", "beerware"),
        ("python", "python", r"python software foundation license", "psf-2.0"),
        ("python", "psf", r"psf license", "psf-2.0"),
        ("ruby", "ruby", r"ruby license", "ruby"),
        ("postgresql", "postgresql", r"postgresql license", "postgresql"),
        ("openssl", "openssl", r"openssl license", "openssl"),
        ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? license", "ncsa"),
        ("vim", "vim", r"vim license", "vim"),
        ("curl", "curl", r"curl license", "curl"),
        ("json", "json", r"json license", "json"),
        ("icu", "icu", r"icu license", "icu"),
        ("unicode", "unicode", r"unicode(?: terms of use| license(?: agreement)?)", "unicode-3.0"),
        ("hpnd", "historical", r"historical permission notice and disclaimer", "hpnd"),
        ("ijg", "jpeg", r"independent jpeg group license", "ijg"),
        ("tcl", "tcl", r"tcl(?:/tk)? license", "tcl"),
        ("sleepycat", "sleepycat", r"sleepycat license", "sleepycat"),
        ("w3c", "w3c", r"w3c software(?: notice and)? license", "w3c"),
        ("ms-pl", "microsoft", r"microsoft public license", "ms-pl"),
        ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms-rl"),
        ("pddl", "dedication", r"(?:odc )?public domain dedication and license", "pddl-1.0"),
        ("odbl", "database", r"open database license", "odbl-1.0"),
        ("odc-by", "attribution", r"open data commons attribution license", "odc-by-1.0"),
        ("cc0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", "cc0-1.0"),
        ("commons-clause", "commons", r"commons clause(?: license condition)?", "commons-clause"),
        ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) license", "polyform"),
        ("openrail", "rail", r"(?:creativeml )?open ?rail(?:-[ms])?(?: license)?", "openrail"),
        ("proprietary", "reserved", r"all rights reserved", "proprietary"),
    ]
    versioned = [
        ("apache", "apache", r"apache (?:software )?license", ("1.0", "1.1", "2.0")),
        ("gpl", "general", r"(?:gnu )?general public license", ("1.0", "2.0", "3.0")),
        ("lgpl", "general", r"(?:gnu )?(?:lesser|library) general public license", ("2.0", "2.1", "3.0")),
        ("agpl", "affero", r"(?:gnu )?affero general public license", ("1.0", "3.0")),
        ("gfdl", "documentation", r"(?:gnu )?free documentation license", ("1.1", "1.2", "1.3")),
        ("mpl", "mozilla", r"mozilla public license", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", r"eclipse public license", ("1.0", "2.0")),
        ("cddl", "development", r"common development and distribution license", ("1.0", "1.1")),
        ("cpl", "common", r"common public license", ("1.0",)),
        ("eupl", "european", r"european union public licen[cs]e", ("1.1", "1.2")),
        ("artistic", "artistic", r"(?:perl )?artistic license", ("1.0", "2.0")),
        ("afl", "academic", r"academic free license", ("2.1", "3.0")),
        ("osl", "software", r"open software license", ("2.1", "3.0")),
        ("ecl", "community", r"educational community license", ("1.0", "2.0")),
        ("bsl", "boost", r"boost software license", ("1.0",)),
        ("busl", "business", r"business source license", ("1.1",)),
        ("ofl", "font", r"sil open font license", ("1.0", "1.1")),
        ("php", "php", r"php license", ("3.0", "3.01")),
        ("zpl", "zope", r"zope public license", ("2.0", "2.1")),
        ("qpl", "public", r"q public license", ("1.0",)),
        ("upl", "permissive", r"universal permissive license", ("1.0",)),
        ("lppl", "latex", r"latex project public license", ("1.2", "1.3c")),
        ("cecill", "cecill", r"cecill(?:-[bc])? licen[cs]e(?: agreement)?", ("2.0", "2.1")),
        ("mulanpsl", "mulan", r"mulan permissive software license", ("1.0", "2.0")),
        ("elastic", "elastic", r"elastic license", ("2.0",)),
        ("sspl", "server", r"server side public license", ("1.0",)),
    ]
    out = [(*f, True) for f in short] + [(*f, f[0] in BARE) for f in plain]
    for label, keyword, name, versions in versioned:
        for v in versions:
            exact = v[:-2] + r"(?:\.0)?" if v.endswith(".0") else v.replace(".", r"\.")
            out.append((f"{label}-{v}", keyword, rf"{name}{VERSION}{exact}\b", f"{label}-{v}", False))
        out.append((label, keyword, name, label, False))
    for terms, words in (("by", "attribution"), ("by-sa", "attribution[- ]share-?alike"), ("by-nc", "attribution[- ]non-?commercial"), ("by-nd", "attribution[- ]no-?deriv(?:ative)?s"), ("by-nc-sa", "attribution[- ]non-?commercial[- ]share-?alike"), ("by-nc-nd", "attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s")):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            exact = v.replace(".", r"\.")
            out.append((f"cc-{terms}-{v}", v, rf"(?:cc|creative commons)[ -]{terms.replace('-', '[- ]')}[ -]{exact}", f"cc-{terms}-{v}", True))
            out.append((f"cc-{terms}-{v}", "creative", rf"creative commons {words}(?: international)? {exact}(?: international| unported)?", f"cc-{terms}-{v}", True))
    return out


def rules() -> list[Rule]:
    """Ordered: tags, then notices, addresses and grants, then mere names."""
    made: dict[str, Rule] = {}
    grant = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|governed)(?: (?:under|by))(?: the)?(?: terms of(?: the)?)? "
    for label, keyword, name, spdx, bare in _families():
        gate = keyword if bare else COMMON
        tag = spdx.replace(".", r"\.").replace("+", r"\+")
        for pattern, word, priority, confidence, first in (
            (rf"spdx-license-identifier: ?{tag}(?:-only|-or-later|\+)?(?![0-9a-z.-])", "spdx", 1, 1.0, COMMON),
            (rf"\b{grant}(?:{name})", keyword, 2, 0.95, gate),
            (rf"\blicense: ?(?:{name}|{tag})(?![0-9a-z])", "license:", 3, 0.85, COMMON),
            (rf"\b(?:{name})", keyword, 4, 0.7, gate),
        ):
            made.setdefault(pattern, Rule(label, word, _blanks(pattern), priority, confidence, first))
    licences = [(f"cc-{t}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{t}/{v.replace('.', chr(92) + '.')}") for t in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2.0", "2.5", "3.0", "4.0")]
    out = [Rule(label, word, _blanks(pattern), 2, 0.9, word) for label, word, pattern in (*NOTICES, *ADDRESSES, *licences)]
    return sorted([*out, *made.values()], key=lambda r: r.priority)
