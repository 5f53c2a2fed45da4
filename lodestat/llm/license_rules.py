"""Signature rules of the licence scan.

A rule is (priority, keywords, label, pattern, score); whatever the pattern matches holds one of the keywords. Patterns are read over words: text lower-cased, everything but letters and
digits turned into single spaces. Rules are ordered; where one detection lies inside another of the same or a higher
priority it is suppressed. Names, addresses and tags of LICENSES are put in the ways that notices, tags and references have (FORMS); SENTENCES and OTHER
are signatures written out one by one.
"""

from __future__ import annotations

import re

#: label, keywords (by |) of which every text with the name holds one, pattern of the name, pattern of its address or "", SPDX tag words
LICENSES = [
    ("mit", "mit|expat", r"(?:mit|expat)", r"opensource org licenses? mit", r"mit"),
    ("mit-0", "mit", r"mit (?:no attribution|0)", r"opensource org licenses? mit 0", r"mit 0"),
    ("apache-2", "apache", r"apache(?: software)?(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"apache org licenses license 2 0", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license| licence)?(?: version| v)? ?1 1", r"apache org licenses license 1 1", r"apache 1 1"),
    ("apache", "apache", r"apache(?: software)?", r"apache org licenses", r"apache"),
    ("gpl-1", "gpl|general public", r"(?:gnu )?(?:general public|gpl)(?: license| licence)?(?: version| v)? ?1(?: 0)?", r"", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2-or-later", "gpl|general public", r"(?:gnu )?(?:general public|gpl)(?: license| licence)?(?: version| v)? ?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?", r"", r"gpl 2 0 or later"),
    ("gpl-2", "gpl|general public", r"(?:gnu )?(?:general public|gpl)(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"gnu org licenses (?:old licenses )?gpl 2 0", r"gpl 2 0(?: only)?"),
    ("gpl-3-or-later", "gpl|general public", r"(?:gnu )?(?:general public|gpl)(?: license| licence)?(?: version| v)? ?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?", r"", r"gpl 3 0 or later"),
    ("gpl-3", "gpl|general public", r"(?:gnu )?(?:general public|gpl)(?: license| licence)?(?: version| v)? ?3(?: 0)?", r"gnu org licenses gpl 3 0", r"gpl 3 0(?: only)?"),
    ("gpl", "gpl|general public", r"(?:gnu )?(?:general public|gpl)", r"gnu org (?:copyleft|licenses) gpl", r"gpl"),
    ("lgpl-2", "lgpl|general public", r"(?:gnu )?(?:library general public|lgpl)(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"gnu org licenses old licenses lgpl 2 0", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl|general public", r"(?:gnu )?(?:lesser general public|lgpl)(?: license| licence)?(?: version| v)? ?2 1", r"gnu org licenses (?:old licenses )?lgpl 2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl|general public", r"(?:gnu )?(?:lesser general public|lgpl)(?: license| licence)?(?: version| v)? ?3(?: 0)?", r"gnu org licenses lgpl 3 0", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lgpl|general public", r"(?:gnu )?(?:lesser general public|lgpl)", r"gnu org (?:copyleft|licenses) lesser", r"lgpl"),
    ("agpl-3", "agpl|affero", r"(?:gnu )?(?:affero general public|agpl)(?: license| licence)?(?: version| v)? ?3(?: 0)?", r"gnu org licenses agpl 3 0", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl|affero", r"(?:gnu )?(?:affero general public|agpl)", r"", r"agpl"),
    ("fdl", "fdl|free documentation", r"(?:gnu )?(?:free documentation|gfdl|fdl)(?: license| licence)?(?:(?: version| v)? ?1 [123])?", r"gnu org licenses fdl", r"gfdl 1 [123](?: only| or later)?"),
    ("bsd-0", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", r"", r"0bsd"),
    ("bsd-1", "bsd", r"(?:(?:1|one) clause bsd|bsd (?:1|one) clause)", r"", r"bsd 1 clause"),
    ("bsd-2", "bsd", r"(?:(?:2|two) clause(?: simplified)? bsd|bsd (?:2|two) clause|simplified bsd|freebsd)", r"opensource org licenses? bsd 2 clause", r"bsd 2 clause(?: patent)?"),
    ("bsd-3", "bsd", r"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|modified bsd|revised bsd)", r"opensource org licenses? bsd 3 clause", r"bsd 3 clause(?: clear)?"),
    ("bsd-4", "bsd", r"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)", r"", r"bsd 4 clause(?: uc)?"),
    ("bsd", "bsd|berkeley", r"(?:bsd|bsd style|berkeley)", r"opensource org licenses? bsd", r"bsd"),
    ("mpl-1", "mpl|mozilla", r"(?:mozilla public|mpl)(?: license| licence)?(?: version| v)? ?1(?: [01])?", r"mozilla org mpl 1", r"mpl 1 [01]"),
    ("mpl-2", "mpl|mozilla", r"(?:mozilla public|mpl)(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"mozilla org mpl 2", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public", r"mozilla org mpl", r"mpl"),
    ("epl-1", "epl|eclipse", r"(?:eclipse public|epl)(?: license| licence)?(?: version| v)? ?1(?: 0)?", r"eclipse org legal epl v10", r"epl 1 0"),
    ("epl-2", "epl|eclipse", r"(?:eclipse public|epl)(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"eclipse org legal epl (?:2 0|v20)", r"epl 2 0"),
    ("eupl", "eupl|european union", r"(?:european union public|eupl)(?: license| licence)?(?:(?: version| v)? ?1 [0-2])?", r"", r"eupl 1 [0-2]"),
    ("cddl", "cddl|common development", r"(?:common development and distribution|cddl)(?: license| licence)?(?:(?: version| v)? ?1(?: [01])?)?", r"opensource org licenses? cddl", r"cddl 1 [01]"),
    ("cpl", "common public", r"common public(?: license| licence)?(?:(?: version| v)? ?1(?: 0)?)?", r"", r"cpl 1 0"),
    ("artistic-1", "artistic", r"artistic(?: license| licence)?(?: version| v)? ?1(?: 0)?", r"", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2", "artistic", r"artistic(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"opensource org licenses? artistic", r"artistic 2 0"),
    ("isc", "isc", r"isc", r"opensource org licenses? isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"opensource org licenses? zlib", r"zlib"),
    ("libpng", "libpng", r"libpng", r"", r"libpng(?: 2 0)?"),
    ("bsl-1", "boost", r"boost(?: software)?(?:(?: license| licence)(?: version| v)? ?1(?: 0)?)?", r"boost org license 1 0", r"bsl 1 0"),
    ("busl-1.1", "business source", r"business source", r"mariadb com bsl11", r"busl 1 1"),
    ("wtfpl", "wtfpl|do what the", r"(?:wtfpl|do what the fuck you want to public)", r"wtfpl net", r"wtfpl"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense org", r"unlicense"),
    ("ofl-1.1", "open font", r"(?:sil )?open font", r"scripts sil org ofl", r"ofl 1 1(?: rfn| no rfn)?"),
    ("postgresql", "postgresql", r"postgresql", r"opensource org licenses? postgresql", r"postgresql"),
    ("python-2", "python", r"python(?: software foundation)?", r"python org psf license", r"(?:psf|python) 2 0"),
    ("php-3", "php", r"php(?: license| licence)?(?:(?: version| v)? ?3(?: 0?1)?)?", r"php net license", r"php 3 01?"),
    ("ruby", "ruby", r"ruby", r"", r"ruby"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"", r"ncsa"),
    ("openssl", "openssl", r"openssl", r"", r"openssl"),
    ("upl-1", "universal permissive", r"universal permissive", r"", r"upl 1 0"),
    ("ms-pl", "microsoft public", r"microsoft public", r"", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", r"", r"ms rl"),
    ("odbl", "open da", r"open data(?: commons open)? ?(?:base)?(?: license| licence)?|open database", r"opendatacommons org licenses odbl", r"odbl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution", r"opendatacommons org licenses by", r"odc by 1 0"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and", r"opendatacommons org licenses pddl", r"pddl 1 0"),
    ("cc0", "cc0|cc zero|creative commons zero", r"(?:cc0|cc zero|creative commons zero)(?:(?: v| version)? ?1(?: 0)?)?(?: universal)?", r"creativecommons org publicdomain zero", r"cc0 1 0"),
    ("cc-by", "cc by|creative commons attribution", r"(?:cc by|creative commons attribution)(?: [1-4] [05])?(?: international| unported| generic)?", r"creativecommons org licenses by [1-4]", r"cc by [1-4] [05]"),
    ("cc-by-sa", "cc by|creative commons attribution", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", r"creativecommons org licenses by sa", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by|creative commons attribution", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?", r"creativecommons org licenses by nd", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by|creative commons attribution", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", r"creativecommons org licenses by nc [1-4]", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by|creative commons attribution", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", r"creativecommons org licenses by nc sa", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by|creative commons attribution", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?", r"creativecommons org licenses by nc nd", r"cc by nc nd [1-4] [05]"),
    ("openrail", "rail", r"(?:creativeml )?(?:big ?science )?(?:open)? ?rail(?: m)?", r"", r"openrail(?: m)?"),
    ("llama", "llama", r"llama(?: [234](?: [0-9])?)? community", r"", r"llama [234]"),
    ("elastic-2", "elastic", r"elastic(?: license| licence)?(?: version| v)? ?2(?: 0)?", r"elastic co licensing elastic license", r"elastic 2 0"),
    ("sspl-1", "server side public", r"server side public", r"", r"sspl 1 0"),
    ("osl-3", "open software", r"open software(?: license| licence)?(?:(?: version| v)? ?3(?: 0)?)?", r"", r"osl 3 0"),
    ("afl-3", "academic free", r"academic free(?: license| licence)?(?:(?: version| v)? ?[123](?: [01])?)?", r"", r"afl [123] [01]"),
    ("blueoak-1", "blue oak", r"blue oak model", r"blueoakcouncil org license 1 0 0", r"blueoak 1 0 0"),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software)(?: v2)?", r"", r"mulanpsl 2 0"),
]

GRANT = r"(?:(?:re)?licen[sc]ed|released|distributed|available|provided|published|redistributed|covered|used|shared|offered)"
_THE = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:gnu )?"
_LICENSE = r"(?: public| software)?(?: license| licence)s?"
#: name: (priority, score, pattern with {name}, {title}, {url} or {tag})
FORMS = {
    "grant": (40, 1.0, GRANT + r" (?:only )?under " + _THE + r"{name}(?:" + _LICENSE + r")?(?:(?: version| v)? ?[1-4](?: [0-9])?)?(?: only| or later)?"),
    "tag": (50, 1.0, r"spdx license identifier (?:[a-z0-9]+ (?:with|or|and) )?{tag}"),
    "notice": (30, 0.8, r"(?:under|see|by|to|is|license|licence|with) " + _THE + r"{name}" + _LICENSE),
    "named": (20, 0.6, r"{name}" + _LICENSE),
    "title": (25, 0.7, r"{title}"),
    "field": (30, 0.9, r"licen[sc]e(?: is)? (?:the )?{name}"),
    "address": (35, 0.9, r"(?:https? )?(?:www )?{url}(?: [0-9])*(?: html| txt| php)?"),
}
#: Rules that name no licence of the list.
OTHER = [
    (10, "all rights reserved", "proprietary", r"all rights reserved", 0.3),
    (10, "public domain", "public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.7),
    (15, "permission is hereby granted", "mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    (15, "redistribution and use", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    (15, "free software foundation", "gpl", r"under the terms of the gnu general public license as published by the free software foundation", 1.0),
    (15, "permission to use", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    (15, "altered source versions", "zlib", r"altered source versions must be plainly marked as such", 0.9),
    (15, "unencumbered software", "unlicense", r"this is free and unencumbered software released into the public domain", 1.0),
]


#: Sentences of licence texts and notices, as words; each names its licence by itself. Keyword, label, pattern; whatever a pattern matches holds its keyword.
SENTENCES = [
    ("without restriction", "mit", r"to deal in the software without restriction including without limitation the rights to use copy modify"),
    ("above copyright notice", "mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("warranty of any kind", "mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("may not use this file", "apache-2", r"you may not use this file except in compliance with the license"),
    ("obtain a copy of the license", "apache-2", r"you may obtain a copy of the license at(?: https?)? www apache org"),
    ("terms and conditions for use", "apache-2", r"terms and conditions for use reproduction and distribution"),
    ("perpetual worldwide", "apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("end user documentation", "apache-1.1", r"the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation"),
    ("either version 1", "gpl-1", r"general public license as published by the free software foundation either version 1(?: of the license)? or(?: at your option)? any later version"),
    ("either version 2", "gpl-2-or-later", r"gnu general public license as published by the free software foundation either version 2(?: of the license)? or(?: at your option)? any later version"),
    ("either version 3", "gpl-3-or-later", r"gnu general public license as published by the free software foundation either version 3(?: of the license)? or(?: at your option)? any later version"),
    ("version 2 june 1991", "gpl-2", r"gnu general public license version 2 june 1991"),
    ("version 3 29 june 2007", "gpl-3", r"gnu general public license version 3 29 june 2007"),
    ("version 2 1 february 1999", "lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999"),
    ("lesser general public", "lgpl-3", r"gnu lesser general public license version 3 29 june 2007"),
    ("lesser general public", "lgpl-2.1", r"gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or(?: at your option)? any later version"),
    ("lesser general public", "lgpl-3", r"gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or(?: at your option)? any later version"),
    ("library general public", "lgpl-2", r"gnu library general public license (?:version 2 june 1991|as published by the free software foundation)"),
    ("affero general public", "agpl-3", r"gnu affero general public license (?:version 3 19 november 2007|as published by the free software foundation(?: either)? version 3)"),
    ("remote network interaction", "agpl-3", r"remote network interaction use with the gnu general public license"),
    ("free documentation license", "fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("without even the implied warranty", "gpl", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("copy of the gnu general public", "gpl", r"you should have received a copy of the gnu general public license"),
    ("copy of the gnu lesser", "lgpl", r"you should have received a copy of the gnu lesser general public license"),
    ("copy of the gnu affero", "agpl", r"you should have received a copy of the gnu affero general public license"),
    ("must retain the above", "bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("in binary form", "bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("neither the name", "bsd-3", r"neither the names? of (?:the )?(?:[a-z0-9]+ ){1,8}?(?:nor|and) the names of its contributors may be used to endorse or promote products"),
    ("advertising materials", "bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("governed by a bsd", "bsd", r"is governed by a bsd (?:style )?licen[sc]e that can be found in the licen[sc]e file"),
    ("source code form is subject", "mpl-2", r"this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("mozilla public license", "mpl-1", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("copy of the mpl", "mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("eclipse public license", "epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    ("eclipse public license", "epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0"),
    ("agreement recipient", "epl-1", r"the accompanying program is provided under the terms of this eclipse public license agreement recipient"),
    ("common development and distribution", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", r"licensed under the eupl(?: version)? 1 [12] or as soon they will be approved by the european commission"),
    ("artistic license", "artistic-2", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic license 2 0"),
    ("terms as perl", "artistic-1", r"(?:under|same) (?:the )?(?:same )?terms as perl(?: 5| itself)?"),
    ("with or without fee", "isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("held liable for any damages", "zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("origin of this software", "zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost software license", "bsl-1", r"distributed under the boost software license version 1 0 see accompanying file"),
    ("production use", "busl-1.1", r"make production use of the licensed work provided"),
    ("change date", "busl-1.1", r"business source license(?: [a-z0-9]+){0,40}? change date"),
    ("the fuck you want", "wtfpl", r"you just do what(?:ever)? the fuck you want to"),
    ("free and unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain"),
    ("font software", "ofl-1.1", r"this font software is licensed under the sil open font license version 1 1"),
    ("without a written agreement", "postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python software foundation license", "python-2", r"python software foundation license version 2"),
    ("subject to version 3 01", "php-3", r"this source file is subject to version 3 01 of the php license"),
    ("universal permissive license", "upl-1", r"the universal permissive license upl version 1 0"),
    ("microsoft public license", "ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license microsoft public license"),
    ("open database license", "odbl", r"made available under the open database license"),
    ("waived all copyright", "cc0", r"(?:has|have) waived all copyright and related or neighbou?ring rights to"),
    ("dedicated the work", "cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("attribution 4 0 international", "cc-by", r"licensed under (?:a |the )?creative commons attribution 4 0 international license"),
    ("attribution sharealike", "cc-by-sa", r"licensed under (?:a |the )?creative commons attribution sharealike [1-4] [05](?: international| unported)? license"),
    ("attribution noncommercial", "cc-by-nc", r"licensed under (?:a |the )?creative commons attribution noncommercial [1-4] [05](?: international| unported)? license"),
    ("attribution noncommercial", "cc-by-nc-nd", r"licensed under (?:a |the )?creative commons attribution noncommercial noderiv(?:ative)?s [1-4] [05](?: international| unported)? license"),
    ("use based restrictions", "openrail", r"use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("llama materials", "llama", r"you are granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property(?: or other rights)? (?:owned by meta )?embodied in the llama materials"),
    ("hosted or managed service", "elastic-2", r"you may not provide the software to third parties as a hosted or managed service"),
    ("offering the program as a service", "sspl-1", r"offering the program as a service if you make the functionality of the program"),
    ("academic free license", "afl-3", r"licensed under the academic free license version 3 0"),
    ("open software license", "osl-3", r"licensed under the open software license version 3 0"),
    ("mulan psl", "mulan-2", r"you can use this software according to the terms and conditions of the mulan psl v2"),
    ("blue oak model", "blueoak-1", r"blue oak model license(?: version)? 1 0 0"),
    ("internal use only", "proprietary", r"(?:confidential|proprietary)(?: and (?:confidential|proprietary))? (?:for )?internal use only"),
    ("unauthorized copying", "proprietary", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("may not be reproduced", "proprietary", r"may not be reproduced(?: [a-z]+){0,8}? without (?:the )?(?:prior |express |written )+permission"),
]
#: Words of which each of SENTENCES without a word for licence holds one.
SENTENCE_WORDS = ("restriction", "merchantability", "notice", "endorse", "acknowledg", "affero", "perl", "liable", "misrepresented", "production", "fuck", "waived", "dedicated", "enforceable", "managed", "functionality", "mulan", "internal", "unauthorized", "reproduced", "mpl", "reproduction")


def _literal(pattern: str) -> str:
    """What a pattern begins with, up to its first choice."""
    found = re.match(r"[a-z0-9 ]*", pattern)[0]
    return found[:-1] if pattern[len(found) :].startswith("?") else found


def rules() -> list[tuple[int, tuple[str, ...], str, str, float]]:
    """(priority, keywords, label, pattern, score), the first the most important."""
    out = []
    for label, keywords, name, url, tag in LICENSES:
        for form, (priority, score, pattern) in FORMS.items():
            if form == "address" and not url:
                continue
            title = name.replace("(?: license| licence)?", "(?: license| licence)")
            if form == "title" and title == name:
                continue
            body = pattern.replace("{name}", f"(?:{name})").replace("{title}", title).replace("{url}", url).replace("{tag}", tag)
            need = {"address": (url.split(" ")[0].replace("(?:", ""),), "tag": (_literal(tag) or "spdx",)}.get(form, tuple(keywords.split("|")))
            out.append((priority, need, label, body, score))
    out += [(p, (k,), label, pattern, s) for p, k, label, pattern, s in OTHER]
    out += [(45, (k,), label, pattern, 1.0 if label != "proprietary" else 0.5) for k, label, pattern in SENTENCES]
    return sorted(out, key=lambda r: -r[0])


#: Label and words of the phrases that every scan finds, whatever the rules say.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
