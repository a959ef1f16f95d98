"""License scans: ordered signature rules with a keyword prefilter; containment and priority settle overlaps.

A rule is a regular expression over lower-case text, its white space and comment prefixes folded to one space, with a label, a priority and
keywords. It runs only on texts that hold one word of each of
its keyword groups. Of the detections, a smaller priority number wins, then the longer, then the earlier; a detection
that lies inside a winner's interval is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_arrow, text_parts

#: Base phrases of the output contract (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License families. Label, name pattern, versions ("" for none), abbreviation pattern, address pattern.
FAMILIES = (
    ("apache", r"apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0"), r"apache", r"apache\.org/licenses/license"),
    ("gpl", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e", ("1.0", "2.0", "3.0"), r"gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2.0", "2.1", "3.0"), r"lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", ("1.0", "3.0"), r"agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", ("1.1", "1.2", "1.3"), r"gfdl", r"gnu\.org/licenses/fdl"),
    ("mpl", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0"), r"mpl", r"mozilla\.org/mpl"),
    ("epl", r"eclipse public licen[cs]e", ("1.0", "2.0"), r"epl", r"eclipse\.org/legal/epl"),
    ("eupl", r"european union public licen[cs]e", ("1.0", "1.1", "1.2"), r"eupl", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cddl", r"common development and distribution licen[cs]e", ("1.0", "1.1"), r"cddl", r"opensource\.org/licenses/cddl"),
    ("cpl", r"common public licen[cs]e", ("1.0",), r"cpl", r"opensource\.org/licenses/cpl"),
    ("osl", r"open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0"), r"osl", r"opensource\.org/licenses/osl"),
    ("afl", r"academic free licen[cs]e", ("1.1", "2.0", "2.1", "3.0"), r"afl", r"opensource\.org/licenses/afl"),
    ("artistic", r"artistic licen[cs]e", ("1.0", "2.0"), r"artistic", r"perlfoundation\.org/artistic_license"),
    ("boost", r"boost software licen[cs]e", ("1.0",), r"bsl", r"boost\.org/license"),
    ("mit", r"mit licen[cs]e", ("",), r"mit", r"opensource\.org/licen[cs]es?/mit"),
    ("isc", r"isc licen[cs]e", ("",), r"isc", r"opensource\.org/licen[cs]es?/isc"),
    ("bsd", r"bsd licen[cs]e", ("", "2-clause", "3-clause", "4-clause"), r"bsd", r"opensource\.org/licen[cs]es?/bsd"),
    ("0bsd", r"zero[- ]clause bsd licen[cs]e", ("",), r"0bsd", r"opensource\.org/licen[cs]es?/0bsd"),
    ("zlib", r"zlib licen[cs]e", ("",), r"zlib", r"opensource\.org/licen[cs]es?/zlib"),
    ("unlicense", r"the unlicen[cs]e", ("",), r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f\S+ you want to public licen[cs]e", ("", "2.0"), r"wtfpl", r"wtfpl\.net"),
    ("python", r"python software foundation licen[cs]e", ("", "2.0"), r"psf", r"python\.org/\S*license"),
    ("postgresql", r"postgresql licen[cs]e", ("",), r"postgresql", r"postgresql\.org/about/licence"),
    ("openssl", r"openssl licen[cs]e", ("",), r"openssl", r"openssl\.org/source/license"),
    ("ms-pl", r"microsoft public licen[cs]e", ("",), r"ms-pl", r"opensource\.org/licen[cs]es?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", ("",), r"ms-rl", r"opensource\.org/licen[cs]es?/ms-rl"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e", ("1.0",), r"odbl", r"opendatacommons\.org/licenses/odbl"),
    ("ofl", r"(?:sil )?open font licen[cs]e", ("1.0", "1.1"), r"ofl", r"scripts\.sil\.org/ofl"),
    ("ogl-uk", r"open government licen[cs]e", ("1.0", "2.0", "3.0"), r"ogl", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("upl", r"universal permissive licen[cs]e", ("1.0",), r"upl", r"oss\.oracle\.com/licenses/upl"),
    ("vim", r"vim licen[cs]e", ("",), r"vim", r"vimdoc\.sourceforge\.net/\S*license"),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", ("",), r"w3c", r"w3\.org/consortium/legal"),
    ("ncsa", r"ncsa open source licen[cs]e", ("",), r"ncsa", r"otm\.illinois\.edu/uiuc_opensource"),
    ("sleepycat", r"sleepycat licen[cs]e", ("",), r"sleepycat", r"opensource\.org/licen[cs]es?/sleepycat"),
    ("mulan", r"mulan (?:permissive software|psl) licen[cs]e", ("1.0", "2.0"), r"mulanpsl", r"license\.coscl\.org\.cn"),
    ("busl", r"business source licen[cs]e", ("1.0", "1.1"), r"busl", r"mariadb\.com/bsl"),
    ("sspl", r"server side public licen[cs]e", ("1.0",), r"sspl", r"mongodb\.com/\S*server-side-public-license"),
    ("elastic", r"elastic licen[cs]e", ("1.0", "2.0"), r"elastic", r"elastic\.co/licensing/elastic-license"),
    ("llama", r"llama(?: \d)? community licen[cs]e", ("",), r"llama", r"llama\.meta\.com/\S*license"),
    ("openrail", r"(?:creativeml )?open(?: )?rail(?:-m)? licen[cs]e", ("",), r"openrail", r"huggingface\.co/spaces/bigscience/license"),
)
# Identifiers that differ from the label.
SPDX = {"boost": "bsl", "mulan": "mulanpsl", "python": "(?:psf|python)", "sspl": "sspl", "w3c": "w3c(?:-\\d+)?", "mit": "(?:mit|mit-0|x11)", "bsd": "bsd", "vim": "vim", "ncsa": "ncsa"}

# Sentences of license texts and notices, a rule each: label, words that must be there (groups by comma, choices by slash), pattern.
SENTENCES = r"""
mit | permission,granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | above,copyright | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions
mit | software,noninfringement | the software is provided [^\w ]*as is[^\w ]*,? without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
mit | mit,licensed/license | (?:licensed under|released under|see) (?:the )?mit-?(?:style)? licen[cs]e
isc | permission,distribute,software | permission to use, copy, modify,? and/or distribute this software for any purpose
isc | permission,distribute,software | permission to use, copy, modify,? and distribute this software for any purpose with or without fee is hereby granted
hpnd | permission,documentation,advertising | permission to use, copy, modify,? and distribute this software and its documentation for any purpose
bsd | redistribution,binary | redistribution and use in source and binary forms, with or without modification, are permitted
bsd | redistributions,retain | redistributions of source code must retain the above copyright notice, this list of conditions
bsd | redistributions,reproduce | redistributions in binary form must reproduce the above copyright notice, this list of conditions
bsd-3-clause | endorse,promote | neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-4-clause | advertising,acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | regents,university | the regents of the university of california
bsd | copyright,holders,contributors | this software is provided by the copyright holders and contributors [^\w ]*as is[^\w ]*
bsd | bsd,license/licence | (?:use of this source code is )?governed by an? (?:bsd|bsd-style) licen[cs]e
apache-2.0 | licensed,apache | licensed under the apache license, version 2\.0 \(the [^\w ]*license[^\w ]*\)
apache-2.0 | distributed,warranties | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an [^\w ]*as is[^\w ]* basis
apache-2.0 | contributor,license | licensed to the apache software foundation \(asf\) under one or more contributor license agreements
apache-2.0 | derivative,works | terms and conditions for use, reproduction, and distribution 1\. definitions
apache-1.1 | product,apache | this product includes software developed by the apache (?:software foundation|group)
apache | apache,project | the names [^\w ]*apache[^\w ]* and [^\w ]*apache software foundation[^\w ]* must not be used to endorse
gpl | free,software,redistribute | this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl-2.0 | version,later | either version 2 of the licen[cs]e, or \(at your option\) any later version
gpl-2.0 | gpl/general,version | gnu general public licen[cs]e,? (?:as published by the free software foundation[,;]? )?(?:either )?version 2(?![\d.])
gpl-3.0 | version,later | either version 3 of the licen[cs]e, or \(at your option\) any later version
gpl-3.0 | gpl/general,version | gnu general public licen[cs]e,? (?:as published by the free software foundation[,;]? )?(?:either )?version 3(?![\d.])
gpl | received,copy | you should have received a copy of the gnu general public licen[cs]e
gpl | details,general | see the gnu general public licen[cs]e for more details
gpl | copyleft,gpl/gnu | (?:gpl|gnu)[- ]?(?:copyleft|compatible) licen[cs]e
gpl | everyone,permitted | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed
gpl | preamble,share | the gnu general public license is intended to guarantee your freedom to share and change
gpl | classpath,exception | classpath exception|linking this library statically or dynamically with other modules
gpl | gcc,runtime | gcc runtime library exception
lgpl | library,redistribute | this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl-2.1 | version,later,lesser | lesser general public licen[cs]e as published by the free software foundation[;,] either version 2\.1
lgpl-3.0 | version,later,lesser | lesser general public licen[cs]e as published by the free software foundation[;,] either version 3
lgpl | received,lesser/library | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl | affero,received | you should have received a copy of the gnu affero general public licen[cs]e
agpl-3.0 | affero,version | gnu affero general public licen[cs]e as published by the free software foundation[,;] (?:either )?version 3
agpl | remote,network | (?:prominently offer all users interacting with it remotely|remote network interaction; use with the gnu general public license)
gfdl | documentation,invariant | with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
gfdl | documentation,permission | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-1.1 | mozilla,contents | the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
mpl-2.0 | source,mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0
mpl-2.0 | incompatible,secondary | this source code form is [^\w ]*incompatible with secondary licenses[^\w ]*
mpl | mpl,distributed | if a copy of the mpl was not distributed with this file
epl | eclipse,accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
epl-2.0 | eclipse,secondary | this source code may also be made available under the following secondary licenses
epl | accompanying,agreement | the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 | common,accompanying | the accompanying program is provided under the terms of this common public licen[cs]e
cddl | cddl/distribution,contents | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl | cddl,header | cddl header start
eupl | eupl,licence/license | licensed under the eupl
eupl | european,work | this european union public licence .{0,40}?applies to the work
artistic | artistic,perl | you may distribute under the terms of either the gnu general public license or the artistic license
artistic | artistic,terms/perl | under the same terms as perl itself
artistic-2.0 | artistic,standard | this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
zlib | origin,misrepresented | the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib | altered,source | altered source versions must be plainly marked as such, and must not be misrepresented
zlib | liable,damages,authors | in no event will the authors be held liable for any damages arising from the use of this software
boost-1.0 | boost,distributed | distributed under the boost software licen[cs]e,? version 1\.0
boost-1.0 | permission,obtaining,accompanying | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered,public | this is free and unencumbered software released into the public domain
unlicense | anyone,publish,compile | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
unlicense | heirs,successors | in perpetuity of all present and future rights to this software under copyright law
cc0-1.0 | waived,related | to the extent possible under law,? .{1,120}? (?:has|have) (?:dedicated|waived) all copyright and related
cc0-1.0 | dedicate,worldwide | dedicated all copyright and related and neighboring rights to this software to the public domain worldwide
cc0-1.0 | cc0,universal | cc0 1\.0 universal
cc-by | creative,commons,attribution | this work is licensed under (?:a|the) creative commons attribution(?: \d\.\d)?(?: international| unported| generic)? licen[cs]e
cc-by-sa | creative,sharealike | this work is licensed under (?:a|the) creative commons attribution[- ]share ?alike
cc-by-nc | creative,noncommercial | this work is licensed under (?:a|the) creative commons attribution[- ]non-?commercial(?![- ]*(?:share|no))
cc-by-nd | creative,noderivatives/noderivs | this work is licensed under (?:a|the) creative commons attribution[- ]no-?deriv(?:ative)?s
cc-by-nc-sa | creative,sharealike,noncommercial | creative commons attribution[- ]non-?commercial[- ]share ?alike
cc-by-nc-nd | creative,noncommercial | creative commons attribution[- ]non-?commercial[- ]no-?deriv
cc-pdm | public,domain,mark | public domain mark 1\.0
wtfpl | wtf/want,public | you just do what the f\S+ you want to
beerware | beer,ware/beerware | [^\w ]*the beer-?ware licen[cs]e[^\w ]*|buy me a beer in return
json | shall,evil | the software shall be used for good, not evil
python | psf,python | psf is making python available to licensee on an [^\w ]*as is[^\w ]* basis
python | beopen/cnri,python | (?:beopen\.com|cnri) license agreement for python
php | php,product | this product includes php software, freely available from
ruby | ruby,copying | you may redistribute (?:it|this software) and/or modify it under either the terms of the (?:2-clause bsdl|gpl)
openssl | openssl,toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric,cryptographic | this product includes cryptographic software written by eric young
curl | curl,permission | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
libpng | libpng,copyright | libpng versions \d
ijg | jpeg,independent | this software is based in part on the work of the independent jpeg group
freetype | freetype,project | portions of this software are copyright .{0,40}?the freetype project
icu | icu,unicode | icu license - icu 1\.8\.1 and later
unicode | unicode,data | permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
ofl-1.1 | font,reserved | this font software is licensed under the sil open font licen[cs]e, version 1\.1
ofl | font,reserved | with reserved font name
ms-pl | microsoft,reciprocal/public | this license governs use of the accompanying software\. if you use the software, you accept this license
ncsa | illinois/ncsa | university of illinois/ncsa open source licen[cs]e
w3c | w3c,notice | w3c(?:\(r\))? software notice and licen[cs]e
x11 | consortium,advertising | except as contained in this notice, the name of .{1,60}? shall not be used in advertising
postgresql | permission,fee,agreement | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement
odbl-1.0 | database,odbl/commons | made available under the open database licen[cs]e
odc-by | attribution,odc/commons | open data commons attribution licen[cs]e
pddl | public,dedication | public domain dedication and licen[cs]e
ogl-uk | government,licence/license | contains public sector information licensed under the open government licen[cs]e
etalab | ouverte,licence | licence ouverte
busl | change,date,license | change date:? .{1,40}?change licen[cs]e
sspl | server,side,service | offering the program as a service|service source code
elastic-2.0 | hosted,managed | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons,clause | [^\w ]*commons clause[^\w ]* licen[cs]e condition
polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) licen[cs]e
openrail | use,restrictions,derivatives | use[- ]based restrictions (?:as referenced in|set forth in)
llama | llama,meta | llama \d(?:\.\d)? is licensed under the llama \d(?:\.\d)? community licen[cs]e
gemma | gemma,terms | gemma is provided under and subject to the gemma terms of use
nvidia | nvidia,proprietary | nvidia corporation and its licensors retain all intellectual property
intel | intel,simplified | intel simplified software licen[cs]e
oracle | oracle,network/binary | oracle (?:binary code|technology network) licen[cs]e
adobe | adobe,permission | adobe systems incorporated .{0,20}?source code licen[cs]e
public-domain | public,domain | (?:in|into|to) the public domain
public-domain | public,domain | this (?:work|file|document|text) is (?:in the )?public domain
public-domain | waive,copyright | (?:i|we|the authors?) (?:hereby )?waive all (?:copyright|rights)
proprietary | proprietary,confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized,copying | unauthorized (?:copying|reproduction|distribution) of this (?:file|work|document|material)s?,? (?:via any medium|is strictly prohibited)
proprietary | reproduced,permission | no part of this (?:publication|book|document|work|site|website) may be reproduced
proprietary | permission,written,reproduced/reproduction/published | may not be (?:published, )?(?:broadcast, )?(?:rewritten,? )?(?:reproduced|redistributed) without (?:prior )?(?:written )?permission
proprietary | personal,commercial | for personal,? non-?commercial use only
proprietary | evaluation,license/licence | evaluation licen[cs]e agreement|licensed for evaluation purposes only
eula | end,user,agreement | end[- ]user licen[cs]e agreement
reserved | rights,reserved | (?:all|some) rights reserved
reserved | tous,droits | tous droits r\S{1,2}serv\S{1,2}s
reserved | alle,rechte | alle rechte vorbehalten
reserved | todos,derechos | todos los derechos reservados
reserved | tutti,diritti | tutti i diritti riservati
no-license | license,given/granted | no licen[cs]e is (?:granted|given)
"""
_CC_PARTS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?-?commercial", "nd": "no ?-?deriv(?:ative)?s?(?: works)?"}
_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|governed)(?: \w+){0,3} (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:\w+ ){0,2}"
_IDIOMS = {"artistic": r"(?:the|perl|clarified) "}  # names that are also common speech: words that must stand before them
_LICENSE_WORDS = ("license", "licence", "licensed", "licenced", "licenses", "licences")


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[tuple[str, ...], ...]
    pattern: str


def _version(v: str) -> str:
    if not v:
        return ""
    if v.endswith("-clause"):
        n = {"2": "(?:2|two)", "3": "(?:3|three)", "4": "(?:4|four)"}[v[0]]
        return n + r"[ -]clause"
    head, _, tail = v.partition(".")
    number = head + (r"(?:\.0)?" if tail == "0" else r"\." + tail)
    return r",?[ -]?\(?(?:version |ver\.? ?|v\.? ?)?" + number + r"(?![\d.]*\d)\)?"


def _identifier(spdx: str, end: str = "") -> str:
    """An operand of an identifier's expression; the detection is the operand alone."""
    return rf"spdx-license-identifier: *(?:\(* *[\w.+-]+ *\)* +(?:and|or|with) +)*\(* *(?P<at>{spdx}{end})(?![\w.+-]*\w)"


def rules() -> list[Rule]:
    """Every rule, in order of priority and name. They come from the families above and their forms."""
    out = []
    for label, name, versions, short, url in FAMILIES:
        first = re.match(r"[a-z0-9]+", short)[0]
        host = tuple((w,) for w in url.split("/")[0].split(r"\."))
        for v in versions if "" in versions else (*versions, ""):
            full = f"{label}-{v}" if v else label
            told = _version(v)
            with_v = f"{name}(?: ?,)?{told}" if not v.endswith("-clause") else name.replace("bsd", f"(?:{told} bsd|bsd {told})")
            short_v = f"{short}{told}" if not v.endswith("-clause") else f"{short}[ -]{told}"
            base = 0 if v else 1
            grant = rf"\b{_GRANT}(?:{with_v}|{short_v})"
            if not v and "" not in versions:  # the version isn't told: nothing but "under" makes a bare abbreviation a license
                grant = rf"\b(?:{_GRANT}{name}|{_GRANT.replace('(?:under|by)', 'under')}{short}\b)"
                if label in _IDIOMS:
                    with_v, short_v = f"{_IDIOMS[label]}{name}", f"{_IDIOMS[label]}{short}"
            out += [
                Rule(f"{full}/grant", full, 10 + base, 0.99, (_LICENSE_WORDS + ("released", "distributed", "available", "published", "provided", "redistributed", "covered", "governed"), ("under", "by")), grant),
                Rule(f"{full}/identifier", full, 5 + base, 1.0, (("spdx",),), _identifier(SPDX.get(label, re.escape(label)) + (f"-{re.escape(v)}" if v else ""), r"(?:-only|-or-later|\+)?")),
                Rule(f"{full}/address", full, 20 + base, 0.95, host, url + (r"\S{0,12}" + re.escape(v) if v else "")),
                Rule(f"{full}/name", full, 30 + base, 0.8, (_LICENSE_WORDS + ("unlicense",),), rf"\b{with_v}"),
                Rule(f"{full}/short", full, 40 + base, 0.6, ((first,), _LICENSE_WORDS), rf"\b{short_v}[ -]licen[cs]ed?\b"),
            ]
    for part in _CC_PARTS:
        long = r"[ -,]{0,3}".join(_CC_WORDS[x] for x in part.split("-"))
        for v in ("", *_CC_VERSIONS):
            full = f"cc-{part}" + (f"-{v}" if v else "")
            end = (r"[ -]v?" + re.escape(v) + r"(?![\d.]*\d)") if v else r"(?![- ]?(?:sa|nc|nd)\b)"
            out += [
                Rule(f"{full}/code", full, 10 + (not v), 0.98, (("cc",), ("by",)), r"\bcc[ -]" + part.replace("-", "[ -]") + r"\b" + end),
                Rule(f"{full}/words", full, 15 + (not v), 0.97, (("creative",), ("commons",)), r"creative commons " + long + end.replace("[ -]v?", r"[ ,]{0,2}(?:(?:international|unported|generic|public|licen[cs]e|version) )*v?")),
                *([Rule(f"{full}/identifier", full, 5, 1.0, (("spdx",),), _identifier(re.escape(full)))] if v else []),
                Rule(f"{full}/address", full, 20 + (not v), 0.99, (("creativecommons",),), rf"creativecommons\.org/licenses/{part}/" + re.escape(v)),
            ]
    out += [
        Rule("cc0/code", "cc0-1.0", 10, 0.98, (("cc0",),), r"\bcc0(?:[ -]1\.0)?\b"),
        Rule("cc0/address", "cc0-1.0", 10, 0.99, (("creativecommons",),), r"creativecommons\.org/publicdomain/zero/1\.0"),
        Rule("cc0/identifier", "cc0-1.0", 5, 1.0, (("spdx",),), _identifier(r"cc0-1\.0")),
        Rule("copyright/line", "copyright", 60, 0.5, (("copyright",),), r"\bcopyright (?:\(c\)|©)? ?\d{4}\b"),
    ]
    for i, line in enumerate(x for x in SENTENCES.strip().split("\n")):
        label, words, pattern = line.split(" | ", 2)
        weak = label in ("public-domain", "proprietary", "eula", "reserved", "no-license")
        out.append(Rule(f"{label}/text-{i}", label, 50 + 10 * (label == "reserved") if weak else 12, 0.7 if label == "reserved" else 0.85 if weak else 0.97, tuple(tuple(w.split("/")) for w in words.split(",")), pattern))
    return sorted(out, key=lambda r: (r.priority, r.name))


# What is folded to one space: line breaks with the comment signs about them, and other white space that isn't a single space.
_SIGN = r"(?:/\*+|//+|\*+/|\*+|#+|;+|--+|%+|\"+|'+|!+|>+|\|+|<!--|(?:rem|dnl)(?=\s))"
_FOLD = re.compile(rf"(?:\s+[*#|/]+)?\s*\n\s*(?:{_SIGN}\s*)*|\s\s+|[^\S ]|\A(?:{_SIGN}\s*)+")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text, and where its pieces begin in it and in ``text``."""
    pieces, here, there, size, last = [], [0], [0], 0, 0
    for m in _FOLD.finditer(text):
        pieces += [text[last : m.start()], " "]
        size += m.start() - last
        here += [size, size + 1]
        there += [m.start(), m.end()]
        size, last = size + 1, m.end()
    pieces.append(text[last:])
    return "".join(pieces), here, there


class _Inside:
    """Whether an interval lies in one of those added: the farthest end of all that begin no later, in a tree over the beginnings."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.far = [-1] * (len(self.starts) + 1)

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        while i < len(self.far):
            self.far[i] = max(self.far[i], b)
            i += i & -i

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        while i:
            if self.far[i] >= b:
                return True
            i -= i & -i
        return False


def detect(text: str, candidates: list[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, Rule]]:
    """Detections of a lower-case text after suppression, in order of place. A rule's group ``at``, if it has one, is its detection."""
    text, here, there = folded(text)
    found = []
    for r, p in candidates:
        group = "at" if "at" in p.groupindex else 0
        found += [(r.priority, m.start(group) - m.end(group), m.start(group), m.end(group), r) for m in p.finditer(text) if m.end(group) > m.start(group)]
    found.sort(key=lambda x: (*x[:3], x[4].name))
    winners = _Inside([x[2] for x in found])
    kept: list[tuple[int, int, Rule]] = []
    for _, _, a, b, r in found:
        if not winners.holds(a, b):
            winners.add(a, b)
            kept.append((a, b, r))

    def place(i: int) -> int:
        j = bisect_right(here, i) - 1
        return there[j] + i - here[j]

    return sorted(((place(a), place(b - 1) + 1, r) for a, b, r in kept), key=lambda x: x[:2])


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def hash_words(words: list[str]) -> np.ndarray:
    b = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = tv.runs(b != 32, np.array([0, len(b)]))
    return tv.Spans(b).hash(s, e)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every row of ``docs``.

    detections is a list of (start, end, rule, label) in characters of the lower-case text. Null and empty texts have none.
    Columns beside doc_id and text are ignored; repeated rows are scanned alike; an empty table gives an empty result.
    """
    every = rules()
    vocabulary = sorted({w for r in every for group in r.keywords for w in group})
    keys = hash_words(vocabulary)
    phrases = [(hash_words(p.split()), label) for p, label in PHRASES]

    def go(batches):
        order = np.argsort(keys)
        sorted_keys = keys[order]
        column = {w: i for i, w in enumerate(vocabulary)}
        compiled = [(r, re.compile(r.pattern), [[column[w] for w in g] for g in r.keywords]) for r in every]
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1)):
                nd = len(offs) - 1
                b = tv.LOWER[b]
                s, e, doc = tv.runs(_WORD[b], offs)
                h = tv.Spans(b).hash(s, e)
                words = np.bincount(doc, minlength=nd)
                begin = np.cumsum(words) - words
                n_base, first, last = np.zeros(nd, np.int64), np.full(nd, np.iinfo(np.int64).max), np.full(nd, -1)
                base = [set() for _ in range(nd)]
                for ph, label in phrases:
                    k = len(ph)
                    n = len(h) - k + 1
                    if n <= 0:
                        continue
                    ok = doc[:n] == doc[k - 1 :]
                    for i in range(k):
                        ok &= h[i : i + n] == ph[i]
                    hit = np.flatnonzero(ok)
                    d = doc[hit]
                    n_base += np.bincount(d, minlength=nd)
                    np.minimum.at(first, d, hit - begin[d])
                    np.maximum.at(last, d, hit - begin[d])
                    for x in set(d.tolist()):
                        base[x].add(label)
                i = np.minimum(np.searchsorted(sorted_keys, h), len(keys) - 1)
                hit = np.flatnonzero(sorted_keys[i] == h)
                has = np.zeros((nd, len(keys)), bool)
                has[doc[hit], order[i[hit]]] = True
                gates = np.ones((len(compiled), nd), bool)
                for j, (_, _, groups) in enumerate(compiled):
                    for g in groups:
                        gates[j] &= has[:, g].any(axis=1)
                labels, score, places = [], np.zeros(nd), [[] for _ in range(nd)]
                for d in range(nd):
                    mine = set(base[d])
                    miss = 1.0 if not mine else 0.5
                    active = np.flatnonzero(gates[:, d])
                    if len(active):
                        text = b[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")
                        places[d] = detect(text, [compiled[j][:2] for j in active.tolist()])
                        mine |= {r.label for _, _, r in places[d]}
                        for _, _, r in places[d]:
                            miss *= 1 - r.confidence
                    labels.append(",".join(sorted(mine)))
                    score[d] = 1 - miss
                some = n_base > 0
                cols = [
                    batch.column(0).slice(at, nd), pa.array(words.astype(np.int64)), pa.array(n_base),
                    pa.array(first, pa.int64(), mask=~some), pa.array(last, pa.int64(), mask=~some),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array(labels, pa.string()), pa.array(score),
                    pa.array([[{"start": x, "end": y, "rule": r.name, "label": r.label} for x, y, r in p] for p in places], _PLACES),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_arrow(rows, go, kind + ", detections array<struct<start:int,end:int,rule:string,label:string>>")


_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("label", pa.string())]))
