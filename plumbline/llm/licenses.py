"""License scans by ordered signature rules.

A rule is a pattern, a label and a priority, gated by a keyword: a pattern runs
only over texts that hold its keyword.  Detections of a higher priority, then
longer ones, then earlier ones come first; one whose interval lies within an
interval already taken is suppressed, whatever its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label: (keywords, one of which any match holds, pattern of the licence's name, SPDX identifier, part of its address); hand-written, in order of precedence.
LICENSES: dict[str, tuple[str, str, str, str]] = {
    "agpl": ("affero|agpl", r"(?:gnu )?affero general public licen[sc]e|agpl[ -]?(?:v\.? ?|version )?[13](?:\.\d)?\+?", r"agpl-[\d.]+", r"gnu\.org/licenses/agpl"),
    "lgpl": ("lesser general|library general|lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl[ -]?(?:v\.? ?|version )?[23](?:\.\d)?\+?", r"lgpl-[\d.]+", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    "gfdl": ("free documentation|gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl", r"gfdl-[\d.]+", r"gnu\.org/licenses/fdl"),
    "gpl": ("general public|gpl", r"(?:gnu )?general public licen[sc]e|gnu gpl(?:[ -]?v?[23](?:\.\d)?\+?)?|gpl[ -]?(?:v\.? ?|version )?[123](?:\.\d)?\+?", r"gpl-[\d.]+", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    "cc-by-nc-nd": ("nc-nd|nc nd|commercial", r"(?:cc[ -])?by[ -]nc[ -]nd|creative commons attribution[ -]non-?commercial[ -]no-?derivatives?", r"cc-by-nc-nd-[\d.]+", r"creativecommons\.org/licenses/by-nc-nd"),
    "cc-by-nc-sa": ("nc-sa|nc sa|commercial", r"(?:cc[ -])?by[ -]nc[ -]sa|creative commons attribution[ -]non-?commercial[ -]share-?alike", r"cc-by-nc-sa-[\d.]+", r"creativecommons\.org/licenses/by-nc-sa"),
    "cc-by-nc": ("by-nc|by nc|commercial", r"cc[ -]by[ -]nc|creative commons attribution[ -]non-?commercial", r"cc-by-nc-[\d.]+", r"creativecommons\.org/licenses/by-nc"),
    "cc-by-nd": ("by-nd|by nd|deriv", r"cc[ -]by[ -]nd|creative commons attribution[ -]no-?derivatives?", r"cc-by-nd-[\d.]+", r"creativecommons\.org/licenses/by-nd"),
    "cc-by-sa": ("by-sa|by sa|share", r"cc[ -]by[ -]sa|creative commons attribution[ -]share-?alike", r"cc-by-sa-[\d.]+", r"creativecommons\.org/licenses/by-sa"),
    "cc-by": ("attribution", r"creative commons attribution", r"cc-by-[\d.]+", r"creativecommons\.org/licenses/by/"),
    "cc0": ("cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-[\d.]+", r"creativecommons\.org/publicdomain/zero"),
    "public-domain": ("public domain", r"(?:released (?:in)?to|placed in|dedicated to) the public domain|public domain dedication", r"pddl-[\d.]+", r"creativecommons\.org/publicdomain/mark"),
    "apache": ("apache", r"apache (?:software )?licen[sc]e,? ?(?:version|v\.?)? ?[\d.]*\d|apache[ -]?(?:v\.? ?|version )?[12]\.[01](?: licen[sc]e)?|apache 2 licen[sc]e|asl ?2\.0", r"apache-[\d.]+", r"apache\.org/licenses"),
    "bsd-2-clause": ("bsd", r"(?:simplified|freebsd|(?:two|2)[ -]clause) bsd(?: licen[sc]e)?|bsd[ -](?:two|2)[ -]clause", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised|(?:three|3)[ -]clause) bsd(?: licen[sc]e)?|bsd[ -](?:three|3)[ -]clause", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    "bsd-4-clause": ("bsd", r"(?:original|(?:four|4)[ -]clause) bsd(?: licen[sc]e)?|bsd[ -](?:four|4)[ -]clause", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    "0bsd": ("0bsd", r"zero[ -]clause bsd(?: licen[sc]e)?", r"0bsd", r"opensource\.org/licenses/0bsd"),
    "bsd": ("bsd", r"bsd(?:-style)? licen[sc]e", r"bsd-source-code", r"opensource\.org/licenses/bsd"),
    "mit": ("mit|expat", r"(?:the )?mit(?:/expat|/x11)? licen[sc]e|expat licen[sc]e", r"mit", r"opensource\.org/licenses/mit"),
    "isc": ("isc|internet systems", r"isc licen[sc]e|internet systems consortium licen[sc]e", r"isc", r"opensource\.org/licenses/isc"),
    "mpl": ("mozilla|mpl", r"mozilla public licen[sc]e|mpl ?v?[12]\.[01]", r"mpl-[\d.]+", r"mozilla\.org/mpl"),
    "epl": ("eclipse", r"eclipse public licen[sc]e", r"epl-[\d.]+", r"eclipse\.org/legal/epl"),
    "edl": ("eclipse", r"eclipse distribution licen[sc]e", r"edl-[\d.]+", r"eclipse\.org/org/documents/edl"),
    "cddl": ("common development", r"common development and distribution licen[sc]e", r"cddl-[\d.]+", r"opensource\.org/licenses/cddl"),
    "cpl": ("common public", r"common public licen[sc]e", r"cpl-[\d.]+", r"opensource\.org/licenses/cpl"),
    "eupl": ("european union", r"european union public licen[sc]e", r"eupl-[\d.]+", r"joinup\.ec\.europa\.eu/\S*eupl"),
    "artistic": ("artistic", r"(?:perl )?artistic licen[sc]e", r"artistic-[\d.]+", r"opensource\.org/licenses/artistic"),
    "boost": ("boost", r"boost software licen[sc]e", r"bsl-1\.0", r"boost\.org/license"),
    "zlib": ("zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"zlib\.net/zlib_license"),
    "unlicense": ("unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    "wtfpl": ("what the f", r"do what the f\S+ you want to public licen[sc]e", r"wtfpl", r"wtfpl\.net"),
    "python": ("python software", r"python software foundation licen[sc]e", r"(?:python|psf)-[\d.]+", r"python\.org/psf/license"),
    "php": ("php", r"php licen[sc]e", r"php-[\d.]+", r"php\.net/license"),
    "ruby": ("ruby", r"ruby licen[sc]e", r"ruby", r"ruby-lang\.org/en/about/license"),
    "openssl": ("openssl", r"openssl licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"postgresql\.org/about/licen[sc]e"),
    "ncsa": ("ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", r"ncsa", r"opensource\.org/licenses/ncsa"),
    "ms-pl": ("microsoft public", r"microsoft public licen[sc]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[sc]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    "osl": ("open software", r"open software licen[sc]e", r"osl-[\d.]+", r"opensource\.org/licenses/osl"),
    "afl": ("academic free", r"academic free licen[sc]e", r"afl-[\d.]+", r"opensource\.org/licenses/afl"),
    "apsl": ("apple public", r"apple public source licen[sc]e", r"apsl-[\d.]+", r"opensource\.apple\.com/license/apsl"),
    "qpl": ("q public", r"q public licen[sc]e", r"qpl-[\d.]+", r"opensource\.org/licenses/qpl"),
    "sleepycat": ("sleepycat", r"sleepycat licen[sc]e", r"sleepycat", r"opensource\.org/licenses/sleepycat"),
    "w3c": ("w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e", r"w3c", r"w3\.org/consortium/legal/\S*software"),
    "vim": ("vim", r"vim licen[sc]e", r"vim", r"vimhelp\.org/uganda"),
    "ofl": ("open font", r"(?:sil )?open font licen[sc]e", r"ofl-[\d.]+", r"scripts\.sil\.org/ofl"),
    "odbl": ("open database", r"open (?:data commons )?(?:open )?database licen[sc]e", r"odbl-[\d.]+", r"opendatacommons\.org/licenses/odbl"),
    "odc-by": ("open data commons attribution", r"open data commons attribution licen[sc]e", r"odc-by-[\d.]+", r"opendatacommons\.org/licenses/by"),
    "cecill": ("cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e", r"cecill-[\d.bc]+", r"cecill\.info"),
    "mulan": ("mulan", r"mulan (?:permissive|public) (?:software )?licen[sc]e", r"mulanpsl-[\d.]+", r"license\.coscl\.org\.cn"),
    "upl": ("universal permissive", r"universal permissive licen[sc]e", r"upl-[\d.]+", r"oss\.oracle\.com/licenses/upl"),
    "blueoak": ("blue oak", r"blue oak model licen[sc]e", r"blueoak-[\d.]+", r"blueoakcouncil\.org/license"),
    "beerware": ("beer", r"beer-?ware licen[sc]e", r"beerware", r"people\.freebsd\.org/~phk"),
    "sspl": ("server side", r"server side public licen[sc]e", r"sspl-[\d.]+", r"mongodb\.com/licensing/server-side-public-license"),
    "busl": ("business source", r"business source licen[sc]e", r"busl-[\d.]+", r"mariadb\.com/bsl"),
    "elastic": ("elastic", r"elastic licen[sc]e", r"elastic-[\d.]+", r"elastic\.co/licensing/elastic-license"),
    "openrail": ("rail", r"(?:bigscience |creativeml )?(?:open )?rail(?:\+\+)?(?:-m)? licen[sc]e", r"openrail(?:-m)?", r"huggingface\.co/spaces/\S*license"),
    "intel": ("intel", r"intel open source licen[sc]e", r"intel", r"opensource\.org/licenses/intel"),
    "ibm": ("ibm", r"ibm public licen[sc]e", r"ipl-[\d.]+", r"opensource\.org/licenses/ibmpl"),
    "nokia": ("nokia", r"nokia open source licen[sc]e", r"nokia", r"opensource\.org/licenses/nokia"),
    "zope": ("zope", r"zope public licen[sc]e", r"zpl-[\d.]+", r"old\.zope\.org/resources/license"),
    "latex": ("latex project", r"latex project public licen[sc]e", r"lppl-[\d.]+", r"latex-project\.org/lppl"),
    "all-rights-reserved": ("all rights reserved", r"all rights reserved", r"licenseref-proprietary", r"example\.invalid/all-rights-reserved"),
}

#: label: (keywords, patterns) of sentences that stand in the licences' own texts and notices.
TEXTS: dict[str, list[tuple[str, str]]] = {
    "mit": [
        ("permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        ("permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ],
    "isc": [("permission to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted")],
    "bsd": [
        ("redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
        ("source code must retain", r"redistributions of source code must retain"),
        ("in binary form must", r"redistributions in binary form must reproduce"),
        ("bsd", r"use of this source code is governed by a bsd-style licen[sc]e"),
    ],
    "bsd-3-clause": [("neither the name", r"neither the names? of .{1,200}? may be used to endorse or promote products derived from this software")],
    "bsd-4-clause": [("advertising materials", r"all advertising materials mentioning features or use of this software must display")],
    "apache": [
        ("except in compliance", r"you may not use this file except in compliance with the licen[sc]e"),
        ("required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e"),
        ("apache software foundation", r"licensed to the apache software foundation \(asf\)"),
        ("contributor license", r"this software consists of voluntary contributions made by many individuals on behalf of the apache"),
    ],
    "gpl": [
        ("gnu general public", r"(?:this program|it|this file|[\w.-]+) is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
        ("gnu general public", r"you should have received a copy of the gnu general public licen[sc]e"),
        ("gpl", r"(?:licen[sc]ed|released|distributed|available|covered|published) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?![\w-])"),
        ("gpl", r"export_symbol_gpl|module_license\( ?[\"']gpl"),
    ],
    "lgpl": [
        ("general public", r"this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
        ("general public", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
        ("lgpl", r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl(?![\w-])"),
    ],
    "agpl": [
        ("affero", r"this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e"),
        ("affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
        ("agpl", r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl(?![\w-])"),
    ],
    "gfdl": [("free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation")],
    "mpl": [
        ("mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
        ("mpl", r"if a copy of the mpl was not distributed with this file"),
        ("mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e"),
        ("incompatible with secondary", r'this source code form is "incompatible with secondary licen[sc]es"'),
    ],
    "epl": [("eclipse", r"(?:the|this program and the) accompanying (?:program|materials) (?:is|are) (?:provided|made available) under the terms of (?:this|the) eclipse public licen[sc]e")],
    "cddl": [("common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e")],
    "zlib": [
        ("as-is", r"this software is provided 'as-is', without any express or implied warranty"),
        ("altered source versions", r"altered source versions must be plainly marked as such"),
        ("origin of this software", r"the origin of this software must not be misrepresented"),
    ],
    "boost": [("boost", r"boost software licen[sc]e - version 1\.0"), ("or organization obtaining", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e")],
    "unlicense": [
        ("unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ],
    "cc0": [("associated a work", r"the person who associated a work with this deed has dedicated the work to the public domain"), ("affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives")],
    "public-domain": [("public domain", r"(?:this (?:file|code|software|work|program)|the author) (?:is|has been|was|hereby) (?:in|put into|placed in|placed into|released into|released to|disclaims copyright to this source code\W+) the public domain"), ("disclaims copyright", r"the author disclaims copyright to this source code")],
    "wtfpl": [("verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document"), ("you just do what", r"you just do what the f\S+ you want to")],
    "artistic": [("may be copied", r"the intent of this document is to state the conditions under which a package may be copied"), ("same terms as perl", r"(?:redistribute it and/or modify it |licensed )under the same terms as perl(?: itself)?")],
    "ofl": [("open font", r"this font software is licensed under the sil open font licen[sc]e"), ("reserved font name", r"with reserved font names?")],
    "ncsa": [("deal with the software", r"to deal with the software without restriction")],
    "postgresql": [("without a written agreement", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted")],
    "beerware": [("buy me a beer", r"you can buy me a beer in return")],
    "sspl": [("functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service")],
    "busl": [("additional use grant", r"additional use grant"), ("change licen", r"change date\W+\S.{0,80}?change licen[sc]e")],
    "elastic": [("hosted or managed", r"you may not provide the software to third parties as a hosted or managed service")],
    "openrail": [("use-based restrictions", r"use-based restrictions as referenced in")],
    "cc-by": [("creative commons attribution", r"this work is licensed under (?:a|the) creative commons attribution(?: [\d.]+)?(?: international| unported| generic)? licen[sc]e")],
    "cc-by-sa": [("sharealike|share-alike|share alike", r"this work is licensed under (?:a|the) creative commons attribution[ -]share-?\s?alike")],
    "odbl": [("open database", r"this .{1,80}? is made available under the open database licen[sc]e")],
    "all-rights-reserved": [("confidential", r"(?:proprietary and confidential|confidential and proprietary)"), ("unauthorized copying", r"unauthori[sz]ed copying of this file, via any medium,? is strictly prohibited")],
    "as-is": [("without warranty", r'the (?:software|program|work|material) is provided "as is",? without warranty of any kind')],
}
#: label: (keywords, pattern) of exceptions to a licence, by name or identifier.
EXCEPTIONS: dict[str, tuple[str, str]] = {
    "classpath-exception": ("classpath", r"classpath[ -]exception(?:-2\.0)?|as a special exception, the copyright holders of this library give you permission to link"),
    "gcc-exception": ("runtime library exception|gcc-exception", r"gcc runtime library exception|gcc-exception-[\d.]+"),
    "llvm-exception": ("llvm", r"llvm[ -]exceptions?|apache-2\.0 with llvm"),
    "autoconf-exception": ("autoconf", r"autoconf[ -](?:configure script )?exception(?:-[\d.]+)?"),
    "bison-exception": ("bison", r"bison[ -]exception(?:-[\d.]+)?"),
    "font-exception": ("font", r"(?:gpl )?font[ -]exception(?:-[\d.]+)?"),
    "linux-syscall-note": ("linux-syscall-note|user programs that use kernel", r"linux-syscall-note|does \*?not\*? cover user programs that use kernel services"),
    "openssl-exception": ("openssl", r"permission to link (?:the code|this program|this software) with the openssl"),
    "commons-clause": ("commons clause", r"commons clause(?: licen[sc]e condition)?"),
}
#: (keywords, pattern) of what is no grant of a licence, although it holds a licence's name.
GUARDS: tuple[tuple[str, str], ...] = (
    ("not licen|not released|not distributed|n't licen|never licen", r"(?:not|n't|never) (?:licen[sc]ed|released|distributed|available) under (?:the |an? )?(?:terms of )?(?:the )?[\w.+-]+(?: [\w.+-]+){0,5} ?licen[sc]e"),
    ("incompatible|compatible", r"(?:in)?compatible with (?:the )?[\w.+-]+(?: [\w.+-]+){0,4} ?licen[sc]e"),
    ("plate", r"(?:[\w-]+ )?licen[sc]e plates?"),
    ("driver|driving", r"(?:driver'?s?|driving) licen[sc]e"),
    ("instead of", r"instead of (?:the )?[\w.+-]+(?: [\w.+-]+){0,4} ?licen[sc]e"),
)
GUARD_PRIORITY, EXCEPTION_PRIORITY = 50, 15
#: Priority and confidence of such a sentence.
TEXT_PRIORITY, TEXT_CONFIDENCE = 35, 0.95

#: kind: (priority, confidence, keyword or the licence's own, pattern around the licence's parts).
KINDS = {
    "spdx": (40, 1.0, "licen", r"{spdx}(?:-only|-or-later|\+)?"),
    "grant": (30, 0.95, None, r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name})"),
    "address": (20, 0.9, None, r"https?://(?:www\.)?{site}\S*"),
    "id": (12, 0.85, None, r"(?<![\w./-])(?:{spdx})(?:-only|-or-later|\+)?(?![\w-]|\.\w)"),
    "name": (10, 0.8, None, r"(?<![\w-])(?:{name})(?![\w-])"),
}
BASE_CONFIDENCE = 0.7
#: A declared licence: the tag of a source file, or a field of a package's description, and an expression of identifiers.
DECLARED = re.compile(r"""(?:spdx-license-identifier|licen[sc]es?)["']?\s*[:=]\s*["']?((?:\(\s*)*[a-z0-9][\w.+-]*(?:(?:\s*\))*\s+(?:and|or|with)\s+(?:\(\s*)*[a-z0-9][\w.+-]*)*)""")
IDENTIFIER = re.compile(r"[a-z0-9][\w.+-]*")
#: Line breaks with the comment marks that start the next line, and wide spaces, count as one space.
SPACING = re.compile(r"[ \t]*\n[ \t]*(?:(?://+|[#*;]+)[ \t]*)?|[ \t]{2,}|\t")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    pattern: re.Pattern[str]


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All signature rules in order of precedence."""
    out = []
    for kind, (priority, confidence, gate, form) in KINDS.items():
        for label, (keyword, name, spdx, site) in LICENSES.items():
            key = site.replace("\\", "").split("/")[0] if "{site}" in form else gate or keyword
            if kind == "id":
                if not re.search(r"[\d-]", spdx.replace(r"\d", "")) and r"\d" not in spdx:
                    continue  # a plain word means a licence only where one is declared
                key = re.match(r"\(?(?:\?:)?([a-z0-9]+)", spdx)[1]
            out.append(Rule(label, tuple(key.split("|")), priority, confidence, re.compile(form.format(name=name, spdx=spdx, site=site))))
    out += [Rule(label, tuple(keyword.split("|")), TEXT_PRIORITY, TEXT_CONFIDENCE, re.compile(pattern)) for label, texts in TEXTS.items() for keyword, pattern in texts]
    out += [Rule(label, tuple(keyword.split("|")), EXCEPTION_PRIORITY, 0.9, re.compile(pattern)) for label, (keyword, pattern) in EXCEPTIONS.items()]
    out += [Rule("", tuple(keyword.split("|")), GUARD_PRIORITY, 0.0, re.compile(pattern)) for keyword, pattern in GUARDS]
    return tuple(out)


@lru_cache(4096)
def declared(identifier: str) -> int | None:
    """The rule of a declared identifier, with its -only, -or-later or +; None for an unknown one."""
    exact = KINDS["spdx"][0]
    return next((k for k, r in enumerate(rules()) if r.priority in (exact, EXCEPTION_PRIORITY) and r.pattern.fullmatch(identifier)), None)


def declarations(flat: str) -> list[tuple[int, int, int]]:
    """Detections of the known identifiers of all declared expressions, joined by AND, OR and WITH."""
    found = []
    for m in DECLARED.finditer(flat):
        for i in IDENTIFIER.finditer(m[1]):
            if (k := declared(i[0].rstrip("."))) is not None:
                found.append((m.start(1) + i.start(), m.start(1) + i.end(), k))
    return found


@lru_cache(1)
def gate() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for k, r in enumerate(rules()):
        for word in r.keywords:
            by.setdefault(word, []).append(k)
    for word, at in by.items():
        auto.add_word(word, at)
    auto.make_automaton()
    return auto


def detect(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of unsuppressed detections in lower-cased text."""
    flat = SPACING.sub(" ", text)
    wanted = sorted({k for _, at in gate().iter(flat) for k in at})
    exact = KINDS["spdx"][0]
    found = [(m.start(), m.end(), k) for k in wanted if rules()[k].priority != exact for m in rules()[k].pattern.finditer(flat)]
    if any(rules()[k].priority == exact for k in wanted):
        found += declarations(flat)
    return [(s, e, rules()[k].label, rules()[k].confidence) for s, e, k in unsuppressed(found, [r.priority for r in rules()]) if rules()[k].label]


def unsuppressed(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Of detections (start, end, rule) those that lie within none that comes first, in order of place.

    One of a higher priority comes first, then a longer one, then the rule of
    the smaller number.  From the highest priority down, the furthest end of
    all that start no later tells whether a detection lies within another.
    """
    if not found:
        return []
    start, end, rule = np.array(sorted(found, key=lambda x: (x[0], -x[1], x[2])), np.int64).T
    level, kept = np.array(priority)[rule], np.zeros(len(start), bool)
    far = np.full(len(start), -1)  # furthest end of higher priorities that start no later
    for one in np.unique(level)[::-1]:
        own = np.flatnonzero(level == one)
        before = np.maximum.accumulate(end[own])
        within = np.append(False, before[:-1] >= end[own][1:]) | (far[own] >= end[own])
        kept[own] = ~within
        ends = np.full(len(start), -1)
        ends[own] = end[own]
        last = np.searchsorted(start, start, side="right") - 1
        far = np.maximum(far, np.maximum.accumulate(ends)[last])
    return [(int(s), int(e), int(k)) for s, e, k in zip(start[kept], end[kept], rule[kept], strict=True)]


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes that separate words become spaces, capitals small.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PHRASES = {f" {p} ".encode(): label for p, label in BASE.items()}


def scan(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a UTF-8 text."""
    text = text or b""
    words = text.translate(FOLD).split()
    flat = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        at = flat.find(phrase)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = flat.find(phrase, at + 1)
    first = flat.count(b" ", 0, min(places)) if places else None
    last = flat.count(b" ", 0, max(places)) if places else None
    found = detect(text.decode(errors="replace").translate(ASCII_LOWER))
    labels = base | {x[2] for x in found}
    miss = 1.0 - BASE_CONFIDENCE if base else 1.0
    for label in {x[2] for x in found}:
        miss *= 1 - max(x[3] for x in found if x[2] == label)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss


def licenses(documents: DataFrame) -> DataFrame:
    """One row for each document: counts of base phrases, labels and a score.

    Whole texts are scanned.  Null and empty texts have no words, no labels
    (empty strings) and score 0.  Equal detections of a label count once;
    repeated rows get equal rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column("t")]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, schema)
