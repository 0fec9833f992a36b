"""Operator 3, license scans by ordered signature rules.

A rule is a regular expression over the normalised words of a text, with a
label, a priority and a keyword without which it cannot match. Keywords are
looked for first, so that most texts never meet an expression. Detections that
overlap are settled by priority and containment: a detection is suppressed by
one that it lies in and that is at least as sure; of equal places the rule that
comes first stays; detections that only partly overlap all stay. An SPDX
expression is read name by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from filmroll.llm.common import documents

#: The phrases every scan reports wherever their words stand together, and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Names of licenses as people write them (regular expressions over lower-case words), and their labels.
NAMES = {
    "apache": r"apache(?: software)?",
    "mit": r"mit",
    "expat": r"expat",
    "bsd": r"(?:(?:new|modified|simplified|original|revised|free|[0234] clause|two clause|three clause) )?bsd",
    "isc": r"isc",
    "zlib": r"zlib(?: libpng)?",
    "mpl": r"mozilla public",
    "epl": r"eclipse public",
    "cddl": r"common development and distribution",
    "cpl": r"common public",
    "eupl": r"european union public",
    "artistic": r"artistic",
    "boost": r"boost software",
    "wtfpl": r"do what the fuck you want to public",
    "unlicense": r"unlicense",
    "python": r"python software foundation",
    "php": r"php",
    "ruby": r"ruby",
    "perl": r"perl",
    "openssl": r"openssl",
    "postgresql": r"postgresql",
    "curl": r"curl",
    "x11": r"x11",
    "ofl": r"(?:sil )?open font",
    "osl": r"open software",
    "afl": r"academic free",
    "ecl": r"educational community",
    "ncsa": r"(?:university of illinois )?ncsa(?: open source)?",
    "odbl": r"open (?:data commons open )?database",
    "odc-by": r"open data commons attribution",
    "pddl": r"public domain dedication and",
    "gfdl": r"(?:gnu )?free documentation",
    "agpl": r"(?:gnu )?affero general public",
    "lgpl": r"(?:gnu )?(?:lesser|library) general public",
    "gpl": r"(?:gnu )?general public",
    "sspl": r"server side public",
    "bsl": r"business source",
    "elastic": r"elastic",
    "ms-pl": r"microsoft public",
    "ms-rl": r"microsoft reciprocal",
    "apsl": r"apple public source",
    "rail": r"(?:open )?responsible ai",
    "upl": r"universal permissive",
    "zpl": r"zope public",
    "w3c": r"w3c software",
    "vim": r"vim",
    "ijg": r"independent jpeg group",
    "oldap": r"openldap public",
    "qpl": r"q public",
    "sleepycat": r"sleepycat",
    "naumen": r"naumen public",
    "nposl": r"non profit open software",
    "cecill": r"cecill(?: [abc])?",
    "mulan": r"mulan (?:psl|permissive software)",
}

#: The ways in which a license is named; {0} stands for the name. Later ones are weaker.
FORMS = (
    (r"spdx license identifier (?:{0})(?: v?[0-9]{{1,2}}){{0,3}}(?: clause)?(?: only| or later)?", 0.99),
    (r"(?:re)?(?:licensed|released|distributed|published|available|provided|used|covered) under (?:the )?(?:terms of )?(?:the )?(?:{0}) licen[cs]e(?: version)?(?: v?[0-9]+){{0,2}}(?: or (?:any )?later(?: version)?)?", 0.97),
    (r"(?:this|the) (?:work|software|program|code|file|project|document|text|material|data)(?: \w+){{0,3}} (?:under|by|to) the (?:{0}) licen[cs]e(?: version)?(?: v?[0-9]+){{0,2}}", 0.95),
    (r"(?:the )?(?:{0}) licen[cs]e(?: version)? v?[0-9]+(?: [0-9]+)?(?: only| or later)?", 0.9),
    (r"(?:the )?(?:{0}) licen[cs]e\b", 0.8),
)

#: Short names beside NAMES that SPDX expressions use, what may follow a name there, and what joins names.
SPDX_NAMES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("gfdl", "gfdl"), ("mpl", "mpl"), ("epl", "epl"), ("cddl", "cddl"), ("eupl", "eupl"), ("boost", "bsl 1 0"), ("ofl", "ofl"), ("cc0", "cc0"), ("cc-by-nc-nd", "cc by nc nd"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc", "cc by nc"), ("cc-by-nd", "cc by nd"), ("cc-by-sa", "cc by sa"), ("cc-by", "cc by"))
SPDX_AFTER = r"(?: v?[0-9]{1,2}){0,3}(?: clause)?(?: only| or later)?(?![^ ])"
SPDX_NEXT = re.compile(r"(?: with (?:\w+ ){1,4}exception(?: [0-9]{1,2}){0,2})? (?:or|and|with) ")

#: Signatures that stand for themselves: label, expression, confidence, keyword.
SIGNATURES = (
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", 0.95, "cc0"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4](?: [05])?)?", 0.97, "cc by"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4](?: [05])?)?", 0.97, "cc by"),
    ("cc-by-nc", r"cc by nc(?: [1-4](?: [05])?)?", 0.96, "cc by"),
    ("cc-by-nd", r"cc by nd(?: [1-4](?: [05])?)?", 0.96, "cc by"),
    ("cc-by-sa", r"cc by sa(?: [1-4](?: [05])?)?", 0.96, "cc by"),
    ("cc-by", r"cc by(?: [1-4](?: [05])?)?", 0.9, "cc by"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv\w*", 0.97, "creative commons"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike", 0.97, "creative commons"),
    ("cc-by-nc", r"creative commons attribution non ?commercial", 0.96, "creative commons"),
    ("cc-by-nd", r"creative commons attribution no ?deriv\w*", 0.96, "creative commons"),
    ("cc-by-sa", r"creative commons attribution share ?alike", 0.96, "creative commons"),
    ("cc-by", r"creative commons attribution", 0.9, "creative commons"),
    ("cc", r"creative commons(?: licen[cs]e)?", 0.7, "creative commons"),
    ("cc-by", r"creativecommons org licenses by [1-4] [05]", 0.98, "creativecommons"),
    ("cc", r"creativecommons org (?:licenses|publicdomain)(?: (?:by|nc|nd|sa|zero|publicdomain))*(?: [1-4] [05])?", 0.9, "creativecommons"),
    ("agpl", r"agpl ?v?3?(?: or later)?", 0.85, "agpl"),
    ("lgpl", r"lgpl ?v?[23]?(?: [01])?(?: or later)?", 0.85, "lgpl"),
    ("gpl", r"(?:gnu )?gpl ?v?[123]?(?: or later)?", 0.8, "gpl"),
    ("apache", r"apache org licenses license 2 0", 0.98, "apache"),
    ("gpl", r"gnu org licenses", 0.85, "gnu"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98, "hereby granted"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", 0.97, "permission to use"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", 0.98, "redistribution"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", 0.95, "as is"),
    ("warranty", r"without warranty of any kind", 0.6, "warranty"),
    ("unlicense", r"free and unencumbered software released into the public domain", 0.98, "unencumbered"),
    ("public-domain", r"(?:released|placed|dedicated)(?: in| into| to) the public domain", 0.9, "public domain"),
    ("public-domain", r"public domain", 0.5, "public domain"),
    ("reserved", r"all rights reserved", 0.8, "reserved"),
    ("reserved", r"todos los derechos reservados", 0.8, "derechos reservados"),
    ("reserved", r"tous droits réservés", 0.8, "droits réservés"),
    ("reserved", r"alle rechte vorbehalten", 0.8, "rechte vorbehalten"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.6, "copyright"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 0.8, "proprietary"),
    ("no-redistribution", r"(?:redistribution|reproduction)(?: \w+){0,4} (?:is )?(?:strictly )?prohibited", 0.8, "prohibited"),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", 0.99, "redistribute it"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.99, "redistribute it"),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.99, "redistribute it"),
    ("gpl", r"either version [123] of the license or at your option any later version", 0.9, "any later version"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", 0.9, "verbatim copies"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.99, "free documentation"),
    ("gfdl", r"with no invariant sections", 0.85, "invariant sections"),
    ("apache", r"licensed under the apache license version 2 0 the license", 0.99, "apache"),
    ("apache", r"you may not use this file except in compliance with the license", 0.9, "in compliance with"),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license", 0.95, "applicable law"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.97, "permission notice"),
    ("mit-0", r"mit no attribution(?: license)?|mit 0 license", 0.95, "mit"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 0.95, "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 0.95, "redistributions"),
    ("bsd", r"neither the name of (?:the )?(?:\w+ ){1,8}nor the names of its contributors may be used to endorse", 0.97, "contributors"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 0.97, "advertising materials"),
    ("bsd-0-clause", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.98, "permission to use"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", 0.93, "permission notice"),
    ("zlib", r"altered source versions must be plainly marked as such", 0.97, "plainly marked"),
    ("zlib", r"the origin of this software must not be misrepresented", 0.97, "misrepresented"),
    ("boost", r"boost org license 1 0 txt", 0.98, "boost org"),
    ("boost", r"use reproduce display distribute execute and transmit the software", 0.97, "transmit the software"),
    ("mpl", r"subject to the terms of the mozilla public license v ?(?:1 1|2 0)", 0.99, "mozilla public"),
    ("mpl", r"if a copy of the mpl was not distributed with this file", 0.98, "copy of the mpl"),
    ("mpl", r"mozilla org mpl 2 0", 0.97, "mozilla org"),
    ("epl", r"eclipse org legal epl v ?(?:10|20|1 0|2 0)", 0.97, "eclipse org"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.99, "eclipse public"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 0.99, "common development"),
    ("cpl", r"made available under the terms of the common public license", 0.97, "common public"),
    ("eupl", r"licensed under the eupl(?: version)? ?v?1 [012]", 0.98, "eupl"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 0.97, "package may be copied"),
    ("perl", r"under the same terms as perl(?: itself)?", 0.95, "as perl"),
    ("ruby", r"under the same terms as ruby(?: itself)?", 0.95, "as ruby"),
    ("python", r"psf license agreement(?: for python)?", 0.95, "psf license"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.98, "anyone is free"),
    ("wtfpl", r"you just do what the fuck you want to", 0.98, "what the fuck"),
    ("beerware", r"beer ?ware(?: license)?", 0.9, "beer"),
    ("beerware", r"you can buy me a beer in return", 0.97, "buy me a beer"),
    ("json", r"the software shall be used for good not evil", 0.98, "not evil"),
    ("ofl", r"with reserved font name", 0.93, "reserved font"),
    ("ofl", r"scripts sil org ofl", 0.97, "sil org"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 0.98, "written agreement"),
    ("openssl", r"this product includes software developed by the openssl project", 0.97, "openssl project"),
    ("php", r"this product includes php software freely available", 0.97, "php software"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided", 0.93, "permission to use"),
    ("x11", r"except as contained in this notice the name of (?:the )?(?:\w+ ){1,6}shall not be used in advertising", 0.97, "used in advertising"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", 0.98, "independent jpeg"),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", 0.99, "deal with the software"),
    ("odbl", r"opendatacommons org licenses odbl", 0.98, "opendatacommons"),
    ("odc-by", r"opendatacommons org licenses by", 0.98, "opendatacommons"),
    ("pddl", r"opendatacommons org licenses pddl", 0.98, "opendatacommons"),
    ("cc0", r"creativecommons org publicdomain zero 1 0", 0.99, "creativecommons"),
    ("public-domain", r"creativecommons org publicdomain mark 1 0", 0.97, "creativecommons"),
    ("cc-by-sa", r"creativecommons org licenses by sa [1-4] [05]", 0.99, "creativecommons"),
    ("cc-by-nc", r"creativecommons org licenses by nc [1-4] [05]", 0.99, "creativecommons"),
    ("cc-by-nd", r"creativecommons org licenses by nd [1-4] [05]", 0.99, "creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1-4] [05]", 0.99, "creativecommons"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1-4] [05]", 0.99, "creativecommons"),
    ("cc0", r"waived all copyright and related or neighboring rights", 0.97, "neighboring rights"),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license", 0.99, "creative commons"),
    ("sspl", r"mongodb com licensing server side public license", 0.98, "mongodb com"),
    ("elastic", r"elastic license (?:2 0|v2)", 0.97, "elastic license"),
    ("bsl", r"(?:business source license|busl) 1 1", 0.98, "1 1"),
    ("bsl", r"change date (?:\w+ ){1,6}change license", 0.9, "change license"),
    ("commons-clause", r"commons clause(?: license condition)?", 0.93, "commons clause"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use)(?: license)?", 0.95, "polyform"),
    ("rail", r"creativeml open rail(?: m)?", 0.97, "creativeml"),
    ("rail", r"bigscience (?:bloom )?(?:open )?rail(?: m)?(?: license)?", 0.97, "bigscience"),
    ("llama", r"llama (?:2|3|3 [123]) community license", 0.97, "community license"),
    ("gemma", r"gemma (?:terms of use|license)", 0.9, "gemma"),
    ("ms-pl", r"microsoft public license ms pl", 0.98, "ms pl"),
    ("cecill", r"governed by the cecill(?: [bc])? license", 0.97, "cecill"),
    ("mulan", r"licensed under mulan psl v[12]", 0.98, "mulan psl"),
    ("anti-996", r"anti 996 license", 0.97, "anti 996"),
    ("hippocratic", r"hippocratic license", 0.95, "hippocratic"),
    ("bittorrent", r"bittorrent open source license", 0.95, "bittorrent"),
    ("intel", r"intel (?:open source|simplified software) license", 0.93, "intel"),
    ("nasa", r"nasa open source agreement", 0.95, "nasa"),
    ("ogl", r"open government licen[cs]e(?: v?[1-3](?: 0)?)?", 0.95, "open government"),
    ("ogl", r"contains public sector information licensed under the open government licen[cs]e", 0.99, "public sector information"),
    ("crown", r"crown copyright", 0.85, "crown copyright"),
    ("etalab", r"licence ouverte(?: open licen[cs]e)?(?: etalab)?", 0.93, "licence ouverte"),
    ("dl-de", r"datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?", 0.95, "datenlizenz"),
    ("public-domain", r"no rights reserved", 0.85, "rights reserved"),
    ("reserved", r"some rights reserved", 0.7, "rights reserved"),
    ("public-domain", r"this work is (?:now )?in the public domain", 0.93, "public domain"),
    ("public-domain", r"public domain mark(?: 1 0)?", 0.93, "public domain"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \w+){0,12} (?:is )?strictly prohibited", 0.9, "prohibited"),
    ("proprietary", r"this (?:software|document|file|information) is (?:the )?(?:confidential|proprietary)", 0.85, "this"),
    ("proprietary", r"end user license agreement", 0.85, "end user license"),
    ("proprietary", r"trade secrets? of", 0.7, "trade secret"),
    ("no-redistribution", r"may not be (?:copied |reproduced |redistributed |republished |published |broadcast |rewritten |or ){1,8}(?:without|in any form)", 0.85, "may not be"),
    ("no-redistribution", r"no part of this (?:publication|book|work|document) may be reproduced", 0.93, "may be reproduced"),
    ("no-derivatives", r"no derivative works", 0.7, "derivative works"),
    ("non-commercial", r"for (?:personal (?:and|or) )?non ?commercial use only", 0.85, "commercial use only"),
    ("non-commercial", r"not for commercial use", 0.85, "for commercial use"),
    ("research-only", r"for (?:academic |scientific )?research purposes only", 0.85, "research purposes"),
    ("attribution", r"attribution required", 0.6, "attribution required"),
    ("reserved", r"tutti i diritti riservati", 0.8, "diritti riservati"),
    ("reserved", r"todos os direitos reservados", 0.8, "direitos reservados"),
    ("reserved", r"alle rechten voorbehouden", 0.8, "rechten voorbehouden"),
    ("reserved", r"wszelkie prawa zastrzeżone", 0.8, "prawa zastrzeżone"),
    ("copyright", r"copr (?:19|20)[0-9]{2}", 0.5, "copr"),
    ("copyright", r"© (?:copyright )?(?:19|20)[0-9]{2}", 0.7, "© "),
    ("copyright", r"©19[0-9]{2}", 0.7, "©1"),
    ("copyright", r"©20[0-9]{2}", 0.7, "©2"),
    ("copyright", r"copyright (?:and )?(?:database )?rights? (?:\w+ ){0,4}(?:19|20)[0-9]{2}", 0.6, "copyright"),
)


@dataclass(frozen=True)
class Rule:
    """A signature; lower ``priority`` wins."""

    label: str
    pattern: re.Pattern
    confidence: float
    keyword: str
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: the signatures written out and every name in every form."""
    found = [(label, p, c, k) for label, p, c, k in SIGNATURES]
    for label, name in NAMES.items():
        key = max(re.findall(r"[a-z0-9]{2,}", re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)\??", "|", name)) or [""], key=len)
        found += [(label, form.format(name), c, key) for form, c in FORMS]
    ordered = sorted(found, key=lambda x: -x[2])
    return tuple(Rule(label, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])"), c, k, i) for i, (label, p, c, k) in enumerate(ordered))


#: Words of which a text must hold one before any rule is tried.
ANCHORS = ("licen", "copyright", "reserved", "domain", "warranty", "cc0", "cc by", "gpl", "creative", "redistribut", "permission", "gnu org", "proprietary", "prohibited", "derechos reservados", "droits réservés", "rechte vorbehalten", "unencumbered", "as is", "applicable law", "permitted to copy", "any later version", "invariant sections", "contributors", "advertising", "plainly marked", "misrepresented", "boost org", "the software", "copy of the mpl", "mozilla org", "eclipse org", "eupl", "as perl", "as ruby", "anyone is free", "what the fuck", "beer", "not evil", "font name", "sil org", "openssl project", "php software", "independent jpeg", "opendatacommons", "neighboring rights", "busl", "commons clause", "polyform", "bigscience", "gemma", "mulan psl", "nasa open", "datenlizenz", "package may be copied", "confidential", "trade secret", "may not be", "may be reproduced", "derivative works", "commercial use", "research purposes", "attribution required", "diritti riservati", "direitos reservados", "rechten voorbehouden", "prawa zastrzeżone", "copr", "©", "mit no attribution")

_SEPARATE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """The words of ``text`` (letters, digits and anything beyond ASCII; A-Z as a-z), one space between them."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split())


def places(words: bytes, phrase: bytes) -> list[int]:
    """Byte offsets at which the phrase's words stand, overlaps included."""
    found, at = [], words.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
            found.append(at)
        at = words.find(phrase, at + 1)
    return found


@lru_cache(maxsize=1)
def spdx_rules() -> tuple[Rule, ...]:
    """A rule for each name that an SPDX expression may hold."""
    return tuple(Rule(label, re.compile(rf"(?:{name}){SPDX_AFTER}"), FORMS[0][1], "spdx", -1) for label, name in (*SPDX_NAMES, *NAMES.items()))


def spdx(words: str) -> list[tuple[int, int, Rule]]:
    """Detections of the names in every SPDX expression; the first takes in the words before it."""
    found = []
    for head in re.finditer(r"(?<![^ ])spdx license identifier ", words):
        start, at = head.span()
        while at is not None:
            matches = [(m.end(), rule) for rule in spdx_rules() if (m := rule.pattern.match(words, at))]
            if not matches:
                break
            end, rule = max(matches, key=lambda x: x[0])
            found.append((start, end, rule))
            then = SPDX_NEXT.match(words, end)
            start = at = then and then.end()
    return found


def detect(words: str) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that survive, in order of place."""
    if not any(a in words for a in ANCHORS):
        return []
    found = spdx(words)
    for rule in rules():
        if rule.keyword in words:
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(words)]
    return survivors(found)


def survivors(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that lie in no other one that is at least as sure; of equal places the first rule's.

    In order of start, longest first, a detection lies in an earlier one exactly
    if that one's end is not before its own, so the largest end so far of each
    confidence tells.
    """
    ends: dict[float, int] = {}
    kept = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2].confidence, d[2].priority)):
        if not any(end >= d[1] for c, end in ends.items() if c >= d[2].confidence):
            kept.append(d)
            ends[d[2].confidence] = d[1]
    return kept


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = normalise(text or "")
    index = lambda at: words.count(b" ", 0, at)
    base = [(at, label) for phrase, label in BASE_PHRASES for at in places(words, phrase.encode())]
    base_labels = sorted({label for _, label in base})
    seen = detect(words.decode("utf-8", "surrogatepass"))
    doubt = 1.0
    for c in {r.label: r.confidence for _, _, r in sorted(seen, key=lambda d: d[2].confidence)}.values():
        doubt *= 1 - c
    if base:
        doubt = min(doubt, 0.5)
    labels = sorted({*base_labels, *(r.label for _, _, r in seen)})
    at = [at for at, _ in base]
    return (words.count(b" ") + 1 if words else 0, len(base), index(min(at)) if at else None, index(max(at)) if at else None, ",".join(base_labels), ",".join(labels), round(1 - doubt, 6))


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License labels of every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no words, no labels and score 0. A text is read
    once, whole, however long: rules have bounded repeats, so time follows the
    length. Repeated rows each get a row; an empty table gives none.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(scan_text, batch.column("text").to_pylist()), strict=True)) or [()] * len(TYPES)
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, TYPES, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE_SQL: dict[str, str] = {}
