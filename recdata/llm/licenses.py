"""License scans by ordered signature rules.

A text is brought to words (see `normal`), so that rules need not care for
case, punctuation or line breaks. A rule is a regular expression over words
with keywords, one of which stands in every match: rules without a keyword in
the text are never run. Rules are ordered, the most telling first; a detection
that lies within the interval of an earlier rule's is suppressed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import kind_of, map_rows, slices

#: Bytes that are not part of a word become blanks, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licenses with label, SPDX identifier, names and versions as expressions over words, and keywords
# of which every match of a name has one. Where one name holds another, the longer stands first.
FAMILIES = (
    ("0bsd", "0bsd", "zero clause bsd|bsd zero clause|0bsd", "", "bsd 0bsd"),
    ("afl", "afl", "academic free", r"[123](?: [012])?", "academic"),
    ("agpl", "agpl", "(?:gnu )?affero (?:general public|gpl)|(?:gnu )?agpl(?:v3)?", "[13](?: 0)?", "affero agpl agplv3"),
    ("apache", "apache", "apache(?: software)?", r"[12](?: [01])?", "apache"),
    ("apsl", "apsl", "apple public source", r"[12](?: [012])?", "apple"),
    ("artistic", "artistic", "(?:perl )?(?:clarified )?artistic", r"[12](?: 0)?", "artistic"),
    ("beerware", "beerware", "beer ?ware", "", "beerware beer"),
    ("blueoak", "blueoak", "blue oak model", "1(?: 0(?: 0)?)?", "oak"),
    ("bsd", "bsd", r"(?:(?:new|modified|revised|simplified|original|free) )?(?:[1234] clause )?(?:berkeley software distribution|bsd)(?: [1234] clause)?(?: style)?", "", "bsd berkeley"),
    ("bsl", "bsl", "boost(?: software)?", "1(?: 0)?", "boost"),
    ("busl", "busl", "business source", r"1(?: [01])?", "business"),
    ("catosl", "catosl", "computer associates trusted open source", r"1(?: [01])?", "associates"),
    ("cc0", "cc0", "cc0|cc zero|creative commons zero(?: universal)?", "1(?: 0)?", "cc0 zero"),
    ("cddl", "cddl", "common development and distribution|cddl", r"1(?: [01])?", "development cddl"),
    ("cecill", "cecill", "cecill(?: [bc])?", r"[12](?: [01])?", "cecill"),
    ("cpal", "cpal", "common public attribution|cpal", "1(?: 0)?", "attribution cpal"),
    ("cpl", "cpl", "common public|ibm public", "1(?: 0)?", "common ibm"),
    ("ecl", "ecl", "educational community", r"[12](?: 0)?", "educational"),
    ("efl", "efl", "eiffel forum", r"[12](?: 0)?", "eiffel"),
    ("elastic", "elastic", "elastic", r"[12](?: 0)?", "elastic"),
    ("epl", "epl", "eclipse(?: public)?|epl", r"[12](?: 0)?", "eclipse epl"),
    ("eupl", "eupl", "european union public|eupl", r"1(?: [012])?", "european eupl"),
    ("fair", "fair", "fair source", "", "fair"),
    ("fdl", "gfdl", "(?:gnu )?free documentation|gnu fdl|gfdl", r"1(?: [123])?", "documentation fdl gfdl"),
    ("ftl", "ftl", "freetype(?: project)?", "", "freetype"),
    ("lgpl", "lgpl", "(?:gnu )?(?:lesser|library) (?:general public|gpl)|(?:gnu )?lgpl(?:v[23])?", r"[23](?: [01])?", "lesser library lgpl lgplv2 lgplv3"),
    ("gpl", "gpl", "(?:gnu )?general public|(?:gnu )?gpl(?:v[123])?", r"[123](?: 0)?", "general gpl gplv1 gplv2 gplv3"),
    ("hpnd", "hpnd", "historical permission notice and disclaimer", "", "historical"),
    ("icu", "icu", "icu|unicode(?: data files and software)?", "", "icu unicode"),
    ("ijg", "ijg", "independent jpeg group", "", "jpeg"),
    ("isc", "isc", "isc|internet systems consortium", "", "isc consortium"),
    ("json", "json", "json", "", "json"),
    ("libpng", "libpng", "libpng|png reference library", r"[12](?: 0)?", "libpng png"),
    ("lppl", "lppl", "latex project public|lppl", r"1(?: [0123]c?)?", "latex lppl"),
    ("mit-0", "mit 0", "mit no attribution|mit 0", "", "mit"),
    ("mit", "mit", "mit(?: style| x11| expat)?|x11|expat", "", "mit x11 expat"),
    ("mpl", "mpl", "mozilla(?: public)?|mpl", r"[12](?: [01])?", "mozilla mpl"),
    ("ms-pl", "ms pl", "microsoft public|ms pl", "", "microsoft ms"),
    ("ms-rl", "ms rl", "microsoft reciprocal|ms rl", "", "microsoft ms"),
    ("mulan", "mulanpsl", "mulan(?: permissive software| psl)", r"[12](?: 0)?", "mulan"),
    ("nasa", "nasa", "nasa open source", r"1(?: 3)?", "nasa"),
    ("ncsa", "ncsa", "university of illinois(?: ncsa)?(?: open source)?|ncsa", "", "illinois ncsa"),
    ("npl", "npl", "netscape public", r"1(?: [01])?", "netscape"),
    ("odbl", "odbl", "(?:open data commons )?open database|odbl", "1(?: 0)?", "database odbl"),
    ("odc-by", "odc by", "open data commons attribution|odc by", "1(?: 0)?", "attribution odc"),
    ("ofl", "ofl", "(?:sil )?open font|sil ofl", r"1(?: [01])?", "font ofl"),
    ("ogl", "ogl", "open government", r"[123](?: 0)?", "government"),
    ("openssl", "openssl", "openssl|ssleay", "", "openssl ssleay"),
    ("osl", "osl", "open software", r"[123](?: [01])?", "open"),
    ("pddl", "pddl", "public domain dedication(?: and)?|pddl", "1(?: 0)?", "dedication pddl"),
    ("php", "php", "php", r"[23](?: 0[01]?)?", "php"),
    ("postgresql", "postgresql", "postgresql", "", "postgresql"),
    ("psf", "psf|python", "python software foundation|psf", r"[123](?: [0-9])?", "python psf"),
    ("qpl", "qpl", "q public", "1(?: 0)?", "q"),
    ("ruby", "ruby", "ruby", "", "ruby"),
    ("sleepycat", "sleepycat", "sleepycat(?: public)?", "", "sleepycat"),
    ("sspl", "sspl", "server side public|sspl", "1(?: 0)?", "server sspl"),
    ("unlicense", "unlicense", "the unlicense", "", "unlicense"),
    ("upl", "upl", "universal permissive", "1(?: 0)?", "universal"),
    ("vim", "vim", "vim", "", "vim"),
    ("w3c", "w3c", "w3c(?: software(?: notice and)?)?", "", "w3c"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public|wtfpl", "2(?: 0)?", "fuck wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?", "", "zlib"),
    ("zpl", "zpl", "zope public", r"[12](?: [01])?", "zope"),
)

# Notices, addresses and sentences of license texts: label, expression, keywords of which each match has one.
NOTICES = (
    ("agpl", "published by the free software foundation either version [0-9] of the gnu affero", "affero"),
    ("agpl", "gnu org licenses agpl(?: [0-9](?: 0)?)?", "agpl"),
    ("apache", "apache org licenses(?: license)?(?: 2 0)?", "apache"),
    ("apache", "you may not use this file except in compliance with the license", "compliance"),
    ("apache", "this product includes software developed (?:at|by) the apache software foundation", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistributions? (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", "redistributions redistribution"),
    ("bsd", "neither the names? of .{1,80}? may be used to endorse or promote products derived from", "endorse"),
    ("bsl", "boost org license 1 0", "boost"),
    ("cc-by-nc-nd", "(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "attribution"),
    ("cc-by-nc-nd", "cc by nc nd", "cc"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons"),
    ("cc-by-nc-sa", "(?:creative commons )?attribution non ?commercial share ?alike", "attribution"),
    ("cc-by-nc-sa", "cc by nc sa", "cc"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "commons"),
    ("cc-by-nc", "cc by nc", "cc"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?", "commons"),
    ("cc-by-nd", "cc by nd", "cc"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons"),
    ("cc-by-sa", "creative commons attribution share ?alike", "commons"),
    ("cc-by-sa", "cc by sa", "cc"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons"),
    ("cc-by", "creativecommons org licenses by", "creativecommons"),
    ("cc-by", "creative commons attribution(?: [1234] [05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?", "commons"),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons"),
    ("epl", "eclipse org legal epl v[12]0", "eclipse"),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "documentation"),
    ("gpl", "this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public", "redistribute"),
    ("gpl", "gnu org licenses gpl(?: [0-9](?: 0)?)?", "gpl"),
    ("gpl", "either version [123] of the license or at your option any later version", "option"),
    ("gpl", "free software foundation inc (?:51|59|675) (?:franklin|temple|mass)", "foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public", "lesser library"),
    ("lgpl", "gnu org licenses lgpl(?: [0-9](?: [01])?)?", "lgpl"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial"),
    ("mit", "opensource org licenses mit", "opensource"),
    ("mpl", "this source code form is subject to the terms of the mozilla public", "mozilla"),
    ("mpl", "mozilla org mpl [12] [01]", "mozilla"),
    ("ofl", "scripts sil org ofl", "ofl"),
    ("openssl", "this product includes (?:cryptographic )?software (?:developed|written) by (?:the openssl project|eric young)", "openssl eric"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution) .{1,60}? (?:strictly )?prohibited", "unauthorized unauthorised"),
    ("public-domain", "(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain", "domain"),
    ("reserved", "alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|tutti i diritti riservati", "rechte droits derechos diritti"),
    ("reserved", "no part of this (?:publication|book|work|document) may be reproduced", "reproduced"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "unlicense org", "unlicense"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "verbatim"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable"),
    ("zlib", "altered source versions must be plainly marked as such", "altered"),
)

_SUFFIX = "(?: licen[sc]es?| lizenz| licencia)"
_GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered|redistributed|lizenziert|publicado|publié)"
_BARE = "(?: (?:under|unter|bajo|sous))(?: (?:the|a|an|der|la|le))?(?: terms of(?: the)?)?"
_UNDER = "(?: (?:under|by|with|unter|bajo|sous))(?: (?:the|a|an|der|la|le))?(?: terms of(?: the)?)?"
#: How sure a detection of a kind is, of 1; kinds stand in the order of their rules.
CERTAINTY = {"identifier": 0.99, "notice": 0.95, "grant": 0.9, "versioned": 0.8, "name": 0.6, "phrase": 0.5}


@dataclass(frozen=True)
class Rule:
    """One signature: the lower its order, the stronger."""

    order: int
    label: str
    kind: str
    keywords: frozenset[bytes]
    pattern: re.Pattern[bytes]


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All signatures in their order: identifiers, notices, grants, names with a version, names."""
    made: dict[str, list[tuple[str, str, str]]] = {kind: [] for kind in CERTAINTY}
    for label, spdx, names, version, keywords in FAMILIES:
        numbered = f"(?: (?:version |v )?v?(?:{version}))" if version else ""
        named = f"(?:{names})" + (f"(?:{_SUFFIX}{numbered}?|{numbered}{_SUFFIX}?)" if numbered else _SUFFIX)
        made["identifier"].append((label, f"spdx licen[sc]e identifier (?:{spdx})(?: [0-9]+)*(?: (?:only|or later|clause))?", "spdx"))
        made["grant"].append((label, f"{_GRANT}(?:{_UNDER} {named}|{_BARE} (?:{names}))", keywords))
        if numbered:
            made["versioned"].append((label, f"(?:{names}){_SUFFIX}?(?: version v?| v ?)(?:{version})", keywords))
        made["name"].append((label, f"(?:{names}){_SUFFIX}", keywords))
    made["notice"].extend(NOTICES)
    listed = [(kind, *rule) for kind, some in made.items() for rule in some]
    return tuple(Rule(k, label, kind, frozenset(w.encode() for w in words.split()), re.compile(b"(?<= )(?:" + expression.encode() + b")(?= )")) for k, (kind, label, expression, words) in enumerate(listed))


@functools.cache
def _gate() -> dict[bytes, tuple[int, ...]]:
    """The rules of each keyword."""
    found: dict[bytes, list[int]] = {}
    for rule in rules():
        for word in rule.keywords:
            found.setdefault(word, []).append(rule.order)
    return {word: tuple(orders) for word, orders in found.items()}


def normal(text: str) -> tuple[bytes, list[bytes]]:
    """(the words of a text with one blank around each, the words): A-Z in lower case, words of 0-9, a-z and all characters beyond ASCII."""
    words = text.encode().translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", words


def phrase_places(words: bytes, phrase: str) -> list[int]:
    """Where the words of a phrase stand one after the other, overlaps included, as places in the normal form."""
    wanted, found = f" {phrase} ".encode(), []
    at = words.find(wanted)
    while at >= 0:
        found.append(at + 1)
        at = words.find(wanted, at + 1)
    return found


def unsuppressed(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of detections (start, end, order of the rule) those that lie within no detection of an earlier rule, by start.

    Starts ascend and, for equal starts, ends descend, so whatever holds a
    detection comes before it: what counts is how far each rule has reached.
    """
    reach = np.full(len(rules()) + 1, -1, np.int64)
    left = []
    for start, end, order in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not order or reach[:order].max() < end:
            left.append((start, end, order))
        reach[order] = max(reach[order], end)
    return left


def scan_text(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """(number of words, base places with their labels, detections left with first word, word after the last, rule)."""
    joined, words = normal(text)
    base = [(at, label) for phrase, label in PHRASES.items() for at in phrase_places(joined, phrase)]
    gate, signatures = _gate(), rules()
    some = {order for word in gate.keys() & set(words) for order in gate[word]}
    found = [(m.start(), m.end(), order) for order in some for m in signatures[order].pattern.finditer(joined)]
    if not base and not found:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)  # the blank before each word
    word = lambda at: int(np.searchsorted(blanks, at)) - 1
    return len(words), sorted((word(at), label) for at, label in base), [(word(start), word(end) + 1, signatures[order]) for start, end, order in unsuppressed(found)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: what licenses its whole text names.

    Returns (id, n_words, base_starts and base_labels: place and label of each
    base phrase, by place; labels, kinds, starts and ends: each detection left,
    by place, its words from start to before end; score: the certainty of the
    surest, 0 without any). Base phrases stay whatever else is found. A null
    text counts as empty and has no detections; rows are judged one by one, so
    repeated rows share a result, null ids make no difference, an empty table
    gives an empty result, and other columns are not read. Time grows with the
    length of a text times the rules whose keywords it has. Nothing is shuffled.
    """
    fields = {id_col: kind_of(df, id_col), "n_words": "long", "base_starts": "array<bigint>", "base_labels": "array<string>", "labels": "array<string>", "kinds": "array<string>", "starts": "array<bigint>", "ends": "array<bigint>", "score": "double"}

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for keys, texts in batches:
            texts = [t or "" for t in texts]
            for part in slices(texts, 1 << 22):
                out = []
                for key, text in zip(keys[part], texts[part], strict=True):
                    n, base, found = scan_text(text)
                    score = max([CERTAINTY[rule.kind] for _, _, rule in found] + [CERTAINTY["phrase"]] * bool(base), default=0.0)
                    out.append((key, n, [b[0] for b in base], [b[1] for b in base], [r.label for _, _, r in found], [r.kind for _, _, r in found], [f[0] for f in found], [f[1] for f in found], score))
                yield dict(zip(fields, zip(*out, strict=True), strict=True))

    return map_rows(df, [id_col, text_col], rows, fields)
