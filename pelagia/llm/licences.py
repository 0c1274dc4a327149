"""Licences in texts, recognised sentence by sentence.

A text is cut into sentences at line ends, and after full stops, semicolons and the like before white space; a piece that
begins a known sentence is also tried together with the pieces after it, as long as all of it is a beginning of one. A sentence is normalised (small letters, plain words, one spelling of
"license") and mapped to the identifier of a known licence sentence: either a grant ("licensed under the X") whose
name is looked up among licence names, or one of the sentences of licence texts, of which some end in free words. Identifiers
are then matched against ordered rules: a rule's identifiers must come in its order, with at most ``gap`` other
whole sentences between the end of one and the start of the next; lines of a paragraph are one sentence up to a stop, and pieces without letters none. Of the rules that match from a place the one with the most identifiers wins, and its sentences are used up.

Offsets are code points, ends exclusive. Sentences that speak of a license but have no identifier are counted as
unknown. Null and empty texts have no sentences. Repeated rows are rows of their own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = 3

# --- fixed values: licence names and sentences, normalised -------------------------------------
NAMES = {
    "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0", "apache-2.0": "Apache-2.0",
    "mit license": "MIT", "mit": "MIT", "expat license": "MIT", "isc license": "ISC", "unlicense": "Unlicense", "zlib license": "Zlib",
    "bsd 2-clause license": "BSD-2-Clause", "bsd-2-clause": "BSD-2-Clause", "bsd 3-clause license": "BSD-3-Clause", "bsd-3-clause": "BSD-3-Clause",
    "gnu general public license version 2": "GPL-2.0", "gpl version 2": "GPL-2.0", "gplv2": "GPL-2.0", "gpl-2.0": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0", "gpl version 3": "GPL-3.0", "gplv3": "GPL-3.0", "gpl-3.0": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1", "lgpl-2.1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "lgpl-3.0": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0", "agpl-3.0": "AGPL-3.0", "mozilla public license version 2.0": "MPL-2.0", "mpl-2.0": "MPL-2.0",
    "eclipse public license version 2.0": "EPL-2.0", "epl-2.0": "EPL-2.0", "boost software license version 1.0": "BSL-1.0",
    "cc by 4.0": "CC-BY-4.0", "cc-by-4.0": "CC-BY-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc by-nd 4.0": "CC-BY-ND-4.0", "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc0 1.0": "CC0-1.0", "cc0": "CC0-1.0",
    "creative commons attribution 4.0 international license": "CC-BY-4.0", "creative commons attribution-sharealike 4.0 international license": "CC-BY-SA-4.0",
    "creative commons attribution-noncommercial 4.0 international license": "CC-BY-NC-4.0",
}
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "the software is provided as is and the author disclaims all warranties": "isc-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of": "bsd-name",
    "this software is provided by the copyright holders and contributors as is": "bsd-warranty",
    "you may not use this file except in compliance with the license": "apache-condition",
    "you may obtain a copy of the license at": "apache-place",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-warranty",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license": "gpl3-grant",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
}
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant", "isc-warranty")), ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("named:Apache-2.0", "apache-condition", "apache-place", "apache-warranty")), ("Apache-2.0", ("named:Apache-2.0", "apache-condition", "apache-place")),
    ("GPL-3.0", ("gpl3-grant", "gpl-warranty")), ("GPL-3.0", ("gpl3-grant",)), ("GPL-2.0", ("gpl2-grant", "gpl-warranty")), ("GPL-2.0", ("gpl2-grant",)),
    ("Unlicense", ("unlicense-grant",)),
]
# --- end of fixed values ----------------------------------------------------------------------
RULES = RULES + [(name, (f"named:{name}",)) for name in sorted(set(NAMES.values()))]
_CUT = re.compile(r"\n+|(?<=[.!?;:])[ \t]+")
_LETTER = re.compile(r"[^\W\d_]")
_STOP = re.compile(r"[.!?;:]\s*\Z")
_TALKS = re.compile(r"licen[cs]e|\bspdx\b|permission|redistribut|warrant|free software|unencumbered|neither the name of|compliance with", re.I)
#: One of these, in small letters, is in every ASCII text that the pattern above is found in.
_ANCHORS = ("licen", "spdx", "permission", "redistribut", "warrant", "free software", "unencumbered", "neither the name of", "compliance with")
_GRANT = re.compile(r"^(?:(?:this|the|our|all) )?(?:[a-z]+ ){0,2}?(?:is |are )?(?:also |dual )?(?:licensed|released|distributed|available|published|provided)(?: only)? under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?(.+)$")
_SPDX = re.compile(r"^spdx-license-identifier (.+)$")
_DEFINED = re.compile(r" (?:the|this) license$")
_LATER_FIRST = re.compile(r"^(?:only|or (?:at your option )?(?:any )?later(?: version)?)(?: |$)")
_SURE = re.compile(r"[0-9]|license")
_FURTHER = re.compile(r"(?:or|and|with)(?: |$)")
_BEFORE_UNDER = re.compile(r"(?:[a-z]+ ){0,6}[a-z]+")
_UNDER = re.compile(r"(?:[a-z]+ ){1,7}?under(?: (.+))?$")
#: All proper beginnings, by words, of the known sentences and of what stands after "under" in a grant.
BEGINNINGS = {" ".join(words[:n]) for words in map(str.split, SENTENCES) for n in range(1, len(words))}
_GRANTED = [f"{a}{b}{c}{name}".split() for a in ("", "the ") for b in ("", "terms of ", "terms of the ") for c in ("", "conditions of ", "conditions of the ") for name in NAMES]
GRANT_BEGINNINGS = {" ".join(words[:n]) for words in _GRANTED for n in range(1, len(words))}
LONGEST_NAME = max(len(name.split()) for name in NAMES)
_LATER = re.compile(r" (?:only|or (?:at your option )?(?:any )?later(?: version)?)$")


_NO_WORD = re.compile(r"[^\w./+-]+")
_LOOSE = re.compile(r"(?<![0-9])[.](?![0-9])|[.](?![0-9])|\B[/+-]|[/+-]\B")
#: The known sentences by their first words.
BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _known, _name in SENTENCES.items():
    BY_FIRST.setdefault(_known.split(" ", 1)[0], []).append((_known, _name))


def normal_form(sentence: str) -> str:
    text = sentence.lower().replace("licence", "license")
    text = _NO_WORD.sub(" ", text).rstrip(" .")
    if "." in text or "/" in text or "+" in text or "-" in text:
        text = _LOOSE.sub(" ", text)
    return " ".join(text.split())


def licence_name(words: str) -> str | None:
    """The licence whose name is all of the words, or the longest name that they begin with. "mit" and other names without a version
    or the word license must be all; further licences or exceptions after "or", "and" or "with" aren't guessed."""
    words = _DEFINED.sub("", words)
    name = _LATER.sub("", words).removesuffix(" or-later").removesuffix("-or-later").removesuffix("-only")
    for tail in ("", " license"):
        if name.removesuffix(tail) in NAMES:
            return NAMES[name.removesuffix(tail)]
    parts = words.split(" ")
    for many in range(min(len(parts) - 1, LONGEST_NAME), 0, -1):
        begin = " ".join(parts[:many])
        if begin in NAMES:
            rest = _LATER_FIRST.sub("", " ".join(parts[many:]))
            return NAMES[begin] if _SURE.search(begin) and not _FURTHER.match(rest) else None
    return None


def identifier(form: str) -> str | None:
    """The known licence sentence that a normalised sentence is."""
    named = _SPDX.match(form) or " under " in form and _GRANT.match(form)
    if named:
        name = licence_name(named[1])
        if name:
            return f"named:{name}"
    for known, name in BY_FIRST.get(form.split(" ", 1)[0], ()):
        if form == known or form.startswith(known + " "):
            return name
    return None


def goes_on(form: str) -> bool:
    """Whether a normalised text is a proper beginning of some known sentence."""
    if form in BEGINNINGS or form == "spdx-license-identifier" or _BEFORE_UNDER.fullmatch(form) and " under" not in form:
        return True
    under = _UNDER.match(form)
    return bool(under) and (not under[1] or under[1] in GRANT_BEGINNINGS)


def sentences(text: str) -> list[tuple[int, int]]:
    found, past = [], 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        if text[past:end].strip():
            found.append((past, end))
        past = cut.end() if cut else past
    return found


def whole_sentences(text: str, spans: list[tuple[int, int]], forms: list[str]) -> list[int]:
    """The number of the whole sentence that each piece is part of."""
    out, number, open_ = [], 0, False
    for k, (begin, end) in enumerate(spans):
        lettered = bool(_LETTER.search(forms[k]))
        if not lettered and open_:
            number, open_ = number + 1, False
        out.append(number)
        if lettered:
            last = k + 1 == len(spans) or text.count("\n", end, spans[k + 1][0]) > 1
            open_ = not last and not _STOP.search(text, begin, end)
            number += not open_
    return out


def identified(text: str) -> tuple[list[tuple[int, int, int, int, str]], int]:
    """(first and last whole sentence, begin, end, identifier) of the known sentences in order, and how many unknown ones speak of licences."""
    spans = sentences(text)
    forms = [normal_form(text[a:b]) for a, b in spans]
    numbers = whole_sentences(text, spans, forms)
    small = text.lower()
    may_talk = not text.isascii() or any(anchor in small for anchor in _ANCHORS)
    found, unknown, i = [], 0, 0
    while i < len(spans):
        begin, end = spans[i]
        many, form = 1, forms[i]
        name = identifier(form)
        while not name and form and i + many < len(spans) and goes_on(form):
            end, form = spans[i + many][1], f"{form} {forms[i + many]}".rstrip()
            many += 1
            name = identifier(form)
        if name and many > 1 and identifier(" ".join(filter(None, forms[i + 1:i + many]))):
            name = None  # the lines after this one say it alone
        if name:
            found.append((numbers[i], numbers[i + many - 1], begin, end, name))
            i += many
        else:
            unknown += may_talk and bool(_TALKS.search(text, *spans[i]))
            i += 1
    return found, unknown


def licences(text: str, gap: int = GAP) -> tuple[list[tuple[str, int, int, list[str]]], int]:
    """(licence, begin, end, identifiers) of each match in order, and the number of unknown licence sentences."""
    known, unknown = identified(text)
    used: set[int] = set()
    found = []
    for at in range(len(known)):
        if at in used:
            continue
        best: tuple[str, list[int]] | None = None
        for name, rule in RULES:
            if rule[0] != known[at][4] or best and len(rule) <= len(best[1]):
                continue
            taken = [at]
            for want in rule[1:]:
                near = (j for j in range(taken[-1] + 1, len(known)) if j not in used and known[j][4] == want)
                j = next(near, None)
                if j is None or known[j][0] - known[taken[-1]][1] - 1 > gap:
                    break
                taken.append(j)
            if len(taken) == len(rule):
                best = name, taken
        if best:
            used.update(best[1])
            found.append((best[0], known[best[1][0]][2], known[best[1][-1]][3], [known[j][4] for j in best[1]]))
    return found, unknown


_MATCH = T.StructType([T.StructField("licence", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
                       T.StructField("sentences", T.ArrayType(T.StringType()))])


@F.arrow_udf(T.StructType([T.StructField("matches", T.ArrayType(_MATCH)), T.StructField("unknown", T.LongType())]))
def scan(column: pa.Array) -> pa.Array:
    rows = []
    for text in column:
        found, unknown = licences(text.as_py() or "")
        rows.append({"matches": [dict(zip(("licence", "begin", "end", "sentences"), m)) for m in found], "unknown": unknown})
    match = pa.struct([("licence", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))])
    return pa.array(rows, pa.struct([("matches", pa.list_(match)), ("unknown", pa.int64())]))


def listed(matches: Column) -> Column:
    """licence:begin:end, joined by commas."""
    return F.array_join(F.transform(matches, lambda m: F.concat_ws(":", m["licence"], m["begin"].cast("string"), m["end"].cast("string"))), ",")
