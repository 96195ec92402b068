"""License detection by ordered signature rules.

A text becomes its words joined by single spaces, lower-cased, so that a rule sees neither punctuation nor line ends. A rule is
a regular expression over whole words with a label, a priority, a confidence and keywords. The keywords of all rules are looked up
among a block's distinct words first: a rule runs on a text only if the text has all words of one of its keyword sets, and
most texts run none. Of overlapping detections the one of higher priority, then the longer, then the earlier rule
is kept, and every other one inside its interval is suppressed; detections that only touch or cross stay.

One pass, no shuffle; a task holds one block of texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rowtide.llm import texts as X


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]  # words that a text must have
    priority: int
    confidence: float


#: Phrases that are labels by themselves, each place of them.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label: (how a notice names it, the words after a license tag, words of which any notice or name has one)
_NAMES: dict[str, tuple[str, str, str]] = {
    "mit": (r"mit(?: x11)?|x11 mit|expat", r"mit", "mit expat"),
    "mit-0": (r"mit no attribution|mit 0", r"mit 0", "mit"),
    "apache-2": (r"apache(?: software)? (?:license |licence )?(?:version |v)?2(?: 0)?|apache 2(?: 0)?", r"apache 2 0", "apache"),
    "apache-1.1": (r"apache(?: software)? (?:license |licence )?(?:version |v)?1 1", r"apache 1 1", "apache"),
    "apache-1.0": (r"apache(?: software)? (?:license |licence )?(?:version |v)?1 0", r"apache 1 0", "apache"),
    "bsd-2-clause": (r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2 clause|two clause|simplified)", r"bsd 2 clause", "bsd freebsd"),
    "bsd-3-clause": (r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3 clause|three clause|new|revised)", r"bsd 3 clause", "bsd"),
    "bsd-4-clause": (r"(?:original|4 clause|four clause) bsd|bsd (?:4 clause|four clause|original)", r"bsd 4 clause", "bsd"),
    "0bsd": (r"0 ?bsd|zero clause bsd|bsd zero clause", r"0bsd", "0bsd bsd"),
    "gpl-1": (r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?1(?: 0)?(?: or (?:any )?later)?", r"gpl 1 0(?: only| or later)?", "gpl gpl1 gplv1 gplversion general"),
    "gpl-2": (r"(?:gnu )?(?:general public licen[sc]e|gpl) ?(?:version |v)?2(?: 0)?|gplv2", r"gpl 2 0(?: only| or later)?", "gpl gpl2 gplv2 gplversion general"),
    "gpl-3": (r"(?:gnu )?(?:general public licen[sc]e|gpl) ?(?:version |v)?3(?: 0)?|gplv3", r"gpl 3 0(?: only| or later)?", "gpl gpl3 gplv3 gplversion general"),
    "lgpl-2.0": (r"(?:gnu )?(?:library general public licen[sc]e|lgpl) ?(?:version |v)?2 0", r"lgpl 2 0(?: only| or later)?", "lgpl lgpl2 lgplv2 lgplversion library"),
    "lgpl-2.1": (r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) ?(?:version |v)?2 1|lgplv2 1", r"lgpl 2 1(?: only| or later)?", "lgpl lgpl2 lgplv2 lgplversion lesser"),
    "lgpl-3": (r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) ?(?:version |v)?3(?: 0)?|lgplv3", r"lgpl 3 0(?: only| or later)?", "lgpl lgpl3 lgplv3 lgplversion lesser"),
    "agpl-3": (r"(?:gnu )?(?:affero general public licen[sc]e|agpl) ?(?:version |v)?3(?: 0)?|agplv3", r"agpl 3 0(?: only| or later)?", "agpl agpl3 agplv3 agplversion affero"),
    "gfdl-1.1": (r"gnu free documentation licen[sc]e ?(?:version |v)?1 1", r"gfdl 1 1(?: only| or later)?", "gfdl documentation"),
    "gfdl-1.2": (r"gnu free documentation licen[sc]e ?(?:version |v)?1 2", r"gfdl 1 2(?: only| or later)?", "gfdl documentation"),
    "gfdl-1.3": (r"gnu free documentation licen[sc]e ?(?:version |v)?1 3", r"gfdl 1 3(?: only| or later)?", "gfdl documentation"),
    "mpl-1.0": (r"mozilla public licen[sc]e ?(?:version |v)?1 0|mpl 1 0", r"mpl 1 0", "mozilla mpl"),
    "mpl-1.1": (r"mozilla public licen[sc]e ?(?:version |v)?1 1|mpl 1 1", r"mpl 1 1", "mozilla mpl"),
    "mpl-2": (r"mozilla public licen[sc]e ?(?:version |v)?2(?: 0)?|mpl 2(?: 0)?", r"mpl 2 0", "mozilla mpl"),
    "epl-1.0": (r"eclipse public licen[sc]e ?(?:version |v)?1(?: 0)?", r"epl 1 0", "eclipse epl"),
    "epl-2.0": (r"eclipse public licen[sc]e ?(?:version |v)?2(?: 0)?", r"epl 2 0", "eclipse epl"),
    "edl-1.0": (r"eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?", r"edl 1 0", "eclipse edl"),
    "cddl-1.0": (r"common development and distribution licen[sc]e(?: version| v)?(?: 1 0)?", r"cddl 1 0", "cddl distribution"),
    "cddl-1.1": (r"common development and distribution licen[sc]e(?: version| v)? 1 1", r"cddl 1 1", "cddl distribution"),
    "cpl-1.0": (r"common public licen[sc]e(?: version| v)?(?: 1 0)?", r"cpl 1 0", "cpl common"),
    "eupl-1.1": (r"european union public licen[sc]e(?: version| v)? ?1 1|eupl ?v?1 1", r"eupl 1 1", "eupl eupl1 euplv1 european"),
    "eupl-1.2": (r"european union public licen[sc]e(?: version| v)? ?1 2|eupl ?v?1 2", r"eupl 1 2", "eupl eupl1 euplv1 european"),
    "artistic-1.0": (r"artistic licen[sc]e ?(?:version |v)?1(?: 0)?", r"artistic 1 0(?: perl)?", "artistic"),
    "artistic-2.0": (r"artistic licen[sc]e ?(?:version |v)?2(?: 0)?", r"artistic 2 0", "artistic"),
    "bsl-1.0": (r"boost software licen[sc]e(?: version| v)?(?: 1 0)?", r"bsl 1 0", "boost bsl"),
    "busl-1.1": (r"business source licen[sc]e(?: version| v)?(?: 1 1)?", r"busl 1 1", "business busl"),
    "isc": (r"isc|internet (?:software|systems) consortium", r"isc", "isc internet"),
    "zlib": (r"zlib(?: libpng)?", r"zlib", "zlib"),
    "libpng-2.0": (r"(?:png reference library|libpng)(?: version| v)? 2(?: 0)?", r"libpng 2 0", "libpng png"),
    "unlicense": (r"unlicense", r"unlicense", "unlicense"),
    "wtfpl": (r"wtfpl|do what the fuck you want to public licen[sc]e", r"wtfpl", "wtfpl want"),
    "beerware": (r"beer ?ware", r"beerware", "beerware beer"),
    "python-2.0": (r"python software foundation licen[sc]e(?: version| v)?(?: 2)?|psf", r"(?:psf|python) 2 0", "python psf"),
    "ruby": (r"ruby", r"ruby", "ruby"),
    "php-3.01": (r"php licen[sc]e(?: version| v)? 3 01", r"php 3 01", "php"),
    "php-3.0": (r"php licen[sc]e(?: version| v)? 3 0", r"php 3 0", "php"),
    "openssl": (r"openssl", r"openssl", "openssl"),
    "ncsa": (r"university of illinois ncsa(?: open source)?|ncsa(?: open source)?", r"ncsa", "ncsa"),
    "postgresql": (r"postgresql", r"postgresql", "postgresql"),
    "ofl-1.1": (r"sil open font licen[sc]e(?: version| v)?(?: 1 1)?|open font licen[sc]e", r"ofl 1 1(?: rfn| no rfn)?", "ofl font"),
    "odbl-1.0": (r"open (?:data commons open )?database licen[sc]e(?: version| v)?(?: 1 0)?", r"odbl 1 0", "odbl database"),
    "odc-by-1.0": (r"open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?", r"odc by 1 0", "odc commons"),
    "pddl-1.0": (r"public domain dedication (?:and|&) licen[sc]e(?: version| v)?(?: 1 0)?", r"pddl 1 0", "pddl dedication"),
    "cecill-2.1": (r"cecill(?: free software licen[sc]e agreement)?(?: version| v)? ?2 1", r"cecill 2 1", "cecill cecill2"),
    "cecill-b": (r"cecill b", r"cecill b", "cecill"),
    "cecill-c": (r"cecill c", r"cecill c", "cecill"),
    "ms-pl": (r"microsoft public|ms pl", r"ms pl", "microsoft pl"),
    "ms-rl": (r"microsoft reciprocal|ms rl", r"ms rl", "microsoft rl"),
    "osl-3.0": (r"open software licen[sc]e(?: version| v)?(?: 3 0)?", r"osl 3 0", "osl open"),
    "afl-3.0": (r"academic free licen[sc]e(?: version| v)?(?: 3 0)?", r"afl 3 0", "afl academic"),
    "qpl-1.0": (r"q public licen[sc]e(?: version| v)?(?: 1 0)?|qpl", r"qpl 1 0", "qpl q"),
    "ipl-1.0": (r"ibm public licen[sc]e(?: version| v)?(?: 1 0)?", r"ipl 1 0", "ipl ibm"),
    "lppl-1.3c": (r"latex project public licen[sc]e(?: version| v)?(?: 1 3c?)?", r"lppl 1 3c", "lppl latex"),
    "npl-1.1": (r"netscape public licen[sc]e(?: version| v)?(?: 1 1)?", r"npl 1 1", "npl netscape"),
    "sspl-1.0": (r"server side public licen[sc]e(?: version| v)?(?: 1)?|sspl", r"sspl 1 0", "sspl server"),
    "elastic-2.0": (r"elastic licen[sc]e(?: version| v)?(?: 2 0)?", r"elastic 2 0", "elastic"),
    "upl-1.0": (r"universal permissive licen[sc]e(?: version| v)?(?: 1 0)?", r"upl 1 0", "upl universal"),
    "mulanpsl-2.0": (r"mulan permissive software licen[sc]e(?: version| v)?(?: 2)?|mulan psl v2", r"mulanpsl 2 0", "mulan mulanpsl"),
    "vim": (r"vim", r"vim", "vim"),
    "w3c": (r"w3c(?: software)?(?: notice and)?", r"w3c", "w3c"),
    "zpl-2.1": (r"zope public licen[sc]e(?: version| v)?(?: 2 1)?", r"zpl 2 1", "zpl zope"),
    "blueoak-1.0.0": (r"blue oak model licen[sc]e(?: version| v)?(?: 1 0 0)?", r"blueoak 1 0 0", "blueoak oak"),
}

# Creative Commons: label: (letters of the short name, words of the long one)
_COMMONS: dict[str, tuple[str, str]] = {
    "cc-by": (r"by", r"attribution"),
    "cc-by-sa": (r"by sa", r"attribution share ?alike"),
    "cc-by-nd": (r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    "cc-by-nc": (r"by nc", r"attribution non ?commercial"),
    "cc-by-nc-sa": (r"by nc sa", r"attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": (r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}

# label, pattern, keywords, confidence: sentences of license texts and of plain notices
_TEXTS: tuple[tuple[str, str, str, float], ...] = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted", 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions", 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby fee", 1.0),
    ("bsd-2-clause", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary", 0.8),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "neither endorse", 1.0),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising mentioning", 1.0),
    ("apache-2", r"you may not use this file except in compliance with the license", "compliance except", 0.8),
    ("apache-2", r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", "apache obtain", 1.0),
    ("apache-2", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?", "apache licenses", 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "redistribute gnu", 0.9),
    ("gpl-2", r"published by the free software foundation either version 2 of the license", "foundation either", 0.95),
    ("gpl-3", r"published by the free software foundation either version 3 of the license", "foundation either", 0.95),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", "received gnu", 0.8),
    ("gpl", r"(?:https? )?(?:www )?gnu org (?:copyleft|licenses) gpl(?: html| txt)?", "gnu gpl", 0.8),
    ("lgpl", r"(?:https? )?(?:www )?gnu org (?:copyleft|licenses) lgpl(?: html| txt)?", "gnu lgpl", 0.8),
    ("agpl", r"(?:https? )?(?:www )?gnu org licenses agpl(?: html| txt)?", "gnu agpl", 0.8),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla subject", 1.0),
    ("mpl-2", r"(?:https? )?(?:www )?mozilla org mpl 2 0", "mozilla mpl", 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered domain", 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising", "held arising", 0.9),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "hereby accompanying", 1.0),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 0.9),
    ("cc0", r"creative commons (?:cc )?zero(?: 1 0)?(?: universal)?", "creative zero", 0.95),
    ("cc0", r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons publicdomain", 1.0),
    ("cc-by", r"creativecommons org licenses by(?! (?:nc|nd|sa)(?![^ ]))(?: \d 0)?", "creativecommons licenses", 1.0),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: \d 0)?", "creativecommons sa", 1.0),
    ("cc-by-nd", r"creativecommons org licenses by nd(?: \d 0)?", "creativecommons nd", 1.0),
    ("cc-by-nc", r"creativecommons org licenses by nc(?! (?:nd|sa)(?![^ ]))(?: \d 0)?", "creativecommons nc", 1.0),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: \d 0)?", "creativecommons sa", 1.0),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: \d 0)?", "creativecommons nd", 1.0),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 0.8),
    ("public-domain", r"this (?:work|file|software|text) is in the public domain", "public domain", 0.8),
    ("all-rights-reserved", r"all rights (?:are )?reserved", "rights reserved", 0.7),
    ("proprietary", r"proprietary and confidential", "proprietary confidential", 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution|reproduction) (?:\S+ ){0,10}(?:is )?(?:strictly )?prohibited", "prohibited", 0.7),
    ("wtfpl", r"you just do what the fuck you want to", "fuck want", 1.0),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain stuff", 1.0),
    ("python-2.0", r"psf is making python available to licensee on an as is basis", "psf licensee", 1.0),
    ("ofl-1.1", r"scripts sil org ofl", "sil ofl", 0.95),
    ("epl-2.0", r"eclipse org legal epl (?:2 0|v20)(?: html)?", "eclipse epl", 0.95),
    ("epl-1.0", r"eclipse org legal epl v10(?: html)?", "eclipse epl", 0.95),
)

_GRANT = r"(?:is |are )?(?:re ?)?(?:licen[sc]ed|released|distributed|available|provided|published|shared|offered|covered) (?:to you )?(?:under|by|as)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: phrases, tags, license texts, notices, names."""
    out = [Rule(f"phrase {p}", label, re.escape(p).replace(r"\ ", " "), tuple(p.split()), 100, 0.95) for p, label in PHRASES]

    def add(kind: str, label: str, pattern: str, words: str, priority: int, confidence: float, also: str = "") -> None:
        for word in words.split():  # any of the words; one rule each so that a rule's keywords must all be there
            out.append(Rule(f"{kind} {label} {word}", label, pattern, (word, *also.split()), priority, confidence))

    for label, (name, tag, words) in _NAMES.items():
        add("tag", label, rf"spdx licen[sc]e identifier {tag}", "psf python" if label == "python-2.0" else tag.split()[0], 90, 1.0, "spdx")
        add("notice", label, rf"{_GRANT} (?:{name})(?: licen[sc]e)?", words, 70, 0.9)
        add("name", label, rf"(?:{name}) licen[sc]e", words, 50, 0.7)
        add("name", label, rf"licen[sc]e (?:{name})", words, 45, 0.6)
    for label, (short, long) in _COMMONS.items():
        last = short.split()[-1]
        add("tag", label, rf"spdx licen[sc]e identifier cc {short} \d 0", last, 90, 1.0, "spdx cc")
        add("notice", label, rf"{_GRANT} (?:cc|creative commons) {short}(?: \d(?: \d)?)?(?: licen[sc]e)?", last, 70, 0.9)
        add("name", label, rf"cc {short}(?: \d(?: \d)?)?", last, 50, 0.7 if label != "cc-by" else 0.5, "cc")
        add("notice", label, rf"{_GRANT} creative commons {long}(?: \d(?: \d)?)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?", "commons", 75, 0.95, "creative")
        add("name", label, rf"creative commons {long}(?: \d(?: \d)?)?(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?", "commons", 55, 0.8, "creative")
    for i, (label, pattern, words, confidence) in enumerate(_TEXTS):
        out.append(Rule(f"text {i} {label}", label, pattern, tuple(words.split()), 80, confidence))
    add("notice", "gpl", rf"{_GRANT} (?:gnu )?(?:general public licen[sc]e|gpl)", "gpl general", 60, 0.7)
    add("notice", "lgpl", rf"{_GRANT} (?:gnu )?(?:lesser general public licen[sc]e|lgpl)", "lgpl lesser", 60, 0.7)
    add("notice", "agpl", rf"{_GRANT} (?:gnu )?(?:affero general public licen[sc]e|agpl)", "agpl affero", 60, 0.7)
    add("notice", "bsd", rf"{_GRANT} (?:berkeley |bsd )(?:style )?(?:licen[sc]e)?", "bsd berkeley", 60, 0.7)
    add("notice", "apache", rf"{_GRANT} apache(?: software)? licen[sc]e", "apache", 60, 0.7)
    return tuple(out)


@cache
def _compiled() -> tuple[tuple[Rule, re.Pattern], ...]:
    return tuple((r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])")) for r in rules())


@cache
def _gates() -> tuple[pa.Array, tuple[frozenset[int], ...]]:
    words = sorted({k for r in rules() for k in r.keywords})
    at = {w: i for i, w in enumerate(words)}
    return pa.array([w.encode() for w in words], pa.binary()), tuple(frozenset(at[k] for k in r.keywords) for r in rules())


def matches(words: list[str], have: frozenset[int]) -> list[tuple[int, int, int]]:
    """(rule, first word, last word) of every match; only rules whose keywords are all in `have` run."""
    text, out = " ".join(words), []
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    patterns = _compiled()
    seen = set()
    for i, need in enumerate(_gates()[1]):
        if need <= have:
            rule, pattern = patterns[i]
            for m in pattern.finditer(text):
                a, b = int(np.searchsorted(starts, m.start())), int(np.searchsorted(starts, m.end(), "left")) - 1
                if (key := (rule.label, rule.priority, a, b)) not in seen:  # one rule under two keywords
                    seen.add(key)
                    out.append((i, a, b))
    return out


def kept(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections that no stronger one contains, by place.

    In order of strength, each asks for the furthest end among those before it that begin no later; ends are kept as maxima over
    ranges of beginnings, so a text's time grows with its detections and their logarithm.
    """
    begins = sorted({m[1] for m in found})
    far = [-1] * (len(begins) + 1)
    out: list[tuple[int, int, int]] = []
    for m in sorted(found, key=lambda m: (-rules()[m[0]].priority, m[1] - m[2], m[0], m[1])):
        at = spot = bisect_right(begins, m[1])
        end = -1
        while at:
            end = max(end, far[at])
            at &= at - 1
        if end >= m[2]:
            continue
        out.append(m)
        while spot <= len(begins):
            far[spot] = max(far[spot], m[2])
            spot += spot & -spot
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


_PLACE = "array<struct<rule:string,label:string,first_word:bigint,last_word:bigint,confidence:double>>"
_ADDED = (("n_words", "bigint"), ("matches", _PLACE), ("licenses", _PLACE))


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row of `docs`: id, kept columns, n_words, all `matches` of rules, and the `licenses` left by suppression.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII, counted from 0 in the whole text. A null, empty or
    wordless text has none. Of equal detections the earlier rule's stays. Repeated rows each come back; kept
    columns must not have a result's name; others are not looked at.
    """
    base, back = X.kept(docs, id, text, keep)
    kind = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("confidence", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, gates = _gates()
        table = rules()
        row = lambda m: dict(rule=table[m[0]].name, label=table[m[0]].label, first_word=m[1], last_word=m[2], confidence=table[m[0]].confidence)
        for block in X.blocks(batches, text):
            data, offsets = X.utf8(block.column(text))
            found, _, _, first = X.words(data, offsets, X.ALNUM)
            n = block.num_rows
            every, left = [[] for _ in range(n)], [[] for _ in range(n)]
            coded = found.dictionary_encode()
            key = pc.fill_null(pc.index_in(coded.dictionary, keys), -1).to_numpy()
            if len(found) and (key >= 0).any():
                of = key[coded.indices.to_numpy()]
                at = np.flatnonzero(of >= 0)
                doc = np.searchsorted(first, at, "right") - 1
                have: dict[int, set[int]] = {}
                for pair in np.unique(doc * len(keys) + of[at]).tolist():
                    have.setdefault(pair // len(keys), set()).add(pair % len(keys))
                for d, own in have.items():
                    own = frozenset(own)
                    if any(g <= own for g in gates):
                        words = [w.decode() for w in found.slice(first[d], first[d + 1] - first[d]).to_pylist()]
                        if hits := matches(words, own):
                            every[d], left[d] = [row(m) for m in hits], [row(m) for m in kept(hits)]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in back), pa.array(np.diff(first).astype(np.int64)), pa.array(every, kind), pa.array(left, kind)], [*back, *(c for c, _ in _ADDED)])

    return base.mapInArrow(scan, X.struct(base, back, _ADDED))
