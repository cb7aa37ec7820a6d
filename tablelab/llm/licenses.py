"""License scan with ordered signature rules.

A text becomes its words (``common.alnum_words``) joined by single spaces, so
that a rule is a regular expression over words and line breaks, punctuation
and comment marks don't matter.  Rules are written as patterns per license
family and expanded with the wordings that licenses are referred to by (grant,
terms, short name, SPDX tag, title, reference by address); the expanded list
is ordered, its position is the priority.

* *Prefilter*: a rule runs only on texts that hold one of its keywords; every
  alternative of its pattern contains one of them, so no detection is lost.
  Keywords are few, and a text without any of them costs one substring search each.
* *Suppression*: detections are taken in priority order; one whose word
  interval lies inside an accepted interval is dropped, so "apache license
  version 2 0" is not reported again as a bare "apache license", nor a Lesser
  GPL as a GPL.  Partly overlapping detections both stay.

Base phrases (``BASE``) are counted at every place and their labels are never
suppressed.  ``score`` is the confidence of the surest accepted detection.

Defined results: null and empty texts have no words, no label and score 0;
repeated rows each get their row; whole texts are scanned whatever their
length; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import alnum_words, map_arrow

# FIXED VALUES: the phrases that are always reported, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"),
        ("cc by", "cc-by"), ("mit license", "mit")]

# Hand-written signatures: label, keywords (parted by "|"), pattern of the license's name.
# "V" stands for an optional "version"/"v" in front of a number.
FAMILIES = [
    ("agpl-3.0", "affero|agpl", r"(?:gnu )?affero general public license V3(?: 0)?|(?:gnu )?agplv?3|(?:gnu )?agpl V?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("lgpl-2.1", "gpl", r"lgpl V?2 1|lgplv2 1"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public license V2 1"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public license V2(?: 0)?"),
    ("lgpl-3.0", "gpl", r"lgpl V?3(?: 0)?|lgplv3"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public license V3(?: 0)?"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public license"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl V?2(?: 0)?|gplv2"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license V2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl V?3(?: 0)?|gplv3"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license V3(?: 0)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license V1(?: 0)?"),
    ("gfdl-1.3", "documentation license", r"(?:gnu )?free documentation license V1 3"),
    ("gfdl-1.2", "documentation license", r"(?:gnu )?free documentation license V1 2"),
    ("gfdl", "documentation license", r"(?:gnu )?free documentation license"),
    ("apache-2.0", "apache", r"apache (?:software )?license V2(?: 0)?|apache 2(?: 0)? license"),
    ("apache-1.1", "apache", r"apache (?:software )?license V1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?license V1(?: 0)?"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("x11", "x11", r"x11 license|mit x11(?: license)?|x11 mit(?: license)?"),
    ("expat", "expat", r"expat license|mit expat(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: license)?"),
    ("bsd-0-clause", "bsd", r"(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd|0bsd)(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("isc", "isc license", r"isc license"),
    ("mpl-2.0", "mozilla", r"mozilla public license V2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license V1 1"),
    ("mpl-1.0", "mozilla", r"mozilla public license V1(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-2.0", "eclipse", r"eclipse public license V2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license V1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("edl-1.0", "eclipse", r"eclipse distribution license V1(?: 0)?"),
    ("cddl-1.1", "common development", r"common development and distribution license V1 1"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: V1(?: 0)?)?"),
    ("cpl-1.0", "common public license", r"common public license(?: V1(?: 0)?)?"),
    ("ipl-1.0", "ibm public", r"ibm public license(?: V1(?: 0)?)?"),
    ("eupl-1.2", "european union public", r"european union public licen[sc]e V1 2"),
    ("eupl-1.1", "european union public", r"european union public licen[sc]e V1 1"),
    ("eupl", "european union public", r"european union public licen[sc]e"),
    ("osl-3.0", "open software license", r"open software license(?: V3(?: 0)?)?"),
    ("afl-3.0", "academic free", r"academic free license(?: V3(?: 0)?)?"),
    ("artistic-2.0", "artistic", r"artistic license V?2(?: 0)?"),
    ("artistic-1.0", "artistic|same terms as perl", r"(?:clarified )?artistic license(?: V1(?: 0)?)?|same terms as perl(?: itself)?"),
    ("bsl-1.0", "boost", r"boost software license(?: V1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source license(?: V?1 1)?"),
    ("sspl-1.0", "server side public", r"server side public license(?: V1)?"),
    ("elastic-2.0", "elastic license", r"elastic license(?: V?2(?: 0)?)?"),
    ("ms-pl", "microsoft|ms pl", r"microsoft public license|ms pl"),
    ("ms-rl", "microsoft|ms rl", r"microsoft reciprocal license|ms rl"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng", r"libpng license"),
    ("openssl", "openssl", r"openssl license"),
    ("php-3.01", "php license", r"php license(?: V3 0?1)?"),
    ("python-2.0", "python|psf license", r"python software foundation license(?: V2)?|psf license"),
    ("ruby", "ruby license", r"ruby license"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license|ncsa license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl|what the fuck", r"do what the fuck you want to public license|wtfpl"),
    ("beerware", "beer", r"beer ?ware license"),
    ("ofl-1.1", "sil open font", r"sil open font license(?: V1 1)?"),
    ("odbl-1.0", "open database", r"open (?:data commons )?open database license|open database license"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution license"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication(?: and license)?"),
    ("cdla-permissive", "community data", r"community data license agreement permissive"),
    ("cdla-sharing", "community data", r"community data license agreement sharing"),
    ("vim", "vim license", r"vim license"),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: V1(?: 0)?)?"),
    ("w3c", "w3c", r"w3c software (?:notice and |and document )?license"),
    ("gpl-exception", "linking exception", r"(?:gcc runtime|gpl) linking exception"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?"),
]

# Creative Commons licenses follow a rule: elements, their long names, versions.
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
CC_KINDS = ["by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"]
CC_VERSIONS = ["4 0", "3 0", "2 5", "2 0", "1 0"]

# Notices without a license name: label, keywords, pattern, confidence.
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("hpnd", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation", 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote", 0.95),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.95),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v?1 0)?", 0.95),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain|public domain dedication", 0.8),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 0.6),
    ("copyright", "copyright", r"copyright (?:c |by )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", 0.7),
    ("creative-commons", "creative commons", r"creative commons(?: license)?", 0.5),
    ("license-reference", "licensed under|released under|distributed under", r"(?:licensed|released|distributed) under (?:the )?(?:[^ ]+ ){1,4}?licen[sc]e", 0.3),
]

# Wordings around a license name ("N"), strongest first, with their confidence.
FORMS = [
    ("spdx license identifier N", 1.0),
    ("(?:is |are )?(?:licensed|released|distributed|available|published|made available) under (?:the terms of )?(?:the |an? )?N", 0.95),
    ("under the terms (?:and conditions )?of (?:the |an? )?N", 0.95),
    ("N", 0.8),
]

_V = r"(?:v(?:ersion)? ?)?"
_SINCE = r"(?: or (?:any )?later(?: version)?| only)?"


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: tuple[bytes, ...]
    pattern: re.Pattern
    confidence: float


def _names() -> list[tuple[str, str, str]]:
    names = []
    for kind in CC_KINDS:
        long = " ".join(CC_PARTS[p] for p in kind.split())
        label = "cc-" + kind.replace(" ", "-")
        for version in CC_VERSIONS:
            tail = version.replace(" 0", "(?: 0)?") if version.endswith(" 0") else version
            names.append((f"{label}-{version.replace(' ', '.')}", "cc", f"cc {kind} {tail}"))
            names.append((f"{label}-{version.replace(' ', '.')}", "creative commons",
                          f"creative commons {long}(?: {version}|(?: international| unported)?(?: public)? license V{tail})(?: international| unported)?(?: public)?(?: license)?"))
        names.append((label, "cc", f"cc {kind}"))
        names.append((label, "creative commons", f"creative commons {long}(?: license)?"))
    for label, keyword, name in FAMILIES:
        names.append((label, keyword, "(?:" + name + ")" + _SINCE))
    for phrase, label in BASE:
        names.append((label, phrase, phrase))
    return names


def build_rules() -> list[Rule]:
    """Names x forms, then the notices; the position is the priority."""
    rules: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, confidence: float) -> None:
        body = re.sub(r"V(\??)(?=\d)", _V, pattern)
        rules.append(Rule(len(rules), label, tuple(keyword.encode().split(b"|")),
                          re.compile(b"(?<= )(?:" + body.encode() + b")(?= )"), confidence))

    names = _names()
    for form, confidence in FORMS:
        for label, keyword, name in names:
            add(label, keyword, form.replace("N", f"(?:{name})"), confidence)
        if confidence == 1.0:
            for label, keyword, pattern, sure in NOTICES[:8]:
                add(label, keyword, pattern, sure)
    for label, keyword, pattern, sure in NOTICES[8:]:
        add(label, keyword, pattern, sure)
    return rules


RULES = build_rules()
KEYWORDS = sorted({k for r in RULES for k in r.keyword})
_BASE = [(f" {p} ".encode(), label) for p, label in BASE]


@dataclass(frozen=True)
class Detection:
    label: str
    first_word: int
    last_word: int
    confidence: float


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase in ' w w w '."""
    out = []
    for phrase, label in _BASE:
        at = line.find(phrase)
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(phrase, at + 1)
    return out


def detections(line: bytes, prefilter: bool = True) -> list[Detection]:
    """Rule detections after interval-containment suppression, by priority."""
    held = {k for k in KEYWORDS if k in line} if prefilter else set(KEYWORDS)
    if not held:
        return []
    accepted: list[tuple[int, int]] = []
    out: list[Detection] = []
    for rule in RULES:
        if held.isdisjoint(rule.keyword):
            continue
        for m in rule.pattern.finditer(line):
            a, b = m.span()
            if any(x <= a and b <= y for x, y in accepted):
                continue
            accepted.append((a, b))
            first = line.count(b" ", 0, a) - 1
            out.append(Detection(rule.label, first, first + line.count(b" ", a, b), rule.confidence))
    return out


def scan_text(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    words = alnum_words(text)
    line = b" " + b" ".join(words) + b" " if words else b""
    return len(words), base_places(line), detections(line)


_OUT = ("doc_id {id}, n_words long, base array<struct<word: long, label: string>>, "
        "found array<struct<label: string, first_word: long, last_word: long, confidence: double>>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its base places and accepted detections."""
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(cols: dict) -> dict:
        got = [scan_text(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_words": [g[0] for g in got],
                "base": [[{"word": w, "label": x} for w, x in g[1]] for g in got],
                "found": [[vars(d) for d in g[2]] for g in got]}

    return map_arrow(df, run, _OUT.format(id=df.schema["doc_id"].dataType.simpleString()))


def digest(found: DataFrame) -> DataFrame:
    """The report columns of ``scan``."""
    base, rules = F.col("base.label"), F.col("found.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, rules))).alias("labels"),
        F.coalesce(F.array_max("found.confidence"), F.lit(0.0)).alias("score"))
