"""License scan: ordered signature rules behind a keyword prefilter, overlaps settled by priority."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Words, batched, pieces, texts_of, words_of

#: Phrases whose words may stand anywhere in a text, and the label each gives.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: How sure a base phrase alone is.
BASE_SCORE = 0.5

#: Licences by family: label stem, written titles (regular expressions over lower-case text),
#: versions, the short form before a version, and places on the web.
FAMILIES = (
    ("gpl", r"(?:gnu )?general public licen[sc]e|gnu gpl", ("1.0", "2.0", "3.0"), "gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|gnu lgpl", ("2.0", "2.1", "3.0"), "lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|gnu agpl", ("1.0", "3.0"), "agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"gnu free documentation licen[sc]e", ("1.1", "1.2", "1.3"), "gfdl", r"gnu\.org/licenses/(?:old-licenses/)?fdl"),
    ("apache", r"apache (?:software )?licen[sc]e", ("1.0", "1.1", "2.0"), "apache", r"apache\.org/licenses/license"),
    ("mpl", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0"), "mpl", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public licen[sc]e", ("1.0", "2.0"), "epl", r"eclipse\.org/legal/epl"),
    ("cddl", r"common development and distribution licen[sc]e", ("1.0", "1.1"), "cddl", r"opensource\.org/licen[sc]es?/cddl"),
    ("eupl", r"european union public licen[sc]e", ("1.0", "1.1", "1.2"), "eupl", r"joinup\.ec\.europa\.eu/[^ \n]*eupl"),
    ("afl", r"academic free licen[sc]e", ("1.2", "2.0", "2.1", "3.0"), "afl", r"opensource\.org/licen[sc]es?/afl"),
    ("osl", r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0"), "osl", r"opensource\.org/licen[sc]es?/osl"),
    ("apsl", r"apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0"), "apsl", r"opensource\.apple\.com/license"),
    ("artistic", r"(?:perl )?artistic licen[sc]e", ("1.0", "2.0"), "artistic", r"perlfoundation\.org/artistic"),
    ("bsl", r"boost software licen[sc]e", ("1.0",), "bsl", r"boost\.org/license"),
    ("cpl", r"common public licen[sc]e", ("1.0",), "cpl", r"opensource\.org/licen[sc]es?/cpl"),
    ("ipl", r"ibm public licen[sc]e", ("1.0",), "ipl", r"opensource\.org/licen[sc]es?/ibmpl"),
    ("lppl", r"latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3"), "lppl", r"latex-project\.org/lppl"),
    ("ms-pl", r"microsoft public licen[sc]e", (), "ms-pl", r"opensource\.org/licen[sc]es?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", (), "ms-rl", r"opensource\.org/licen[sc]es?/ms-rl"),
    ("mit", r"(?:the )?mit licen[sc]e|(?:the )?expat licen[sc]e|x11 licen[sc]e", (), "mit", r"opensource\.org/licen[sc]es?/mit"),
    ("isc", r"isc licen[sc]e", (), "isc", r"opensource\.org/licen[sc]es?/isc"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", (), "zlib", r"zlib\.net/zlib_license"),
    ("bsd-2-clause", r"(?:simplified bsd|2-clause bsd|bsd[- ]2[- ]clause|freebsd) licen[sc]e", (), "bsd-2-clause", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|3-clause bsd|bsd[- ]3[- ]clause) licen[sc]e", (), "bsd-3-clause", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd-4-clause", r"(?:original bsd|4-clause bsd|bsd[- ]4[- ]clause) licen[sc]e", (), "bsd-4-clause", r"directory\.fsf\.org/wiki/license:bsd[_-]4clause"),
    ("0bsd", r"(?:zero[- ]clause bsd|bsd[- ]zero[- ]clause) licen[sc]e", (), "0bsd", r"opensource\.org/licen[sc]es?/0bsd"),
    ("unlicense", r"the unlicense", (), "unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", ("2.0",), "wtfpl", r"wtfpl\.net"),
    ("ofl", r"(?:sil )?open font licen[sc]e", ("1.0", "1.1"), "ofl", r"(?:scripts\.sil\.org/ofl|openfontlicense\.org)"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", ("1.0",), "odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"open data commons attribution licen[sc]e", ("1.0",), "odc-by", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"public domain dedication and licen[sc]e", ("1.0",), "pddl", r"opendatacommons\.org/licenses/pddl"),
    ("psf", r"python software foundation licen[sc]e", ("2.0",), "psf", r"docs\.python\.org/[^ \n]*license"),
    ("php", r"php licen[sc]e", ("3.0", "3.01"), "php", r"php\.net/license"),
    ("ruby", r"ruby licen[sc]e", (), "ruby", r"ruby-lang\.org/[^ \n]*license"),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", (), "w3c", r"w3\.org/consortium/legal/[^ \n]*software"),
    ("qpl", r"q public licen[sc]e", ("1.0",), "qpl", r"opensource\.org/licen[sc]es?/qpl"),
    ("sspl", r"server side public licen[sc]e", ("1.0",), "sspl", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl", r"business source licen[sc]e", ("1.1",), "busl", r"mariadb\.com/bsl"),
    ("elastic", r"elastic licen[sc]e", ("2.0",), "elastic", r"elastic\.co/licensing/elastic-license"),
    ("ncsa", r"university of illinois/ncsa open source licen[sc]e", (), "ncsa", r"opensource\.org/licen[sc]es?/ncsa"),
    ("upl", r"universal permissive licen[sc]e", ("1.0",), "upl", r"opensource\.org/licen[sc]es?/upl"),
    ("vim", r"vim licen[sc]e", (), "vim", r"vimhelp\.org/uganda"),
    ("beerware", r"beer-?ware licen[sc]e", (), "beerware", r"people\.freebsd\.org/~phk"),
    ("cecill", r"cecill(?:-[bc])? (?:free software )?licen[sc]e", ("1.0", "2.0", "2.1"), "cecill", r"cecill\.info"),
    ("openrail", r"open(?:rail|[- ]rail)(?:[-+]{1,2}m)? licen[sc]e", (), "openrail", r"licenses\.ai"),
    ("cc0", r"cc0|creative commons zero", ("1.0",), "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", (), "public-domain", r"creativecommons\.org/publicdomain/mark"),
)
#: Parts of the Creative Commons names in the order they are written.
CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "share[- ]?alike", "nd": "no[- ]?deriv(?:ative)?s?(?: works)?", "nc": "non[- ]?commercial"}

#: Marks that lines of comments, quotes, boxes and underlined titles begin or end with.
MARKS = "*#/;%!>|=~_-"
#: Runs of white space and marks that may hold a line break, or white space other than one space.
GAP = re.compile(rf"(?:[\s{MARKS}]{{2,}}|[^\S ])(?:(?<=[\r\n])(?:dnl|rem)(?!\w)[\s{MARKS}]*)*")
WIDE = re.compile(r"\s{2,}|[^\S ]")
BREAK = re.compile(r"[\n\r\v\f\x85\u2028\u2029]")
VERSION_WORD = re.compile(r"(?:version|ver\.|v\.?) ?$")

GRANT = "permission is hereby granted, free of charge, to any person obtaining a copy of"
MIT_GRANT = rf"{GRANT} this software and associated documentation files(?: \(the \W{{1,3}}software\W{{1,3}}\))?,? to deal"
ISC_GRANT = "permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"
BSD_GRANT = "redistribution and use in source and binary forms,? with or without modification,? are permitted"
BSD_KEYWORD = "redistribution and use in source and binary forms"
#: Sentences of a clause on names: where it begins and ends, and what begins it anew.
ENDORSE_ALL, ENDORSE_NAME, ENDORSE_END = "neither the names? of", "names? ", "not be used to endorse"
FSF = r"general public licen[sc]e,? as published by the free software foundation[;,:]? (?:either )?"
#: Sentences of the licences themselves: pattern, label, priority and what any match holds.
SENTENCES = (
    (rf"{MIT_GRANT} in the software without restriction", "mit", 88, GRANT),
    (rf"{MIT_GRANT} with the software without restriction", "ncsa", 88, GRANT),
    (rf"{GRANT} the font software", "ofl", 88, GRANT),
    (r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0", 88, "to any person or organization obtaining"),
    (rf"{ISC_GRANT},? provided that the above copyright notice and this permission notice appear in all copies", "isc", 88, "with or without fee is hereby granted"),
    (rf"{ISC_GRANT}\.", "0bsd", 88, "with or without fee is hereby granted"),
    (BSD_GRANT, "bsd", 58, BSD_KEYWORD),
    (r"permission is granted to anyone to use this software for any purpose,? including commercial applications,? and to alter it and redistribute it freely", "zlib", 88, "permission is granted to anyone to use this software"),
    (r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of", "apache-2.0", 88, "each contributor hereby grants to you a perpetual"),
    (r"this is free and unencumbered software released into the public domain", "unlicense", 88, "free and unencumbered software"),
    (r"you just do what the fuck you want to", "wtfpl", 88, "you just do what the fuck"),
    (r"as long as you retain this notice you can do whatever you want with this stuff", "beerware", 88, "as long as you retain this notice"),
    (r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives", "cc0-1.0", 88, "affirmer hereby overtly"),
    (r"the licenses for most software are designed to take away your freedom to share and change it\. by contrast, the gnu general public license is intended", "gpl-2.0", 88, "designed to take away your freedom"),
    (r"the gnu general public license is a free, copyleft license for software and other kinds of works", "gpl-3.0", 88, "is a free, copyleft license"),
    (r"the gnu affero general public license is a free, copyleft license for software and other kinds of works", "agpl-3.0", 88, "is a free, copyleft license"),
    (r"this license, the library general public license, applies to", "lgpl-2.0", 88, "this license, the library general"),
    (r"this license, the lesser general public license, applies to", "lgpl-2.1", 88, "this license, the lesser general"),
    (r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lgpl-3.0", 88, "incorporates the terms and conditions of version 3"),
    (r"the intent of this document is to state the conditions under which a package may be copied", "artistic-1.0", 88, "conditions under which a package may be copied"),
    (r"this license establishes the terms under which a given free software package may be copied", "artistic-2.0", 88, "a given free software package"),
    (r"permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data", "upl-1.0", 88, "associated documentation and/or data"),
)


#: Conditions after a grant of the BSD kind, in their order, and the licence that they make.
#: ``endorse`` is the clause on names.
CONDITIONS = (
    (("in binary form must reproduce",), "bsd-2-clause", 86),
    (("endorse",), "bsd-3-clause", 87),
    (("all advertising materials mentioning", "endorse"), "bsd-4-clause", 88),
    (("all advertising materials mentioning", "apache group", "endorse"), "apache-1.0", 89),
    (("the end-user documentation included with the redistribution", "apache software foundation", "endorse"), "apache-1.1", 89),
)


class Rule(NamedTuple):
    keyword: str  #: stands in every text the pattern matches
    pattern: re.Pattern
    label: str
    priority: int  #: the larger wins where two detections overlap


def version_pattern(version: str) -> str:
    """``2.0`` is also written ``2``; group ``n`` is where the number begins."""
    whole, _, part = version.partition(".")
    return "(?P<n>)" + re.escape(whole) + (r"(?:\.0)?" if part == "0" else re.escape(f".{part}")) + r"(?![.\d]*\d)"


def literal_of(pattern: str) -> str:
    """The longest stretch of ``pattern`` that any match holds as it is, or an empty string."""
    if "|" in re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", pattern)):
        return ""
    plain = pattern
    while (inner := re.sub(r"\((?:[^()]*)\)[?*+]?", "\0", plain)) != plain:
        plain = inner
    plain = re.sub(r"\[[^\]]*\][?*+]?(?:\{[\d,]+\})?|.[?*]", "\0", plain.replace(r"\.", "\1"))
    return max((x.replace("\1", ".") for x in re.split(r"\0|\\.|[.^$+]", plain)), key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules: for each licence and version a tag, a place on the web, a title and a short name; then sentences.

    Group ``t`` is where a title ends that a number without ``version`` may follow.
    """
    made = []

    def add(pattern: str, label: str, priority: int, keyword: str = "") -> None:
        keyword = keyword or literal_of(pattern)
        made.append(Rule(keyword, re.compile(rf"(?<![a-z0-9]){pattern}"), label, priority))

    for stem, titles, versions, short, web in FAMILIES:
        for title in titles.split("|") if "(" not in titles else re.split(r"\|(?![^(]*\))", titles):
            for version in versions:
                add(rf"{title}(?P<t>),?(?: \(?[a-z]*\)?,?)? ?(?:version|ver\.|v\.?)? ?{version_pattern(version)}", f"{stem}-{version}", 80)
            add(rf"{title}", stem, 60)
            add(rf"(?:licen[sc]ed|distributed|released|available) under (?:the )?(?:terms of )?(?:the )?(?:{title})", stem, 65)
        for version in versions:
            add(rf"spdx-license-identifier: *{re.escape(short)}-{re.escape(version)}(?:-only|-or-later|\+)?", f"{stem}-{version}", 100, "spdx-license-identifier")
            add(rf"{re.escape(short)}(?P<t>)[- ]?v?{version_pattern(version)}", f"{stem}-{version}", 70, short)
            add(rf"{web}[^ \n]*{re.escape(version)}", f"{stem}-{version}", 92)
        add(rf"spdx-license-identifier: *{re.escape(short)}(?![\w.-])", stem, 98, "spdx-license-identifier")
        add(web, stem, 90)
    for parts in CC_PARTS:
        words = "[- ,]+".join(CC_WORDS[x] for x in parts.split("-"))
        dashed = parts.replace("-", "[- ]")
        for version in CC_VERSIONS:
            add(rf"spdx-license-identifier: *cc-{parts}-{re.escape(version)}", f"cc-{parts}-{version}", 100, "spdx-license-identifier")
            add(rf"creativecommons\.org/licenses/{parts}/{re.escape(version)}", f"cc-{parts}-{version}", 92)
            add(rf"cc[- ]{dashed}(?P<t>)[- ]?v?{version_pattern(version)}", f"cc-{parts}-{version}", 72, "cc")
            add(rf"creative commons {words}(?P<t>) (?:licen[sc]e )?(?:version )?{version_pattern(version)}", f"cc-{parts}-{version}", 82)
            add(rf"creative commons {words} {re.escape(version)} (?:international|unported|generic) licen[sc]e", f"cc-{parts}-{version}", 84)
        add(rf"creativecommons\.org/licenses/{parts}(?![-\w])", f"cc-{parts}", 90)
        add(rf"cc[- ]{dashed}(?![-\w])", f"cc-{parts}", 62, "cc")
        add(rf"creative commons {words}", f"cc-{parts}", 64)
    for stem, before, versions in (("gpl", "(?:gnu )?", ("1.0", "2.0", "3.0")), ("lgpl", "(?:gnu )?(?:lesser|library) ", ("2.0", "2.1", "3.0")), ("agpl", "(?:gnu )?affero ", ("3.0",))):
        for version in versions:
            add(rf"{before}{FSF}version {version_pattern(version)}", f"{stem}-{version}", 85, "published by the free software foundation")
    for sentence in SENTENCES:
        add(*sentence)
    return tuple(made)


def folds(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a line ends) of the stretches of ``text`` that count as one space.

    A line break takes the marks around it along, but not those that stand at a word's end.
    """
    for gap in GAP.finditer(text):
        run, start = gap[0], gap.start()
        if BREAK.search(run):
            yield start + len(run) - len(run.lstrip(MARKS)), gap.end(), True
        else:
            for wide in WIDE.finditer(run):
                yield start + wide.start(), start + wide.end(), False


class Folded:
    """A text with its folds made, and the way back to its own offsets."""

    def __init__(self, text: str):
        parts, at, made = [], 0, 0
        self.after, self.shift, self.breaks = [0], [0], []
        for start, end, ends_line in folds(text):
            parts += (text[at:start], " ")
            made += start - at + 1
            at = end
            self.after.append(made)
            self.shift.append(end - made)
            if ends_line:
                self.breaks.append(made - 1)
        self.text = "".join([*parts, text[at:]]) if parts else text

    def origin(self, at: int) -> int:
        """Where the character at ``at`` stands in the text itself."""
        return at + self.shift[bisect_right(self.after, at) - 1]

    def is_number_apart(self, m: re.Match) -> bool:
        """Whether a match's number is on another line than its title and is not called a version."""
        if not self.breaks or "t" not in m.re.groupindex:
            return False
        n = m.start("n")
        return bisect_right(self.breaks, n - 1) > bisect_right(self.breaks, m.end("t") - 1) and not VERSION_WORD.search(self.text[m.start() : n])


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int


STARTS = re.compile(rf"(?<![a-z0-9])(?P<grant>{BSD_GRANT})|(?P<stop>this software is provided)")
CLAUSE = re.compile(rf"(?P<all>{ENDORSE_ALL})|(?P<name>{ENDORSE_NAME})|(?P<end>{ENDORSE_END})|(?P<stop>\. )")


def clause_ends(text: str) -> tuple[list[int], list[int]]:
    """Where clauses on names begin and end, both in order; of the names in a sentence the last one counts."""
    starts, ends, name = [], [], None
    for m in CLAUSE.finditer(text):
        if m["all"]:
            starts.append(m.start())
            ends.append(m.end())
            name = None
        elif m["stop"]:
            name = None
        elif m["name"]:
            name = m.start()
        elif name is not None:
            starts.append(name)
            ends.append(m.end())
            name = None
    return starts, ends


def conditions(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, label, priority) of grants of the BSD kind with the conditions that follow them.

    A grant's conditions reach to the next grant or to the disclaimer, however far that is;
    each text between is searched once for each licence.
    """
    if BSD_KEYWORD not in text:
        return
    marks = list(STARTS.finditer(text))
    starts, ends = clause_ends(text)
    for i, m in enumerate(marks):
        if not m["grant"]:
            continue
        stop = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        for phrases, label, priority in CONDITIONS:
            at = m.end()
            for phrase in phrases:
                if phrase == "endorse":
                    k = bisect_left(starts, at)
                    found = ends[k] if k < len(starts) and ends[k] <= stop else -1
                else:
                    found = text.find(phrase, at, stop)
                    found = found + len(phrase) if found >= 0 else -1
                at = found
                if at < 0:
                    break
            if at >= 0:
                yield m.start(), at, label, priority


def settled(found: list[Detection]) -> list[Detection]:
    """Detections by priority; one inside a stretch already taken by a better one is left out.

    Ties go to the longer stretch, then the earlier one, then the label that sorts first. A
    tree over the starts holds the furthest end before each, so n detections take n log n.
    """
    order = sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label))
    places = {start: i + 1 for i, start in enumerate(sorted({d.start for d in order}))}
    furthest = [-1] * (len(places) + 1)
    kept: list[Detection] = []
    for d in order:
        i, end = places[d.start], -1
        while i > 0:
            end = max(end, furthest[i])
            i -= i & -i
        if end >= d.end:
            continue
        kept.append(d)
        i = places[d.start]
        while i < len(furthest):
            furthest[i] = max(furthest[i], d.end)
            i += i & -i
    return sorted(kept)


class Scanner:
    def __init__(self, ruleset: tuple[Rule, ...]):
        self.rules = ruleset
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(ruleset):
            by_keyword.setdefault(rule.keyword, []).append(i)
        self.always = by_keyword.pop("", [])
        self.keywords = ahocorasick.Automaton()
        for keyword, ids in by_keyword.items():
            self.keywords.add_word(keyword, tuple(ids))
        self.keywords.make_automaton()

    def detections(self, lowered: str) -> list[Detection]:
        folded = Folded(lowered)
        gated = {ids for _, ids in self.keywords.iter(folded.text)}
        found = []
        for i in sorted({*self.always, *(i for ids in gated for i in ids)}):
            rule = self.rules[i]
            for m in rule.pattern.finditer(folded.text):
                if not folded.is_number_apart(m):
                    found.append(Detection(folded.origin(m.start()), folded.origin(m.end() - 1) + 1, rule.label, rule.priority))
        for start, end, label, priority in conditions(folded.text):
            found.append(Detection(folded.origin(start), folded.origin(end - 1) + 1, label, priority))
        return settled(found)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


@lru_cache(maxsize=1)
def base_phrases() -> tuple[tuple[np.ndarray, list[bytes], str], ...]:
    return tuple((words_of(texts_of(pa.array([p]))).hash, p.encode().split(), label) for p, label in BASE.items())


def base_places(words: Words) -> list[tuple[int, str]]:
    """(word of the batch where a phrase begins, its label); phrases do not run over two texts."""
    places = []
    for hashes, spelled, label in base_phrases():
        n = len(hashes)
        if len(words.hash) < n:
            continue
        same = np.ones(len(words.hash) - n + 1, bool)
        for i, h in enumerate(hashes):
            same &= words.hash[i : len(words.hash) - n + 1 + i] == h
        for at in np.flatnonzero(same).tolist():
            text = np.searchsorted(words.first, at, side="right") - 1
            if at + n <= words.first[text + 1] and [words.word(at + i) for i in range(n)] == spelled:
                places.append((at, label))
    return places


LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame) -> DataFrame:
    """License findings of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    detections (code-point spans with label and priority, after overlaps are settled). A null
    or empty text has no words, no places, empty labels and score 0; rows stand for
    themselves, so repeated ones give repeated results; an empty table gives no rows; other
    columns are not read. A label that a base phrase gave always stays. A text of any length
    is scanned whole. The rules read runs of white space, and line breaks
    with the comment marks around them, as one space.
    """

    def run(batches):
        scans = scanner()
        for batch in batches:
            for part in pieces(batch):
                texts = texts_of(part.column("text"))
                words = words_of(texts)
                base: dict[int, list[tuple[int, str]]] = {}
                for at, label in base_places(words):
                    text = int(np.searchsorted(words.first, at, side="right")) - 1
                    base.setdefault(text, []).append((at - int(words.first[text]), label))
                rows = []
                for i, text in enumerate(texts):
                    lowered = text.as_py().translate(LOWER_ASCII)
                    found, places = scans.detections(lowered), base.get(i, [])
                    at, own = [p[0] for p in places], {p[1] for p in places}
                    rows.append(
                        {
                            "n_words": int(words.first[i + 1] - words.first[i]),
                            "n_base": len(places),
                            "first_word": min(at, default=None),
                            "last_word": max(at, default=None),
                            "base_labels": ",".join(sorted(own)),
                            "labels": ",".join(sorted(own | {d.label for d in found})),
                            "score": max([BASE_SCORE * bool(places), *(d.priority / 100 for d in found)]),
                            "detections": [d._asdict() for d in found],
                        }
                    )
                made = pa.Table.from_pylist(rows, SCAN)
                yield from made.add_column(0, "doc_id", pa.chunked_array([part.column("doc_id")])).combine_chunks().to_batches()

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections array<struct<start:long,end:long,label:string,priority:long>>"
    )
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())])
SCAN = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(SPAN))]
)
