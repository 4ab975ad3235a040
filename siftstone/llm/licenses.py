"""License scans by ordered signature rules.

A text is taken as words: A-Z in lower case, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`,
joined by single spaces. Rules are regexes over that form, in order of priority.
Each names a keyword without which it cannot match; one pass of an Aho-Corasick
automaton over the text finds the keywords, and only their rules run. Detections
are then sifted: one that lies within another of higher priority goes, and of one
priority so does one that lies within another. The base phrases are rules too, but
nothing suppresses them.

A null text counts as empty: no words, no labels, score 0. Repeated rows give
repeated results; an empty table gives no rows. Texts of any length are scanned whole. Extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import id_and_text

#: Base phrases and their labels. Fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int  # 0 is the highest
    weight: float


#: Families whose license comes in versions: label, names (regexes over words), versions, weight.
VERSIONED = (
    ("gpl", ("gnu general public licen[sc]e", "general public licen[sc]e", "gnu gpl", "gpl"), ("1 0", "1", "2 0", "2", "3 0", "3"), 0.9),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "lesser general public licen[sc]e", "gnu lgpl", "lgpl"), ("2 0", "2", "2 1", "3 0", "3"), 0.9),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl", "agpl"), ("1 0", "1", "3 0", "3"), 0.9),
    ("fdl", ("gnu free documentation licen[sc]e", "free documentation licen[sc]e", "gfdl"), ("1 1", "1 2", "1 3"), 0.9),
    ("apache", ("apache software licen[sc]e", "apache licen[sc]e", "apache"), ("1 0", "1 1", "2 0", "2"), 0.9),
    ("mpl", ("mozilla public licen[sc]e", "mpl"), ("1 0", "1 1", "2 0"), 0.9),
    ("epl", ("eclipse public licen[sc]e", "epl"), ("1 0", "2 0"), 0.9),
    ("eupl", ("european union public licen[sc]e", "eupl"), ("1 0", "1 1", "1 2"), 0.9),
    ("cddl", ("common development and distribution licen[sc]e", "cddl"), ("1 0", "1 1"), 0.9),
    ("cpl", ("common public licen[sc]e",), ("0 5", "1 0"), 0.8),
    ("artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e"), ("1 0", "2 0"), 0.8),
    ("bsl", ("boost software licen[sc]e", "bsl"), ("1 0",), 0.9),
    ("busl", ("business source licen[sc]e",), ("1 0", "1 1"), 0.9),
    ("osl", ("open software licen[sc]e",), ("1 0", "2 0", "2 1", "3 0"), 0.8),
    ("afl", ("academic free licen[sc]e",), ("1 1", "2 0", "2 1", "3 0"), 0.8),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("1 0", "1 1"), 0.9),
    ("zpl", ("zope public licen[sc]e",), ("1 1", "2 0", "2 1"), 0.8),
    ("php", ("php licen[sc]e",), ("3 0", "3 01"), 0.8),
    ("psf", ("python software foundation licen[sc]e", "psf licen[sc]e"), ("2",), 0.8),
    ("lppl", ("latex project public licen[sc]e", "lppl"), ("1 0", "1 2", "1 3", "1 3c"), 0.8),
    ("cecill", ("cecill(?: free software licen[sc]e(?: agreement)?)?",), ("1 0", "2 0", "2 1"), 0.8),
    ("odbl", ("open database licen[sc]e", "odbl"), ("1 0",), 0.8),
    ("ms-pl", ("microsoft public licen[sc]e", "ms pl"), ("1 0",), 0.8),
    ("ms-rl", ("microsoft reciprocal licen[sc]e", "ms rl"), ("1 0",), 0.8),
    ("sspl", ("server side public licen[sc]e", "sspl"), ("1", "1 0"), 0.9),
    ("upl", ("universal permissive licen[sc]e",), ("1 0",), 0.8),
    ("ecl", ("educational community licen[sc]e",), ("1 0", "2 0"), 0.8),
    ("rpl", ("reciprocal public licen[sc]e",), ("1 1", "1 5"), 0.8),
    ("qpl", ("q public licen[sc]e",), ("1 0",), 0.8),
    ("apsl", ("apple public source licen[sc]e",), ("1 0", "1 1", "1 2", "2 0"), 0.8),
)
#: Creative Commons parts by word; the versions that were published.
CC_PARTS = (("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Single rules, by label, keyword, regex and weight; wording of well-known license texts and notices.
PLAIN = (
    ("mit", "mit", "mit licen[sc]e", 0.9),
    ("mit", "mit", "licen[sc]ed under (?:the )?mit", 0.9),
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "copies or substantial", "shall be included in all copies or substantial portions of the software", 0.9),
    ("mit-0", "mit no attribution", "mit no attribution", 0.9),
    ("x11", "x11 licen", "x11 licen[sc]e", 0.8),
    ("isc", "isc licen", "isc licen[sc]e", 0.9),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?", 0.9),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?", 0.9),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", 0.9),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?", 0.9),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", 0.8),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software", 0.9),
    ("zlib", "zlib", "zlib (?:libpng )?licen[sc]e", 0.8),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented", 1.0),
    ("unlicense", "unlicense", "(?:the )?unlicense", 0.8),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "wtfpl", "wtfpl", 0.8),
    ("beerware", "beerware", "beerware licen[sc]e", 0.7),
    ("cc0", "cc0", "(?:cc0 1 0(?: universal)?|cc0)", 0.9),
    ("public-domain", "public domain", "(?:dedicated to|released into|placed in|in) the public domain", 0.7),
    ("public-domain", "public domain", "public domain (?:dedication|mark)", 0.8),
    ("apache-2.0", "apache org", "(?:http |https )?(?:www )?apache org licenses license 2 0", 1.0),
    ("apache-2.0", "as is basis", "distributed on an as is basis without warranties or conditions of any kind", 0.8),
    ("gpl", "free software foundation", "under the terms of the gnu general public licen[sc]e as published by the free software foundation", 1.0),
    ("gpl-2.0-or-later", "any later version", "either version 2 of the licen[sc]e or at your option any later version", 1.0),
    ("gpl-3.0-or-later", "any later version", "either version 3 of the licen[sc]e or at your option any later version", 1.0),
    ("lgpl-2.1-or-later", "any later version", "either version 2 1 of the licen[sc]e or at your option any later version", 1.0),
    ("gpl", "gnu org", "(?:www )?gnu org (?:licenses|copyleft) gpl", 0.9),
    ("lgpl", "gnu org", "(?:www )?gnu org licenses lgpl", 0.9),
    ("agpl", "gnu org", "(?:www )?gnu org licenses agpl", 0.9),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1.0),
    ("openssl", "openssl", "openssl licen[sc]e", 0.8),
    ("curl", "curl licen", "curl licen[sc]e", 0.7),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", 0.8),
    ("postgresql", "postgresql licen", "postgresql licen[sc]e", 0.8),
    ("vim", "vim licen", "vim licen[sc]e", 0.7),
    ("ruby", "ruby licen", "ruby licen[sc]e", 0.7),
    ("hpnd", "hpnd", "hpnd", 0.7),
    ("hpnd", "historical permission", "historical permission notice and disclaimer", 0.7),
    ("json", "not evil", "shall be used for good not evil", 1.0),
    ("proprietary", "proprietary", "proprietary and confidential", 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution) (?:of this (?:file|work|document) )?(?:via any medium )?is (?:strictly )?prohibited", 0.9),
    ("proprietary", "prior written", "without (?:the )?(?:express )?prior written (?:permission|consent)", 0.6),
    ("proprietary", "trade secret", "trade secrets? (?:of|and)", 0.4),
    ("warranty-disclaimer", "as is", "(?:provided|distributed|licensed) as is", 0.4),
    ("warranty-disclaimer", "warrant", "without (?:any )?warrant(?:y|ies)", 0.4),
    ("reserved", "rights", "(?:all|some|no) rights (?:are )?reserved", 0.6),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 0.5),
    ("copyright", "copyright", "copyright c", 0.4),
    ("copyright", "©", "©(?: ?(?:19|20)[0-9][0-9])?", 0.4),
    ("dual", "dual licen", "dual licen[sc]ed", 0.5),
    ("licensed-under", "licen", "(?:licen[sc]ed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?[^ ]+(?: [^ ]+)? licen[sc]e", 0.5),
    ("terms-of-use", "terms of use", "(?:subject to|see|by) (?:the )?terms of use", 0.3),
)
#: Identifiers after "spdx license identifier".
SPDX = ("mit", "isc", "0bsd", "bsd 2 clause", "bsd 3 clause", "apache 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 2 0", "epl 2 0", "unlicense", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "zlib", "bsl 1 0", "eupl 1 2")


def _dotted(version: str) -> str:
    return version.replace(" ", ".")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, several hundred, most specific first."""
    out: list[tuple[str, str, str, int, float]] = []
    for ident in SPDX:
        out.append((ident.replace(" only", "").replace(" ", "-"), "spdx", f"spdx license identifier {ident}", 0, 1.0))
    for label, names, versions, weight in VERSIONED:
        for name in names:
            keyword = re.split(r"licen|\(|\[", name)[0].strip()
            for v in versions:
                full = label if label in ("bsl",) and v == "1" else f"{label}-{_dotted(v)}"
                out.append((full, keyword, f"{name}(?: v| version| v ?|) ?{v}(?: or (?:any )?(?:later|newer)(?: version)?)?", 1, weight))
            # a short name alone says less
            out.append((label, keyword, name, 3, weight - (0.2 if len(name) > 4 else 0.4)))
    for ident, short, words in CC_PARTS:
        for v in CC_VERSIONS:
            out.append((f"cc-{ident}-{_dotted(v)}", "cc by", f"cc {short} {v}", 1, 1.0))
            out.append((f"cc-{ident}-{_dotted(v)}", "creative commons", f"creative commons {words}(?: {v})?(?: international| unported| generic)?(?: {v})(?: international| unported| generic)?(?: licen[sc]e)?", 1, 1.0))
            out.append((f"cc-{ident}-{_dotted(v)}", "creativecommons", f"creativecommons org licenses {short} {v}", 1, 1.0))
        out.append((f"cc-{ident}", "cc by", f"cc {short}", 2, 0.8))
        out.append((f"cc-{ident}", "creative commons", f"creative commons {words}(?: licen[sc]e)?", 2, 0.9))
    out.extend((label, keyword, pattern, 2, weight) for label, keyword, pattern, weight in PLAIN)
    # Longer wording before shorter at the same priority: Creative Commons parts have a common beginning.
    made = [Rule(a, k.encode(), re.compile(rb"(?<![^ ])(?:" + p.encode() + rb")(?![^ ])"), q, w) for a, k, p, q, w in out]
    return tuple(sorted(made, key=lambda r: (r.priority, -len(r.pattern.pattern))))


@cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for k, r in enumerate(rules()):
        by.setdefault(r.keyword.decode(), []).append(k)
    for word, numbers in by.items():
        machine.add_word(word, numbers)
    machine.make_automaton()
    return machine


def words_form(text: bytes) -> tuple[int, bytes]:
    """The number of words, and the words joined by single spaces."""
    words = text.translate(_FOLD).split()
    return len(words), b" ".join(words)


def base_places(form: bytes) -> list[tuple[int, str]]:
    """Word numbers at which base phrases start, with their labels; overlapping ones too."""
    out = []
    for phrase, label in BASE:
        p = phrase.encode()
        at, number, counted = form.find(p), 0, 0
        while at >= 0:
            end = at + len(p)
            number, counted = number + form.count(b" ", counted, at), at
            if (at == 0 or form[at - 1] == 32) and (end == len(form) or form[end] == 32):
                out.append((number, label))
            at = form.find(p, at + 1)
    return out


def detections(form: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of all detections that nothing suppresses, by place."""
    wanted: set[int] = set()
    for _, numbers in _automaton().iter(form.decode("utf-8", "replace")):
        wanted.update(numbers)
    found: dict[int, list[tuple[int, int, Rule]]] = {}
    for k in sorted(wanted):
        rule = rules()[k]
        found.setdefault(rule.priority, []).extend((m.start(), m.end(), rule) for m in rule.pattern.finditer(form))
    kept: list[tuple[int, int, Rule]] = []
    for priority in sorted(found):
        # of what is kept so far: where it begins, and how far all that begins no later reaches
        begins = [d[0] for d in kept]
        reaches = list(accumulate((d[1] for d in kept), max))
        reach = -1
        new = []
        for start, end, rule in sorted(found[priority], key=lambda d: (d[0], -d[1])):
            k = bisect_right(begins, start)
            if end > reach and not (k and reaches[k - 1] >= end):
                new.append((start, end, rule))
                reach = end
        kept = sorted(kept + new, key=lambda d: d[:2])
    return kept


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,n_words:long>>"


def scan_text(text: bytes) -> tuple:
    n, form = words_form(text)
    base = base_places(form)
    found = detections(form)
    miss = 1.0
    for _, _, rule in found:
        miss *= 1.0 - min(rule.weight, 0.95)
        if miss < 1e-12:
            break
    miss *= 0.5 ** len(base)
    places = [p for p, _ in base]
    base_labels = {label for _, label in base}
    spans, number, counted = [], 0, 0
    for a, b, rule in found:
        number, counted = number + form.count(b" ", counted, a), a
        spans.append({"label": rule.label, "first_word": number, "n_words": form.count(b" ", a, b) + 1})
    return n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {r.label for _, _, r in found})), 1.0 - miss, spans


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, with the detections that stayed; no shuffle."""

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch in batches:
            rows = [scan_text(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
