"""License texts and notices in documents, by ordered signature rules.

A text becomes its words joined by single spaces. A rule is a regular expression over that, with the
words that any match must contain; only texts that have them are searched. Detections inside a
detection of higher priority, or inside a longer one of the same, are suppressed.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lexigauge.llm.common import letter_words, map_pieces, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGEST = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)
SPANS = "doc_id bigint, label string, rule string, priority int, first_word bigint, end_word bigint"

# Fixed values of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label; how a sentence names the license; how an identifier does; its address.
LICENSES = """
mit | mit | mit | opensource org licenses mit
mit-0 | mit no attribution | mit 0 | opensource org licenses mit 0
apache-1.1 | apache software license(?: version)? 1 1 | apache 1 1 | apache org licenses license 1 1
apache-2 | apache(?: software)?(?: license)?(?: version)? 2(?: 0)? | apache 2 0 | apache org licenses license 2 0
bsd-2-clause | (?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause) | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | (?:new bsd|modified bsd|revised bsd|(?:3|three) clause bsd|bsd (?:3|three) clause) | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | (?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause) | bsd 4 clause | spdx org licenses bsd 4 clause
0bsd | (?:zero clause bsd|bsd zero clause|0bsd) | 0bsd | opensource org licenses 0bsd
isc | isc | isc | opensource org licenses isc
gpl-1 | (?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)? | gpl 1 0 | gnu org licenses old licenses gpl 1 0
gpl-2 | (?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)? | gpl 2 0 | gnu org licenses old licenses gpl 2 0
gpl-3 | (?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)? | gpl 3 0 | gnu org licenses gpl 3 0
lgpl-2 | (?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)? | lgpl 2 0 | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | (?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1 | lgpl 2 1 | gnu org licenses old licenses lgpl 2 1
lgpl-3 | (?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)? | lgpl 3 0 | gnu org licenses lgpl 3 0
agpl-3 | (?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)? | agpl 3 0 | gnu org licenses agpl 3 0
gfdl-1.3 | (?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1 3 | gfdl 1 3 | gnu org licenses fdl 1 3
mpl-1.1 | (?:mpl|mozilla public license)(?: version| v)? ?1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2 | (?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
epl-1 | (?:epl|eclipse public license)(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2 | (?:epl|eclipse public license)(?: version| v)? ?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0
cddl-1 | (?:cddl|common development and distribution license)(?: version| v)? ?1(?: 0)? | cddl 1 0 | opensource org licenses cddl 1 0
cpl-1 | common public license(?: version| v)? ?1(?: 0)? | cpl 1 0 | opensource org licenses cpl 1 0
eupl-1.2 | (?:eupl|european union public licen[cs]e)(?: version| v)? ?1 2 | eupl 1 2 | joinup ec europa eu collection eupl
artistic-1 | artistic license(?: version)? 1(?: 0)? | artistic 1 0 | opensource org licenses artistic 1 0
artistic-2 | artistic license(?: version)? 2(?: 0)? | artistic 2 0 | opensource org licenses artistic 2 0
bsl-1 | boost software license(?: version)? 1(?: 0)? | bsl 1 0 | boost org license 1 0
zlib | zlib(?: libpng)? | zlib | opensource org licenses zlib
unlicense | unlicense | unlicense | unlicense org
wtfpl | (?:wtfpl|do what the fuck you want to public license) | wtfpl | wtfpl net
ms-pl | (?:ms pl|microsoft public license) | ms pl | opensource org licenses ms pl
ms-rl | (?:ms rl|microsoft reciprocal license) | ms rl | opensource org licenses ms rl
ofl-1.1 | (?:ofl|open font license)(?: version)? 1 1 | ofl 1 1 | scripts sil org ofl
python-2 | (?:python software foundation|psf) license(?: version)? 2 | python 2 0 | docs python org 3 license
postgresql | postgresql | postgresql | opensource org licenses postgresql
openssl | openssl | openssl | openssl org source license
vim | vim | vim | vimhelp org uganda
odbl-1 | (?:odbl|open database license)(?: version| v)? ?1(?: 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1 | (?:odc by|open data commons attribution license) | odc by 1 0 | opendatacommons org licenses by
pddl-1 | (?:pddl|public domain dedication and license) | pddl 1 0 | opendatacommons org licenses pddl
cc0-1 | (?:cc0|creative commons zero)(?: 1 0)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by | (?:cc by|creative commons attribution)(?: [1-4] [05])? | cc by [1-4] [05] | creativecommons org licenses by [1-4] [05]
cc-by-sa | (?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])? | cc by sa [1-4] [05] | creativecommons org licenses by sa
cc-by-nd | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])? | cc by nd [1-4] [05] | creativecommons org licenses by nd
cc-by-nc | (?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])? | cc by nc [1-4] [05] | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])? | cc by nc sa [1-4] [05] | creativecommons org licenses by nc sa
cc-by-nc-nd | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])? | cc by nc nd [1-4] [05] | creativecommons org licenses by nc nd
openrail-m | (?:open ?rail m|responsible ai license) | openrail m | licenses ai
elastic-2 | elastic license(?: version)? 2(?: 0)? | elastic 2 0 | elastic co licensing elastic license
sspl-1 | (?:sspl|server side public license)(?: version| v)? ?1 | sspl 1 0 | mongodb com licensing server side public license
busl-1.1 | business source license(?: version)? 1 1 | busl 1 1 | mariadb com bsl11
polyform-nc-1 | polyform non ?commercial(?: license)? 1(?: 0 0)? | polyform noncommercial 1 0 0 | polyformproject org licenses noncommercial
"""

# label; sentence of the license's own text.
SENTENCES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions
apache-2 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
bsd-2-clause | redistributions of source code must retain the above copyright notice this list of conditions
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause | neither the name of (?:the )?(?:\\S+ ){1,8}nor the names of its contributors may be used to endorse
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement
isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
gpl-2 | under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3 | under the terms of the gnu general public license as published by the free software foundation either version 3
lgpl-2.1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3
agpl-3 | under the terms of the gnu affero general public license as published by the free software foundation
gfdl-1.3 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
epl-1 | the accompanying materials are provided under the terms of this eclipse public license
cddl-1 | the contents of this file are subject to the terms of the common development and distribution license
bsl-1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | permission is granted to anyone to use this software for any purpose including commercial applications
unlicense | this is free and unencumbered software released into the public domain
ofl-1.1 | this font software is licensed under the sil open font license
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
cc0-1 | to the extent possible under law (?:\\S+ ){1,12}has waived all copyright and related or neighboring rights
cc-by | this work is licensed under a creative commons attribution
odbl-1 | made available under the open database license
pddl-1 | made available under the public domain dedication and license
proprietary | all rights reserved
proprietary | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|work|material|document) (?:\\S+ ){0,6}is strictly prohibited
proprietary | proprietary and confidential
public-domain | (?:dedicated to|released into|placed in|in) the public domain
non-commercial | for (?:personal )?non ?commercial use only
no-ai-training | (?:may not|must not|shall not) be used (?:for|to) train(?:ing)? (?:\\S+ ){0,4}(?:ai|models?|machine learning)
"""

_GROUP = re.compile(r"\(\?:([^()]*)\)(?:[?*]|\{[\d,]+\})?")


def gate_words(pattern: str) -> frozenset[bytes]:
    """Words that every match of the pattern holds: those outside of groups, unless one is glued to
    a group or to an optional space."""

    def flat(m: re.Match) -> str:
        parts = m[1].split("|")
        apart = all(p.endswith(" ") for p in parts) or all(p.startswith(" ") for p in parts)
        return " " if apart else "~"

    plain = pattern.replace(" ?", "~")
    while (less := _GROUP.sub(flat, plain)) != plain:
        plain = less
    return frozenset(w.encode() for w in plain.split() if re.fullmatch("[a-z0-9]+", w))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    gate: frozenset[bytes]
    pattern: bytes


def rules() -> list[Rule]:
    """All rules, the highest priority first."""
    made = []

    def add(kind: str, label: str, priority: int, pattern: str) -> None:
        body = f" (?:{pattern})(?= )".encode()
        made.append(Rule(f"{kind}:{label}:{len(made)}", label, priority, gate_words(pattern), body))

    for line in LICENSES.strip().splitlines():
        label, name, ident, address = (x.strip() for x in line.split(" | "))
        add("identifier", label, 100, f"spdx license identifier {ident}")
        add("address", label, 90, f"(?:https? )?(?:www )?{address}")
        add("grant", label, 80, f"(?:licen[cs]ed|released|distributed|available|provided|published|covered|shared|redistributed) under (?:the |a )?(?:terms of (?:the )?)?{name}(?: international)?(?: licen[cs]e)?")
        add("named", label, 60, f"{name}(?: international)? licen[cs]e")
        add("stated", label, 60, f"licen[cs]e {ident}")
    for line in SENTENCES.strip().splitlines():
        label, sentence = (x.strip() for x in line.split(" | ", 1))
        add("text", label, 40 if len(sentence.split()) < 6 else 85, sentence)
    for phrase, label in BASE:
        add("base", label, 50, phrase)
    return sorted(made, key=lambda r: -r.priority)


class Scanner:
    """Rules ready to run, by one of their gate words."""

    def __init__(self) -> None:
        self.rules = [(r, re.compile(r.pattern)) for r in rules()]
        self.by_word: dict[bytes, list[int]] = {}
        self.open: list[int] = []  # without a word that must occur
        rarity = sorted({w for r, _ in self.rules for w in r.gate}, key=lambda w: (sum(w in r.gate for r, _ in self.rules), w))
        place = {w: k for k, w in enumerate(rarity)}
        for k, (rule, _) in enumerate(self.rules):
            if rule.gate:
                self.by_word.setdefault(min(rule.gate, key=place.get), []).append(k)
            else:
                self.open.append(k)
        self.words = frozenset(self.by_word)
        self.base = [(f" {p} ".encode(), label) for p, label in BASE]

    def candidates(self, words: list[bytes], line: bytes) -> list[int]:
        found = self.words.intersection(words)
        picked = [k for w in found for k in self.by_word[w]]
        if b"licen" in line:  # rules without gate words all say license or licence
            picked += self.open
        have = set(words) if picked else ()
        return sorted(k for k in picked if self.rules[k][0].gate.issubset(have))

    def detections(self, words: list[bytes], line: bytes) -> list[tuple[int, int, Rule]]:
        """All matches as (first word, end word, rule)."""
        out, blanks = [], None
        for k in self.candidates(words, line):
            rule, pattern = self.rules[k]
            places = np.array([m.span() for m in pattern.finditer(line)], np.int64).reshape(-1, 2)
            if len(places):
                blanks = _blanks(line) if blanks is None else blanks
                first, end = np.searchsorted(blanks, places).T.tolist()
                out += [(a, b, rule) for a, b in zip(first, end, strict=True)]
        return out

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """Places of the base phrases; they may overlap."""
        out, blanks = [], None
        for phrase, label in self.base:
            places, at = [], line.find(phrase)
            while at >= 0:
                places.append(at)
                at = line.find(phrase, at + 1)
            if places:
                blanks = _blanks(line) if blanks is None else blanks
                out += [(k, label) for k in np.searchsorted(blanks, places).tolist()]
        return out


def _blanks(line: bytes) -> np.ndarray:
    """Where the blanks of a line are: the k-th stands before word k."""
    return np.flatnonzero(np.frombuffer(line, np.uint8) == 32)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no better one contains: better by priority, then longer, then first by name."""
    kept: list[tuple[int, int, Rule]] = []
    for group in _overlapping(found):
        # those kept so far that no other of them contains: both starts and ends rise
        starts, ends = [], []
        for first, end, rule in sorted(group, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
            at = bisect_right(starts, first)
            if at and ends[at - 1] >= end:
                continue
            kept.append((first, end, rule))
            low, high = bisect_left(starts, first), bisect_right(ends, end)
            starts[low:high], ends[low:high] = [first], [end]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def _overlapping(found: list[tuple[int, int, Rule]]) -> Iterator[list[tuple[int, int, Rule]]]:
    """The detections in groups that no other group overlaps."""
    group, reach = [], 0
    for d in sorted(found, key=lambda d: d[0]):
        if group and d[0] >= reach:
            yield group
            group = []
        group.append(d)
        reach = max(reach, d[1])
    if group:
        yield group


def _line(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def license_spans(docs: DataFrame) -> DataFrame:
    """One row for each detection that is not suppressed, words from 0."""

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        scanner, rows = Scanner(), []
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts_of(piece), strict=True):
            words = letter_words(text)
            for first, end, rule in suppress(scanner.detections(words, _line(words))):
                rows.append((doc_id, rule.label, rule.name, rule.priority, first, end))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["doc_id", "label", "rule", "priority", "first_word", "end_word"])

    return map_pieces(docs.select("doc_id", "text"), f, SPANS)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: places of the base phrases, labels, and a score.

    ``score`` is the highest priority of a detection over 100, 0 without any. A null or empty text
    has no words and no labels. Base labels stay even where a rule suppresses their place. Repeated
    rows each get their row; other columns are not looked at.
    """

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        scanner, rows = Scanner(), []
        for text in texts_of(piece):
            words = letter_words(text)
            line = _line(words)
            base = scanner.base_places(line)
            found = suppress(scanner.detections(words, line))
            at, own = [p for p, _ in base], {label for _, label in base}
            best = max([r.priority for _, _, r in found], default=0)
            rows.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                         ",".join(sorted(own | {r.label for _, _, r in found})), best / 100))
        columns = zip(*rows, strict=True)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_pieces(docs.select("doc_id", "text"), f, DIGEST)
