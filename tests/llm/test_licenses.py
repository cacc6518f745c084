import random
import re
import time

from lexigauge.llm import licenses as lc
from lexigauge.llm.common import letter_words


def test_base_and_labels(make_docs):
    docs = [
        (1, "Released under the MIT License, under the mit license."), (2, "see Apache License, Version 2.0"),
        (3, "CC-BY-NC cc by nc"), (4, None), (5, ""), (6, "SPDX-License-Identifier: GPL-3.0"), (1, "nothing"),
        (7, "x " * 50000 + "All rights reserved"),
    ]
    got = {(r.doc_id, r.n_words): r for r in lc.scan_licenses(make_docs(docs)).collect()}
    assert len(got) == len(docs)
    a = got[1, 9]
    assert (a.n_base, a.first_word, a.last_word, a.base_labels, a.labels) == (2, 1, 5, "mit", "mit")
    assert got[2, 6].base_labels == "apache-2" and got[2, 6].first_word == 1
    assert got[3, 6].n_base == 2 and got[3, 6].labels == "cc-by-nc"
    for key in ((4, 0), (5, 0), (1, 1)):
        assert got[key].n_base == 0 and got[key].first_word is None and got[key].labels == "" and got[key].score == 0
    assert got[6, 6].labels == "gpl-3" and got[6, 6].score == 1.0
    assert got[7, 50003].labels == "proprietary"
    assert lc.scan_licenses(make_docs([])).count() == 0


def test_gate_loses_nothing():
    """Running every rule gives what the gated rules give."""
    scanner = lc.Scanner()
    assert len(scanner.rules) > 250
    texts = [
        "licensed under the terms of the GNU General Public License v3", "Mozilla Public License 2.0 license", "this may not be used for training of AI models",
        "for noncommercial use only", "for non commercial use only", "CC BY SA 4.0 licence", "GPLv2 license and BSD 3 clause license", "open rail m license",
        "https://creativecommons.org/licenses/by-nc/4.0/", "permission is hereby granted free of charge to any person obtaining a copy of this software",
        *[r.pattern.decode()[3:].split("(?= ")[0] for r, _ in scanner.rules],
    ]
    for text in texts:
        words = letter_words(text.encode())
        line = lc._line(words)
        every = sorted((rule.name, m.start()) for rule, p in scanner.rules for m in p.finditer(line))
        gated = sorted((r.name, line.find(b" ", 0) if a == 0 else [i for i, c in enumerate(line) if c == 32][a]) for a, _, r in scanner.detections(words, line))
        assert every == gated, text


def test_suppression():
    rule = lambda n, p: lc.Rule(n, n, p, frozenset(), b"")
    a, b, c = rule("a", 50), rule("b", 90), rule("c", 50)
    found = [(0, 10, a), (2, 5, b), (3, 4, a), (4, 8, c), (20, 22, c), (20, 22, a)]
    assert [(x, y, r.name) for x, y, r in lc.suppress(found)] == [(0, 10, "a"), (2, 5, "b"), (20, 22, "a")]
    assert lc.suppress([]) == []


def test_suppression_against_all_pairs():
    draw = random.Random(4)
    rule = [lc.Rule(f"r{p}", f"r{p}", p, frozenset(), b"") for p in (40, 50, 60, 90)]
    for _ in range(300):
        found = []
        for _ in range(draw.randrange(30)):
            first = draw.randrange(40)
            found.append((first, first + draw.randrange(1, 12), draw.choice(rule)))
        kept = []
        for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
            if not any(a <= d[0] and d[1] <= b for a, b, _ in kept):
                kept.append(d)
        assert lc.suppress(found) == sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def test_base_columns_of_all_documents(spark):
    """The base part against a plain reading of the contract, over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lc.scan_licenses(docs).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in lc.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert got[doc_id] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_long_text_of_notices():
    scanner, words = lc.Scanner(), letter_words(b"Licensed under the MIT license, see above. " * 250_000)
    line, begin = lc._line(words), time.process_time()
    base, found = scanner.base_places(line), lc.suppress(scanner.detections(words, line))
    assert len(base) == 250_000 and len(found) == 250_000 and {r.label for _, _, r in found} == {"mit"}
    assert time.process_time() - begin < 20
