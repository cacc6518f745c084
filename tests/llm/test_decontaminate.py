import hashlib
import random
import re

import numpy as np
import pytest

from lexigauge.llm import decontaminate as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            v = words(item)
            k = min(window, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v and name is not None else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    found.add(str(name))
        text = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(4)
    item = lambda n: " ".join(draw.choice(["a", "b", "Ü", "the", "x9"]) for _ in range(n))
    items = [(1, item(30)), (2, item(12)), (10, item(3)), (3, item(10)), (4, None), (5, " ..."), (None, item(4)), (6, item(30)), (7, "the")]
    items += [(8, items[0][1]), (1, items[0][1]), (9, items[0][1].upper() + "!")]
    docs = [(k, item(draw.randrange(0, 60)) + " " + items[draw.choice([0, 1, 3])][1][draw.randrange(9) :] + " zz q" * draw.randrange(5)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "no words of it ."), (5, docs[5][1]), (None, items[1][1]), (103, ("zz " * 20000) + items[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 60])
def test_hits(spark, make_docs, case, block):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.contamination(make_docs(docs), bench, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = dc.decontaminate(make_docs(docs), bench, block_bytes=block)
    assert kept.columns == make_docs(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(docs, items) if not r[-1])


def test_empty_tables(spark, make_docs, case):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contamination(make_docs([(1, "a b")]), none).first()[1:4] == (2, 0, 0)
    assert dc.contamination(make_docs([]), none).count() == 0


def test_longest_match(spark, make_docs, case):
    docs, items = case
    docs = [d for d in docs if d[0] is not None][:30]
    bench = spark.createDataFrame([items[0], items[2]], "item_id bigint, text string")
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in dc.longest_matches(make_docs(docs), bench, 5).collect()}
    want = {}
    for name, text in (items[0], items[2]):
        v = words(text)
        for i in range(len(v)):
            best = (0, 0, 0)
            for doc_id, t in docs:
                w = words(t)
                for j in range(len(w)):
                    k = 0
                    while i + k < len(v) and j + k < len(w) and v[i + k] == w[j + k]:
                        k += 1
                    best = min(best, (-k, doc_id, j))
            if -best[0] >= min(5, len(v)):
                want[str(name), i] = (-best[0], best[1])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_suffix_array():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        x = draw.integers(0, 3, n)
        want = sorted(range(n), key=lambda i: (x[i:].tolist(), i))
        assert dc.suffix_array(x, n + 1).tolist() == want
