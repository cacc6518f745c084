import random
import re

import numpy as np
import pytest

from lexigauge.llm import components as cc
from lexigauge.llm import ngram_join as nj
from lexigauge.llm.components import components


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {i: grams(t) for i, t in docs if i is not None}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i, _ in docs if i is not None)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    out, common = [], text(30)
    for base in range(14):
        own = text(draw.randrange(5, 150))
        for _ in range(draw.choice([1, 2, 6, 15])):
            copy = list(own)
            for _ in range(draw.choice([0, 1, 2, 5, 8])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            if draw.random() < 0.4:
                copy += common
            out.append(" ".join(copy))
    out += ["a b", "A  b", "a b c", "x y z v w", "x y z v w", "", " \n "]
    rows = [(k + 1, t) for k, t in enumerate(out)]
    draw.shuffle(rows)
    return [*rows, (900, None), rows[0], (901, " ".join(text(20000))), (902, "Same same " * 4000)]


@pytest.mark.parametrize("hot,block,few,refine", [(nj.HOT_LIMIT, nj.BLOCK_GRAMS, 8, 1 << 40), (0, 300, 8, 100), (50, 1000, 2, 0)])
def test_components(make_docs, docs, monkeypatch, hot, block, few, refine):
    monkeypatch.setattr(nj, "FEW", few)
    monkeypatch.setattr(nj, "BUCKET_GRAMS", 500)
    got = nj.link_documents(make_docs(docs).repartition(6), hot_limit=hot, block_grams=block, refine_grams=refine).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_shared_passages_chain_nothing(spark, make_docs):
    """Documents of own words and a few common sentences, more of them than the order knows."""
    draw = random.Random(5)
    common = [[f"c{draw.randrange(3000)}" for _ in range(12)] for _ in range(300)]
    texts = []
    for k in range(1500):
        parts = [[f"o{k}x{j}" for j in range(150)], *draw.sample(common, 4)]
        draw.shuffle(parts)
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[7] + " more words here", texts[8] + " and others there"]
    docs = make_docs(list(enumerate(texts)))
    order = nj.Shared(spark, nj.HotOrder(np.zeros(0, np.uint64)))
    once = nj.signatures(docs, order).cache()
    loose = nj.candidate_groups(docs, once, order, refine_grams=1 << 40).groupBy("component").count().agg({"count": "max"}).first()[0]
    groups = nj.candidate_groups(docs, once, order)
    assert loose > 1000
    assert sorted(tuple(r) for r in groups.select("node", "component").collect()) == [(7, 7), (8, 8), (1500, 7), (1501, 8)]


def test_keep_one_and_odd_rows(make_docs, docs):
    more = [*docs, (None, "x y z v w"), (None, None)]
    kept = nj.keep_one(make_docs(more))
    want = sorted({i for i, _, c in brute(docs) if i == c})
    assert kept.columns == make_docs(more).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.filter("doc_id IS NULL").count() == 2
    assert [r.component_id for r in nj.link_documents(make_docs([(None, "a b c d e")])).collect()] == [None]
    assert nj.link_documents(make_docs([])).count() == 0


def test_tree_against_all_pairs():
    draw = np.random.default_rng(9)
    for _ in range(60):
        sets = [np.unique(draw.integers(0, 40, draw.integers(1, 30)).astype(np.uint64)) for _ in range(30)]
        label = list(range(len(sets)))
        for a, b in nj.tree_links(list(range(len(sets))), sets):
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    want = [want[a] if v == want[b] else v for v in want]
        assert [label.index(v) for v in label] == [want.index(v) for v in want]


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[k] for k in range(1000, 1200)} == {1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 3])
def test_components_of_random_links(spark, monkeypatch, stretch):
    monkeypatch.setattr(cc, "STRETCH", stretch)
    draw = random.Random(stretch)
    links = [(draw.randrange(-200, 200), draw.randrange(-200, 200)) for _ in range(150)]
    links += [*links[:20], (None, 3), (4, None), *((b, a) for a, b in links[:20])]
    top = {v: v for x in links for v in x if None not in x and x[0] != x[1]}
    for _ in top:
        for a, b in links:
            if a in top and b in top:
                top[a] = top[b] = min(top[a], top[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(top.items())


def test_links_that_are_settled_take_one_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cc, "durable", lambda df, name: written.append(name) or df.cache())
    monkeypatch.setattr(cc, "release", lambda df: None)
    links = [(k % 7, k) for k in range(500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(8)).collect()}
    assert got == {k: k % 7 for k in range(500)}
    assert len(written) == 2


def test_a_large_group_is_not_walked_for_every_set(monkeypatch):
    """Sets that share a passage but are not similar, and some near copies among them."""
    draw = np.random.default_rng(3)
    common = draw.choice(1 << 40, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((common, draw.integers(0, 1 << 40, 80).astype(np.uint64)))) for _ in range(400)]
    sets += [s[:-3] for s in sets[:40]]
    looked = []
    least = nj.least_overlap
    monkeypatch.setattr(nj, "least_overlap", lambda a, b: looked.append(1) or least(a, b))
    links = nj.tree_links(list(range(len(sets))), sets)
    assert sorted(links) == [(k, 400 + k) for k in range(40)]
    assert len(looked) < 10 * len(sets)


def test_a_bucket_sends_what_it_settles_once(spark):
    """Documents of the same n-grams: one link each, not a chain under every n-gram."""
    grams = np.arange(40, dtype=np.uint64)
    rows = [(k, 40, bytearray(grams.tobytes())) for k in range(100)] + [(k, 40, bytearray((grams + np.uint64(1000 * k)).tobytes())) for k in range(100, 110)]
    sets = spark.createDataFrame(rows, "doc_id bigint, n bigint, prefix binary")
    links = nj.candidate_links(sets, 1).collect()
    assert sorted(map(tuple, links)) == [(0, k) for k in range(1, 100)]


def test_tree_that_probes_against_all_pairs(monkeypatch):
    monkeypatch.setattr(nj, "PROBE", 2)
    draw = np.random.default_rng(4)
    for _ in range(60):
        bases = [draw.integers(0, 400, draw.integers(4, 60)) for _ in range(4)]
        sets = []
        for _ in range(40):
            own = bases[draw.integers(4)].copy()
            at = draw.integers(0, len(own), draw.integers(0, 1 + len(own) // 4))
            own[at] = draw.integers(0, 400 if draw.random() < 0.5 else 1 << 30, len(at))
            sets.append(np.unique(own[: draw.integers(len(own) * 3 // 4, len(own)) + 1].astype(np.uint64)))
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    want = [want[a] if v == want[b] else v for v in want]
        least = {v: want.index(v) for v in want}
        assert sorted(nj.tree_links(list(range(len(sets))), sets)) == sorted((least[v], k) for k, v in enumerate(want) if least[v] != k)
