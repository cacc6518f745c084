import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows_of

from lexigauge.llm import ranked_search as rs
from lexigauge.llm.common import letter_words

K = 20


def brute(docs, items, k=K):
    """Every document scored for every item."""
    docs = [(i, letter_words(t.encode()) if t else []) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in docs if w]
    big_n, big_l = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries = {}
    for i, t in set(items):
        if i is not None:
            queries.setdefault(i, Counter()).update(letter_words(t.encode()) if t else [])
    out = []
    for i, q in queries.items():
        scored = []
        for d, c, n in held:
            m = 75 + 25 * n * big_n // big_l
            s = sum(x * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, **options):
    q = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "item_id AS term", "1 AS rank")
    got = rs.top_documents(docs, q, **options).collect()
    return sorted([tuple(r) for r in got], key=str)


@pytest.mark.parametrize("segment, short, span", [(1 << 24, 32, 512), (3000, 2, 8), (3000, 10**9, 8), (20_000, 32, 16)])
def test_equals_brute_force(spark, make_docs, monkeypatch, segment, short, span):
    """Any size of segments, ranges and short lists: all lists long, or all lists short."""
    monkeypatch.setattr(rs, "SHORT", short)
    monkeypatch.setattr(rs, "RANGE", span)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(80)])
    share = 1 / np.arange(1, 81)
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(300)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(12)]
    assert search(spark, make_docs(rows), items, segment_bytes=segment, k=7) == brute(rows, items, 7)


def test_blocks_of_queries_and_index_of_all_terms(spark, make_docs):
    rows = [(i, f"alpha beta{i % 3} gamma{i}") for i in range(40)]
    items = [(i, f"beta{i % 3} gamma{i} alpha") for i in range(9)]
    whole = search(spark, make_docs(rows), items)
    assert whole == brute(rows, items)
    assert search(spark, make_docs(rows), items, block_rows=5) == whole
    assert search(spark, make_docs(rows), items, term_bytes=0) == whole


def test_odd_rows(spark, make_docs):
    rows = [
        (1, "red green"), (2, "red green"), (None, "red green"), (3, None), (4, ""), (5, "..."), (6, "RED red Red"),
        (6, "green blue"), (7, "naïve red " * 30_000),
    ]
    items = [(1, "Red"), (1, "Red"), (2, None), (3, ""), (4, "naïve"), (None, "red"), (5, "green"), (5, "blue blue"), (6, "absent")]
    assert search(spark, make_docs(rows), items) == brute(rows, items)
    assert search(spark, make_docs([]), items) == []
    assert search(spark, make_docs(rows), []) == []


def test_lists_that_cannot_matter_are_not_read(spark, make_docs):
    """A rare term fills the best documents; the common one brings in no others."""
    rows = [(i, "common " * 3 + ("rare" if i % 50 == 0 else "")) for i in range(4000)]
    index = rs.build_index(make_docs(rows).coalesce(1), segment_bytes=1 << 24)
    segment = index.toArrow().to_pylist()[0]
    scalars = {c: pa.scalar(v, index.toArrow().schema.field(c).type) for c, v in segment.items()}
    terms = {b"common": 0, b"rare": 1}
    lists = rs.Lists(scalars, terms, 4000, sum(segment["sizes"]))
    brought = []

    class Spy(np.ndarray):
        def __setitem__(self, at, value):
            brought.append(np.size(at))
            super().__setitem__(at, value)

    best, buffer = rs.Best(K), np.zeros(lists.count, np.int64).view(Spy)
    rs.search_lists(lists, np.array([0, 1]), np.array([1, 4000]), best, buffer)
    assert len(best.score) == K and not buffer.any()
    assert sum(brought) < 1000  # the list of the common term alone has 4,000


def test_given_tables(spark):
    from lexigauge.llm.common import read

    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows_of(rs.top_documents(docs, items), "item_id", "rank", "doc_id", "score") == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
