from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

from lexigauge.llm import divergence as dv
from lexigauge.llm.divergence import terms_of

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, min_docs=30, ranks=50):
    docs = [(l or "", s or "", terms_of((t or "").encode())) for _, t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, every, own = Counter(), Counter(), {}
        for l, s, w in docs:
            if l == lang:
                df.update(set(w))
                own.setdefault(s, Counter()).update(w)
        kept = [t for t, n in df.items() if n >= min_docs]
        for c in own.values():
            every.update({t: c[t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, p = shares(every), {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t.decode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found, 1) if part == "pair" or r <= ranks]
    return sorted(out, key=str)


def audit(docs, **options):
    return sorted(rows_of(dv.audit(docs, **options), *COLUMNS), key=str)


@pytest.mark.parametrize("cells, held", [(dv.BLOCK_CELLS, 1 << 19), ((17, 17), 5)])
def test_equals_brute_force(spark, make_docs, monkeypatch, cells, held):
    """Blocks of terms and hand-overs of any size."""
    monkeypatch.setattr(dv, "HELD", held)
    rng = np.random.default_rng(2)
    words = np.array(["tan", "über", "x", "zo", "Ab", "ab", "mu9nu", "d'or", "ix", "oak", "elm", "fir"])
    share = 1 / np.arange(1, 13)
    rows = [
        (i, " ".join(rng.choice(words, rng.integers(0, 20), p=share / share.sum())), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 6)}")
        for i in range(300)
    ]
    rows += [(1000 + i, rows[i % 3][1], "en", f"s{i % 4}") for i in range(200)]  # copies in several sources
    want = brute(rows, 12, 4)
    assert audit(make_docs(rows), min_docs=12, ranks=4, block_cells=cells) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_odd_rows(spark, make_docs):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "123 456", "en", "b"), (4, "one two", "en", "c"), (4, "one two", "en", "c"),
            (5, "one three one", "en", "a"), (6, "one", "fr", "a"), (None, "one " * 50_000, "en", "d"), (8, "two", "en", None)]
    for least in (1, 2, 3, 30):
        assert audit(make_docs(rows), min_docs=least) == brute(rows, least)
    assert audit(make_docs([])) == []


def test_a_text_in_every_source_is_tokenised_once(spark, make_docs):
    rows = [(i, "the very same text", "en", f"s{i % 7}") for i in range(70)] + [(100, "the very same text", "de", "s0")]
    got = dv.collapse(make_docs(rows).select("lang", "source", "text")).collect()
    assert sorted((r["lang"], sum(s["n"] for s in r["sources"])) for r in got) == [("de", 1), ("en", 70)]
    assert audit(make_docs(rows)) == brute(rows)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 10**15 + 7, 3 * 10**16 + 1
    df = spark.createDataFrame([(n, total, 1000)], "n bigint, total bigint, v bigint")
    assert df.select(dv.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5000)
