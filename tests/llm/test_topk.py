import numpy as np
import pytest

from lexigauge.llm import topk


def brute(rows, k, every):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    queries = {}
    for i, v in whole:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_against_all_scores(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=8).round(2).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0] * 8) for i in range(30)]  # ties
    rows += [(200, None), (201, [None] + [1.0] * 7), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(40, rows[40][1]), (20, [2.0] * 8), (205, [1.0, 2.0]), (240, [3.0, 4.0]), (206, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "vec_id AS score", "1 AS v").repartition(5)
    for size in (topk.QUERY_BYTES, 200):
        got = sorted(tuple(r) for r in topk.top_k(df, 7, 20, query_bytes=size).collect())
        assert got == brute(rows, 7, 20)


def test_none(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df).count() == 0
    one = spark.createDataFrame([(20, [1.0]), (3, [-2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(one).collect()] == [(20, 1, 3, -128 * 64)]


def test_phases_send_and_look_up_less(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=16).round(2).tolist()) for i in range(1200)]
    whole = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 64)
    k, blocks, n_queries = 5, 2, 60
    table = topk.durable(topk.distinct_vectors(whole, k, blocks))
    (groups,) = topk.query_blocks(whole.filter("vec_id % 20 = 0"), topk.QUERY_BYTES)
    queries = topk.Shared(spark, groups)
    heads = topk.local_lists(table, queries, 10 * k + 1, blocks)
    assert heads.count() == n_queries * blocks * (10 * k + 1)
    first = topk.ranked(table, topk.resolve(table, queries, topk.packed(heads), blocks), k)
    needs = topk.Shared(spark, topk.block_needs(groups, heads, first, k, blocks))
    sent = topk.sufficient_entries(table, queries, needs, blocks)
    pairs = sent.selectExpr("key", "explode(query_ids) AS query_id").collect()
    assert 0 < len(pairs) < 0.05 * blocks * n_queries * len(rows)
    totals = topk.resolve(table, queries, sent, blocks).collect()
    assert {(r.query_id, r.key) for r in totals} == {(r.query_id, r.key) for r in pairs}
    assert sum(r.looked_up for r in totals) == blocks * len(totals) - len(pairs)
    resolved = topk.resolve(table, queries, sent, blocks, needs)
    assert sorted(tuple(r) for r in topk.ranked(table, resolved, k).collect()) == brute(rows, k, 20)


def test_many_copies_and_blocks(spark):
    rows = [(i, [1.0, -2.0, 3.0]) for i in range(400)] + [(20, [1.0, -2.0, 3.0])] * 9 + [(400 + i, [i / 50, 1.0, -1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for blocks in (1, 2, 5):
        assert sorted(tuple(r) for r in topk.top_k(df, 6, 20, blocks=blocks).collect()) == brute(rows, 6, 20)


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(20, [3e38, 1.0]), (3, [3e38, 1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df)
