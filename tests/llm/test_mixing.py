import duckdb
import numpy as np

from lexigauge.llm import mixing as mx
from lexigauge.llm.oracles import mixing_sql


def targets(sizes):
    """Sharing the excess again and again, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / total for s in names}
        above = {s for s in names if target[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def test_mix(spark, make_docs):
    draw = np.random.default_rng(4)
    rows = []
    for k in range(600):
        source = draw.choice(["b", "a", "src10", "src2", "ü", "hot", "hot", "hot"])
        rows.append((k, "w * " * int(draw.integers(0, 60)), None, str(source)))
    rows += [(700, None, None, "a"), (701, "", None, None), (702, "x y", None, None), (3, rows[3][1], None, rows[3][3]), (None, "a b c", None, "b"), (703, "q " * 30000, None, "late")]
    docs = make_docs(rows)
    got = mx.mix(docs, ranges=64).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    want, taken = targets(size), {}
    by_key = {}
    for r in got:
        by_key.setdefault((r.doc_id, r.size), []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    for doc_id, text, _, source in rows:
        r = by_key[doc_id, len((text or "").split())][0]
        assert r.source_size == size[source] and abs(r.target - want[source]) < 1e-6
        taken[source] = taken.get(source, 0) + r.taken
    largest = max(len((t or "").split()) for _, t, _, s in rows if s != "late")
    assert all(abs(taken[s] - want[s]) <= largest for s in size if s != "late")
    again = mx.mix(docs.repartition(5), ranges=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "text", "source").toArrow())
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.execute(mixing_sql("given")).fetchall()))
    assert mx.mix(make_docs([])).count() == 0
    assert {r.taken for r in mx.mix(make_docs([(1, None), (2, "")])).collect()} == {0}
