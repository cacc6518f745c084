import numpy as np

from lexigauge.llm import toxicity as tx


def test_gradients():
    net, draw = tx.Network(), np.random.default_rng(0)
    x, y = draw.normal(size=(6, 5, tx.INPUTS)), np.array([0, 1, 1, 0, 1.0])
    mask = np.ones((6, 5))
    mask[4:, 2] = 0
    _, g = net.gradient(x, mask, y)
    for key, value in g.items():
        at = tuple(s // 2 for s in value.shape)
        net.p[key][at] += 1e-5
        more = net.gradient(x, mask, y)[0]
        net.p[key][at] -= 2e-5
        less = net.gradient(x, mask, y)[0]
        net.p[key][at] += 1e-5
        assert abs((more - less) / 2e-5 - value[at]) < 1e-6, key


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        starts = tx.window_starts(n)
        assert {w for s in starts for w in range(s, min(n, s + tx.WINDOW))} == set(range(n))


def test_held_out_and_odd_texts(spark, make_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tx.train(docs, labels)
    known = docs.join(labels, "doc_id", "left_semi")
    got = tx.score_documents(known, model).join(labels, "doc_id").filter("held_out").collect()
    hits = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in hits) > 0.9 * len(hits)
    assert sum(r.predicted for r in got if r.toxic == 0) < 0.03 * len(got)
    text = next(r.text for r in known.join(labels, "doc_id").filter("toxic = 1 AND length(text) BETWEEN 300 AND 900").collect() if "moron" in r.text or "idiot" in r.text)
    odd = make_docs([(1, None), (2, ""), (3, "!! ??"), (4, "the " * 60000 + text), (5, text), (5, text), (None, "of")])
    out = {(r.doc_id, r.predicted) for r in tx.score_documents(odd, model).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)} <= out and tx.score_documents(odd, model).count() == 7
    assert tx.score_documents(make_docs([]), model).count() == 0


def test_one_class_only(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    docs = make_docs([(1, "a"), (2, None)])
    scores = {r.score for r in tx.score_documents(docs, tx.train(docs, labels)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_logistic_settles():
    x = np.concatenate([np.full(800, -8.0), np.full(180, 12.0), np.full(3, -8.0)])
    y = np.concatenate([np.zeros(880), np.ones(103)])
    a, b = tx.logistic(x, y)
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(((p - y) * x).sum() + 0.5 * (a - 1)) < 1e-3 and abs((p - y).sum() + 0.5 * b) < 1e-3
