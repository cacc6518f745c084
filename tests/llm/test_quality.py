import numpy as np
from pyspark.sql import functions as F

from lexigauge.llm import quality as ql


def test_isotonic():
    draw = np.random.default_rng(5)
    y, w = draw.random(40), draw.integers(1, 5, 40).astype(float)
    got = ql.isotonic(y, w)
    # the minimax formula of isotonic regression
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, want)
    assert len(ql.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_kernel():
    draw = np.random.default_rng(6)
    old, ql.FEATURES = ql.FEATURES, 20000
    x = draw.normal(size=(6, len(ql.NAMES)))
    z = ql.features(x)[:, :-1]
    ql.FEATURES = old
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * ql.KERNEL_WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_normal_equations(spark):
    draw = np.random.default_rng(7)
    rows = [(draw.normal(size=len(ql.NAMES)).tolist(), float(draw.integers(0, 2))) for _ in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(7)
    zero, one = np.zeros(len(ql.NAMES)), np.ones(len(ql.NAMES))
    s, n = ql.normal_equations(df, zero, one)
    z = np.concatenate([ql.features(np.array([r[0] for r in rows])), np.array([[r[1]] for r in rows])], axis=1)
    assert n == 200 and np.allclose(s, z.T @ z)


def test_held_out_and_odd_rows(spark, make_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = ql.score_documents(docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    odd = make_docs([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "word " * 100000), (None, "x\n\n")])
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 1), (2, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = ql.score_documents(odd, some).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    none = some.filter("false")
    assert {r.score for r in ql.score_documents(odd, none).collect()} == {0.5}
    assert ql.score_documents(make_docs([]), some).count() == 0
    assert ql.keep_good(odd, none).columns == odd.columns and ql.keep_good(odd, none).count() == 6
