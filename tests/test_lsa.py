import math
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from lexigauge import ModelConfig
from lexigauge.operators import lsa
from lexigauge.operators import matrix as mx
from lexigauge.operators import similarity as sim


@pytest.fixture(autouse=True)
def step_by_step(monkeypatch):
    """The small matrices here would be taken whole."""
    monkeypatch.setattr(lsa, "WHOLE_SIDE", 0)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(60)]
    docs = []
    for d in range(130):
        topic = words[(d % 4) * 15 : (d % 4) * 15 + 15]
        docs.append((d, " ".join(rng.choices(topic, k=30) + rng.choices(words, k=10)) if d != 7 else "zzz"))
    return mx.fit_matrix(spark.createDataFrame(docs, "doc_id bigint, text string"))


@pytest.fixture(scope="module")
def source(fitted):
    return lsa.term_rows(fitted, "count", 2)


@pytest.fixture(scope="module")
def dense(source):
    """Terms × documents, with the terms in order of their number."""
    m = np.zeros((source.n_terms, source.n_docs))
    for r in source.rows.collect():
        m[r["idx"], r["doc_id"]] = r["w"]
    return m


def _low_rank(dense, k):
    u, s, v = np.linalg.svd(dense, full_matrices=False)
    return (u[:, :k] * s[:k]) @ v[:k], s[:k]


@pytest.mark.parametrize("panel_bytes, side", [(lsa.PANEL_BYTES, "terms"), (8 * 130 * 3, "documents"), (8, "documents")])
def test_truncated_svd(source, dense, panel_bytes, side):
    svd = lsa.decompose(source, 6, panel_bytes=panel_bytes, side=side)
    want, sigma = _low_rank(dense, 6)
    assert svd.sigma == pytest.approx(sigma, rel=1e-9)
    terms = {r["term_id"]: r["term"] for r in source.vocab.collect()}
    f = {r["term"]: r["f"] for r in svd.term_factors().collect()}
    v = {r["doc_id"]: r["v"] for r in svd.doc_factors().collect()}
    got = np.array([[np.dot(f[terms[t]], v[d]) if d in v else 0.0 for d in range(130)] for t in range(source.n_terms)])
    assert np.abs(got - want).max() < 1e-5
    assert svd.head(3).sigma == pytest.approx(sigma[:3])


def test_randomized_svd(source, dense):
    svd = lsa.randomized_svd(source, 4)
    assert svd.side.name == "terms" and svd.sigma == pytest.approx(_low_rank(dense, 4)[1], rel=1e-6)


def test_fewer_documents_than_terms(fitted):
    """The block is as long as the documents are many; the factors are those of the terms' side."""
    few = mx.fitted(fitted.bags.filter("doc_id < 25"))
    source = lsa.term_rows(few, "tfidf", 1)
    assert source.n_docs < source.n_terms
    one, two = (lsa.decompose(source, 4, side=s) for s in (None, "terms"))
    assert one.side.name == "documents" and one.sigma == pytest.approx(two.sigma, rel=1e-8)
    for x, y in ((one.term_factors(), two.term_factors()), (one.doc_factors(), two.doc_factors())):
        a, b = (np.array([r[1] for r in sorted(f.collect())]) for f in (x, y))
        assert a.shape == b.shape and np.abs(a @ a.T - b @ b.T).max() < 1e-5 * one.sigma[0] ** 2
    listed = few.bags.filter("doc_id IN (3, 4, 99)").select("doc_id")
    assert sorted(r["doc_id"] for r in one.doc_factors(listed).collect()) == [3, 4]
    u = np.array([r["v"] for r in one.term_directions().collect()])
    assert np.abs(u.T @ u - np.eye(4)).max() < 1e-6


def test_short_side_taken_whole(source, dense, monkeypatch):
    monkeypatch.setattr(lsa, "WHOLE_SIDE", 1024)
    want = np.linalg.svd(dense, compute_uv=False)
    for method in (lsa.truncated_svd, lsa.randomized_svd):
        found = method(source, 9)
        assert found.passes == 1 and found.sigma == pytest.approx(want[:9], rel=1e-9)


def test_triangles_in_a_tree(spark, monkeypatch):
    draw = np.random.default_rng(0)
    m = draw.normal(size=(300, 5)) * [1e8, 1, 1, 1e-6, 1]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, p array<double>").repartition(37)
    monkeypatch.setattr(lsa, "TRIANGLES", 3)
    r = lsa.triangle(df, "p")
    assert np.abs(r.T @ r / (m.T @ m) - 1).max() < 1e-6
    q = np.array([x["p"] for x in lsa._orthonormal(df).collect()])
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-12


def test_document_factors_by_join(source, monkeypatch):
    svd = lsa.truncated_svd(source, 4)
    want = {r["doc_id"]: r["v"] for r in svd.doc_factors().collect()}
    monkeypatch.setattr(lsa, "PANEL_BYTES", 0)
    got = {r["doc_id"]: r["v"] for r in svd.doc_factors().collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-12) for d in want)


def test_model_cosines_equal_the_dense_ones(spark, fitted, source, dense):
    low, _ = _low_rank(dense, 5)
    low = low[:, :110]
    config = ModelConfig("lsa", 2, False, "count", 5, 110)
    corpus = fitted.bags
    model = lsa.fit_lsa(fitted, config, corpus)
    assert model.n_columns == 110
    terms = {r["term"]: r["term_id"] for r in source.vocab.collect()}
    texts = {0: "w01 w02 w02", 1: "w40 nope w41", 2: "nope", 3: "", 4: "w16 w17 w59 other"}

    def vector(text):
        return np.mean([low[terms[w]] if w in terms else np.full(110, 1e-5) for w in text.split() or [""]], axis=0)

    df = spark.createDataFrame(list(texts.items()), "text_id bigint, text string")
    vectors = sim.dense_text_vectors(sim.text_bags(df), model.term_vectors, model.unknown)
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a bigint, b bigint")
    out = sim.dense_pair_cosines(pairs, vectors).collect()
    assert len(out) == 10
    for r in out:
        a, b = vector(texts[r["a"]]), vector(texts[r["b"]])
        assert r["similarity"] == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-5)


def test_reconstructed_cells(fitted, source, dense):
    svd = lsa.truncated_svd(source, 5)
    low, _ = _low_rank(dense, 5)
    cells = mx.cells(mx.score_rows(fitted.bags, "count"))
    terms = {r["term"]: r["term_id"] for r in source.vocab.collect()}
    got = lsa.reconstruct(cells, svd.term_factors(), svd.doc_factors()).collect()
    assert len(got) == int((dense > 0).sum())
    assert max(abs(r["weight"] - low[terms[r["term"]], r["doc_id"]]) for r in got) < 1e-5


@pytest.mark.parametrize("panel_bytes", [8 * 60 * 3, 8])
def test_no_component_is_lost_for_lack_of_room(source, dense, panel_bytes):
    """Room for three columns, and for none: both methods still give all that is asked."""
    want = _low_rank(dense, 7)[1]
    assert lsa.randomized_svd(source, 7, panel_bytes=panel_bytes).sigma == pytest.approx(want, rel=1e-3)
    found = lsa.truncated_svd(source, 7, panel_bytes=panel_bytes)
    assert found.sigma == pytest.approx(want, rel=1e-9) and found.residual <= 1e-7


def test_restart_and_unsettled(source, dense, monkeypatch):
    """A block of two columns grows past the widest basis and starts again; too few passes are an error."""
    monkeypatch.setattr(lsa, "BASIS_COLUMNS", 1)
    found = lsa.decompose(source, 6, block=2)
    assert found.sigma == pytest.approx(_low_rank(dense, 6)[1], rel=1e-7)
    with pytest.raises(RuntimeError, match="residual"):
        lsa.decompose(source, 6, block=2, max_passes=3)


def test_full_rank(source, dense):
    sigma = np.linalg.svd(dense, compute_uv=False)
    assert lsa.truncated_svd(source, 1000).sigma == pytest.approx(sigma[sigma > 1e-6 * sigma[0]], rel=1e-6)


def test_factors_travel_to_blocks_not_to_cells(fitted, source, dense):
    """The factors of a term meet the cells in blocks of documents: no join of the cells with them, any number of blocks."""
    svd = lsa.truncated_svd(source, 5)
    low, _ = _low_rank(dense, 5)
    cells = mx.cells(mx.score_rows(fitted.bags, "count"))
    cells = cells.unionAll(cells.limit(1))
    terms = {r["term"]: r["term_id"] for r in source.vocab.collect()}
    out = lsa.reconstruct(cells, svd.term_factors(), svd.doc_factors(), block_cells=30)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
    got = out.collect()
    assert len(got) == int((dense > 0).sum()) + 1
    assert max(abs(r["weight"] - low[terms[r["term"]], r["doc_id"]]) for r in got) < 1e-5


def test_vectors_travel_once_a_block(spark, monkeypatch):
    """Means of texts in many blocks, with unknown words, and no aggregation of one vector a token."""
    texts = [(i, ["a", "b", "a c", "x", "c c x"][i % 5]) for i in range(40)]
    rows = {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [3.0, 3.0]}
    vectors = spark.createDataFrame(list(rows.items()), "term string, vec array<double>")
    monkeypatch.setattr(sim, "BLOCK_CELLS", 4)
    out = sim.dense_text_vectors(sim.text_bags(spark.createDataFrame(texts, "text_id bigint, text string")), vectors, [0.5, 0.25])
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
    got = {r["text_id"]: r["vec"] for r in out.collect()}
    assert len(got) == 40
    for i, t in texts:
        assert got[i] == pytest.approx(np.mean([rows.get(w, [0.5, 0.25]) for w in t.split()], axis=0))


def test_blocks_do_not_go_through_the_driver(source, dense, monkeypatch):
    """The tasks read the block of every pass from the shared folder; only a folder that Spark alone can read is
    an exception, with the same result."""
    want = lsa.decompose(source, 4)
    with monkeypatch.context() as no_driver:
        no_driver.setattr(lsa, "_fill", None)
        found = [m(source, 4, panel_bytes=b) for m in (lsa.truncated_svd, lsa.randomized_svd) for b in (lsa.PANEL_BYTES, 8 * 60 * 3)]
        docs = {r["doc_id"]: r["v"] for r in found[0].doc_factors().collect()}
    for svd in found:
        assert svd.sigma == pytest.approx(_low_rank(dense, 4)[1], rel=1e-6)
    assert len(docs) == source.rows.count()
    monkeypatch.setattr(lsa, "files_of", lambda df: None)
    other = lsa.decompose(source, 4)
    assert other.sigma == pytest.approx(want.sigma, rel=1e-12)
    assert {r["doc_id"]: r["v"] for r in other.doc_factors().collect()}.keys() == docs.keys()


def _sparse_rows(rng, n, size, lengths):
    """Rows of some lengths over so many columns, as a batch and as a dense matrix; the first row is a slice away."""
    idx = [rng.choice(size, int(k), replace=False).astype(np.int32) for k in rng.choice(lengths, n)]
    w = [rng.random(len(i)) for i in idx]
    dense = np.zeros((n, size))
    for row, (i, x) in enumerate(zip(idx, w, strict=True)):
        dense[row, i] = x
    batch = pa.record_batch([pa.array(idx, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float64()))], names=["idx", "w"])
    return batch, dense


@pytest.mark.parametrize("cells", [7, 1 << 21])
def test_products_of_rows_of_all_lengths(monkeypatch, cells):
    rng = np.random.default_rng(2)
    batch, dense = _sparse_rows(rng, 60, 300, [0, 1, 1, 2, 5, 5, 40, 290])
    monkeypatch.setattr(lsa, "PRODUCT_CELLS", cells)
    monkeypatch.setattr(lsa, "TIMES_CELLS", 64)
    panel = rng.random((300, 4))
    shared = type("Shared", (), {"value": panel})
    out = pa.Table.from_batches(list(lsa._product_task(shared)(iter([batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)]))))
    got = np.zeros((300, 4))
    got[out["id"].to_numpy()] = np.array(out["v"].to_pylist())
    assert got == pytest.approx(dense.T @ (dense @ panel))
    keyed = batch.append_column("doc_id", pa.array(range(60)))
    found = pa.Table.from_batches(list(lsa._document_task("doc_id", shared)(iter([keyed.slice(3)]))))
    assert np.array(found["v"].to_pylist()) == pytest.approx((dense @ panel)[3:])


def test_short_rows_are_multiplied_together():
    """Most words are in few documents: a task has no step of its own for each of their rows."""
    rng = np.random.default_rng(4)
    batch, dense = _sparse_rows(rng, 5000, 50, [2, 3, 4])
    steps, panel = [], rng.random((50, 3))
    task = lsa._product_task(type("Shared", (), {"value": panel}))
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    try:
        out = list(task(iter([batch])))
    finally:
        sys.setprofile(None)
    assert np.array(pa.Table.from_batches(out)["v"].to_pylist()) == pytest.approx(dense.T @ (dense @ panel))
    assert len(steps) < 5000

