import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexigauge.operators import matrix as mx
from lexigauge.operators import similarity as sim
from lexigauge.operators import tables as tb
from lexigauge.plans import apply as ap


def test_tiny_corpus(tiny):
    fitted = mx.fit_matrix(tiny)
    df = {r["term"]: r["df"] for r in fitted.frequency.collect()}
    assert len(df) == 14 and df["the"] == 4 and df["cow"] == 3 and df["moon"] == 1
    assert sorted(r["term"] for r in fitted.vocab(2).collect()) == ["cow", "fire", "kicked", "lamp", "the"]
    assert mx.ignored_terms(fitted.frequency, 2).count() == 9
    numbered = {r["term"]: r["term_id"] for r in mx.vocab_index(fitted.vocab(1)).collect()}
    assert numbered == {t: i for i, t in enumerate(sorted(df))}
    stats = mx.model_stats(fitted.frequency, fitted.facts, 2).first()
    assert (stats["wordcount"], stats["n_documents"], stats["ignored_count"], stats["size_label"]) == (5, 4, 9, "5x4")
    counted = {(r["term"], r["doc_id"]): r["n"] for r in mx.term_counts(fitted.bags).collect()}
    assert counted["the", 0] == 2 and counted["cow", 3] == 1


def test_tfidf_by_hand(tiny):
    rows = mx.cells(mx.fit_matrix(tiny).rows("tfidf", 2)).filter("doc_id = 3").collect()
    idf = {t: math.log(5 / (1 + d)) + 1 for t, d in (("the", 4), ("cow", 3), ("fire", 2))}
    norm = math.sqrt(sum(v * v for v in idf.values()))
    assert {r["term"]: pytest.approx(r["weight"]) for r in rows} == {t: v / norm for t, v in idf.items()}


def test_skew_join_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(tb, "MIN_CHUNK", 10)
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(300)]
    big = spark.createDataFrame(rows, "k string, i int")
    small = big.groupBy("k").agg(F.count("*").alias("rows")).withColumn("x", F.length("k"))
    got = tb.skew_join(big, small, ["k"], "rows", 300, ["i"])
    assert sorted(map(tuple, got.collect())) == sorted((k, i, len(k)) for k, i in rows)


def test_numbering_and_ranks(spark):
    rows = [(random.Random(i).randrange(4), i, float(random.Random(i).randrange(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    got = tb.number_rows(df, ["x", "i"]).collect()
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}
    assert {r["i"]: r["idx"] for r in got} == want
    for limit in (1000, 5):
        ranked = tb.rank_in_group(df, ["g"], [F.col("x").desc(), "i"], "r", limit=limit).collect()
        for g in range(4):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
            assert {r["i"]: r["r"] for r in ranked if r["g"] == g} == {r[1]: n + 1 for n, r in enumerate(mine)}


def _dense(cells, n_docs, texts, known):
    def vector(words):
        rows = []
        for w in words or [""]:
            v = np.full(n_docs, 1e-5)
            if w in known:
                v = np.zeros(n_docs)
                for (t, d), x in cells.items():
                    if t == w:
                        v[d] = x
            rows.append(v)
        return np.mean(rows, axis=0)

    return {i: vector(t.split()) for i, t in texts.items()}


@pytest.mark.parametrize("bound", [sim.BROADCAST_ROWS, 0])
def test_cosines_equal_the_dense_ones(spark, bound):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(d, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for d in range(40)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    texts = {i: " ".join(rng.choices(words + ["x1", "x2"], k=rng.randrange(0, 9))) for i in range(12)}
    texts[12], texts[13] = "x1 x2 x2", ""
    pairs = [(a, b) for a in range(14) for b in range(a + 1, 14)]
    fitted = mx.fit_matrix(corpus)
    known = {r["term"] for r in fitted.vocab(2).collect()}
    tokens = sim.text_bags(spark.createDataFrame(list(texts.items()), "text_id bigint, text string"))
    rows = fitted.rows("tfidf", 2)
    both = rows.select("doc_id", F.transform("entries", lambda e: F.struct(
        e["term"].alias("term"), e["n"].cast("double").alias("count"), e["weight"].alias("tfidf"))).alias("entries"))
    out = sim.pair_cosines(
        spark.createDataFrame(pairs, "a bigint, b bigint"), tokens, fitted.vocab(2), both,
        fitted.facts.n_docs, weights=("count", "tfidf"), broadcast_rows=bound,
    ).collect()
    assert len(out) == 2 * len(pairs)
    for model, column in (("count", "n"), ("tfidf", "weight")):
        cells = {(r["term"], r["doc_id"]): float(r[column]) for r in mx.cells(rows).collect()}
        v = _dense(cells, 40, texts, known)
        for r in out:
            if r["model"] == model:
                a, b = v[r["a"]], v[r["b"]]
                assert r["similarity"] == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-9)
    assert [r["similarity"] for r in out if (r["a"], r["b"]) == (12, 13)] == pytest.approx([1, 1])


def _plan(texts, pairs, n_texts):
    """The plan of a task from {text: {term: n}} and pairs of texts."""
    terms = sorted({t for bag in texts.values() for t in bag})
    lists = [[(i, bag[t]) for i, bag in texts.items() if t in bag] for t in terms]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    return {
        "a": a, "b": b, "n_texts": n_texts, "terms": pa.array(terms), "length": np.array([len(x) for x in lists]),
        "text": np.array([i for x in lists for i, _ in x]), "n": np.array([float(n) for x in lists for _, n in x]),
        "by_a": np.argsort(a, kind="stable"), "degree": np.bincount(a, minlength=n_texts),
    }


def _documents(rows):
    terms = pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.string()))
    return pa.record_batch([terms, pa.array([[w for _, w in r] for r in rows], pa.list_(pa.float64()))], names=["terms", "w"])


def test_sums_of_touched_texts_equal_dense_ones():
    rng = np.random.default_rng(3)
    texts = {i: {f"t{t}": int(rng.integers(1, 4)) for t in rng.choice(30, 4, replace=False)} for i in range(12)}
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))]
    rows = [[(f"t{t}", float(rng.random())) for t in rng.choice(40, rng.integers(0, 12), replace=False)] for _ in range(25)]
    plan = _plan(texts, pairs, 12)
    met, touched = {"w": np.zeros((1, 40))}, {"w": np.zeros((2, 12))}
    for part in (rows[:10], [], rows[10:]):
        sim._add_batch(plan, _documents(part), ("w",), met, touched)
    v = np.array([[sum(texts[i].get(t, 0) * w for t, w in r) for r in rows] for i in range(12)])
    assert met["w"][0] == pytest.approx([float(v[a] @ v[b]) for a, b in pairs])
    assert touched["w"] == pytest.approx(np.stack([(v * v).sum(axis=1), v.sum(axis=1)]))


def test_no_array_of_documents_and_texts():
    """Many documents and texts that hardly meet: the memory follows what meets."""
    n = 20_000
    texts = {i: {f"t{i}": 1} for i in range(n)}
    plan = _plan(texts, [(i, (i + 1) % n) for i in range(n)], n)
    rows = [[(f"t{i % n}", 1.0), (f"t{(i + 1) % n}", 2.0)] for i in range(3000)]
    met, touched = {"w": np.zeros((1, n))}, {"w": np.zeros((2, n))}
    batch = _documents(rows)
    tracemalloc.start()
    sim._add_batch(plan, batch, ("w",), met, touched)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met["w"].sum() == 2.0 * 3000 and peak < 20 << 20  # 3,000 x 20,000 numbers would be 480 MB



def test_hot_paths_have_no_cross_join(spark, tiny):
    fitted = mx.fit_matrix(tiny)
    for df in (fitted.rows("tfidf", 2), mx.term_counts(fitted.bags), mx.document_frequency(fitted.bags)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("score", ["count", "zeroone", "tfidf"])
def test_weights_are_the_same_with_and_without_the_join(spark, tiny, monkeypatch, score):
    more = tiny.unionAll(spark.createDataFrame([(9, ""), (10, "unique"), (11, None)], "doc_id bigint, text string"))
    fitted = mx.fit_matrix(more)
    index = mx.vocab_index(fitted.vocab(2))

    def cells():
        rows = mx.weighted_rows(fitted.bags, index, fitted.facts, score, carry=["term_id"])
        return sorted((r.doc_id, r.term, r.term_id, r.n, round(r.weight, 12)) for r in mx.cells(rows).collect()), rows.count()

    in_rows = cells()
    monkeypatch.setattr(mx, "VOCAB_BYTES", -1)
    assert cells() == in_rows and in_rows[0]


def test_a_larger_questionnaire_goes_in_blocks_not_through_the_join(spark, tiny, monkeypatch):
    monkeypatch.setattr(sim, "_sums_by_join", lambda *_: pytest.fail("joined documents and texts"))
    fitted = mx.fit_matrix(tiny)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["the cow", "a fire", "lamp cow the", "moon", "the the fire"])], "text_id bigint, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "a bigint, b bigint")
    rows = fitted.rows("tfidf", 2)

    def found(bound):
        out = sim.pair_cosines(pairs, sim.text_bags(texts), fitted.vocab(2), rows, 4, broadcast_rows=bound)
        return {(r["a"], r["b"]): r["similarity"] for r in out.collect()}

    assert found(9) == pytest.approx(found(1000)) and len(found(9)) == 25


def test_a_pass_costs_no_documents_times_texts():
    """Every text and every document hold the same words; their products are looked up, not made a document at a time."""
    n, words = 2000, 12
    bag = {f"t{i}": 1 for i in range(words)}
    plan = _plan({i: bag for i in range(n)}, [(i, (i + 1) % n) for i in range(n)], n)
    batch = _documents([[(t, 2.0) for t in bag]] * n)
    met, touched = {"w": np.zeros((1, n))}, {"w": np.zeros((2, n))}
    seen, at = [], sim._ranges

    def counted(first, count):
        seen.append(int(count.sum()))
        return at(first, count)

    sim._ranges = counted
    try:
        sim._add_batch(plan, batch, ("w",), met, touched)
    finally:
        sim._ranges = at
    assert (met["w"] == n * (2 * words) ** 2).all() and (touched["w"][0] == n * (2 * words) ** 2).all()
    assert sum(seen) < n * words * words * 4  # documents times texts would be 4,000,000 sums of 12


def test_a_long_document_costs_no_square_of_its_length(monkeypatch):
    """Two thousand words, of which a text holds one: the document's values are made, not two million products."""
    n = 2000
    plan = _plan({i: {f"t{i}": 1 + i % 3} for i in range(n)}, [(i, (i + 1) % n) for i in range(n)], n)
    batch = _documents([[(f"t{i}", 1.0 + i % 5) for i in range(n)]])
    met, touched = {"w": np.zeros((1, n))}, {"w": np.zeros((2, n))}
    seen, at = [], sim._ranges
    monkeypatch.setattr(sim, "_ranges", lambda first, count: (seen.append(int(count.sum())), at(first, count))[1])
    sim._add_batch(plan, batch, ("w",), met, touched)
    value = np.array([(1 + i % 3) * (1.0 + i % 5) for i in range(n)])
    assert (met["w"][0] == value * np.roll(value, -1)).all() and (touched["w"] == [value * value, value]).all()
    assert sum(seen) <= 10 * n


def test_all_scores_are_made_where_the_texts_are_compared(spark, tiny, monkeypatch):
    """Bags go to one Python step, not rows through two; a vocabulary that does not travel takes the rows."""
    fitted = mx.fit_matrix(tiny)
    texts = spark.createDataFrame([(0, "the cow"), (1, "a fire on the lamp"), (2, "lamp moon lamp")], "text_id bigint, text string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "a bigint, b bigint")
    scores, steps, made = ("count", "zeroone", "tfidf"), [], sim._line_maker
    monkeypatch.setattr(sim, "_line_maker", lambda shared, weights, make=None: (steps.append(make), made(shared, weights, make))[1])

    def found():
        out = ap.matrix_similarities(fitted, texts, pairs, scores, 2)
        return {(r["a"], r["b"], r["model"]): r["similarity"] for r in out.collect()}

    first = found()
    monkeypatch.setattr(mx, "VOCAB_BYTES", 0)
    assert found() == pytest.approx(first) and len(first) == 9
    assert steps[0] is not None and steps[1] is None


@pytest.mark.parametrize("cost", [0, 8, 1e9])
def test_both_ways_of_adding_documents_agree(monkeypatch, cost):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(sim, "PRODUCT_COST", cost)
    monkeypatch.setattr(sim, "LOOKUP_COST", cost)
    monkeypatch.setattr(sim, "VALUE_CELLS", 200)
    texts = {i: {f"t{t}": int(rng.integers(1, 4)) for t in {*rng.integers(0, 200, 5).tolist(), i % 2}} for i in range(60)}
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2))]
    rows = [[(f"t{t}", float(rng.random())) for t in rng.choice(220, rng.integers(0, 120), replace=False)] for _ in range(50)]
    plan = _plan(texts, pairs, 60)
    met, touched = {"w": np.zeros((1, 90))}, {"w": np.zeros((2, 60))}
    for part in (rows[:20], [], rows[20:]):
        sim._add_batch(plan, _documents(part), ("w",), met, touched)
    v = np.array([[sum(texts[i].get(t, 0) * w for t, w in r) for r in rows] for i in range(60)])
    assert met["w"][0] == pytest.approx([float(v[a] @ v[b]) for a, b in pairs])
    assert touched["w"] == pytest.approx(np.stack([(v * v).sum(axis=1), v.sum(axis=1)]))


def test_a_document_row_with_a_term_twice():
    plan = _plan({0: {"a": 1, "b": 2}, 1: {"b": 1}}, [(0, 1)], 2)
    met, touched = {"w": np.zeros((1, 1))}, {"w": np.zeros((2, 2))}
    sim._add_batch(plan, _documents([[("b", 1.0), ("a", 3.0), ("b", 2.0)]]), ("w",), met, touched)
    assert met["w"][0, 0] == 27.0 and touched["w"].tolist() == [[81.0, 9.0], [9.0, 3.0]]


def test_rows_are_made_of_few_documents_at_a_time():
    bags = pa.array([[{"term": f"t{i % 7}", "n": 1}, {"term": "x", "n": 2}] for i in range(2000)], pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())])))
    batch = pa.record_batch([pa.array(range(2000)), bags], names=["doc_id", "bag"])
    shared = type("Shared", (), {"value": pa.table({"term": [f"t{i}" for i in range(6)], "_idf": [1.0] * 6})})
    out = list(mx._row_task(shared, [], "tfidf")(iter([batch.slice(3, 1990)])))
    assert max(b.num_rows for b in out) <= mx.ROW_DOCUMENTS
    got = {d: e for b in out for d, e in zip(b["doc_id"].to_pylist(), b["entries"].to_pylist())}
    assert got == {i: [{"term": f"t{i % 7}", "n": 1, "weight": 1.0}] for i in range(3, 1993) if i % 7 < 6}


def test_a_task_holds_few_bytes_a_token_of_the_texts(spark):
    """A large questionnaire goes to the documents in one pass, so its texts travel and lie as short numbers."""
    n, words = 3000, 40
    rows = [(f"x{i}", f"t{(i * 7 + j * j) % 997}", 1 + j % 3) for i in range(n) for j in range(words)]
    tokens = spark.createDataFrame(rows, "text_id string, term string, n int").groupBy("text_id", "term").agg(F.max("n").alias("n"))
    ids = pa.array([f"x{i}" for i in range(n)])
    terms = pa.array(sorted({r[1] for r in rows}))
    lists = sim._token_lists(tokens, ids, terms)
    plan = {"a": np.arange(n - 1), "b": np.arange(1, n), "n_texts": n, "terms": terms, **lists}
    held = len(plan["text"])
    side = sim._text_lists(plan)
    per_token = [x.nbytes for x in (plan["text"], plan["n"], side["term"], side["n"], side.get("key", side["n"][:0]))]
    assert held == tokens.count() and sum(per_token) <= 16 * held
    # both orders say the same
    want = {(int(r[0][1:]), r[1], float(r[2])) for r in tokens.collect()}
    of_term = np.repeat(np.arange(len(terms)), plan["length"])
    assert {(t, terms[k].as_py(), n) for t, k, n in zip(plan["text"].tolist(), of_term, plan["n"].tolist())} == want
    of_text = np.repeat(np.arange(n), side["size"])
    assert {(t, terms[k].as_py(), n) for t, k, n in zip(of_text.tolist(), side["term"].tolist(), side["n"].tolist())} == want


def test_a_vocabulary_is_searched_once_and_sums_of_texts_are_made_once(monkeypatch):
    """Not once for every slice of documents: both are as long as the questionnaire."""
    words, n_texts, docs = pa.array([f"t{i}" for i in range(50)]), 30, 400
    plan = _plan({i: {f"t{(i + j) % 60}": 1 + j for j in range(3)} for i in range(n_texts)}, [(i, (i + 1) % n_texts) for i in range(n_texts)], n_texts)
    vocab = pa.table({"term": words, "_idf": [1.0] * 50, "_at": pa.array(range(50), pa.int32())})
    bags = pa.array([[{"term": f"t{(3 * d + j) % 70}", "n": 1 + d % 3} for j in range(6)] for d in range(docs)], pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())])))
    monkeypatch.setattr(mx, "ROW_DOCUMENTS", 10)
    searched, search, summed, add = [], pc.index_in, [], np.bincount
    monkeypatch.setattr(pc, "index_in", lambda values, value_set: (searched.append(len(value_set)), search(values, value_set))[1])
    monkeypatch.setattr(np, "bincount", lambda x, *more, **named: (summed.append(x is plan["text"]), add(x, *more, **named))[1])
    make = mx._list_task(type("Shared", (), {"value": vocab}), ("count", "tfidf"))
    task = sim._line_maker(type("Shared", (), {"value": plan}), ("count", "tfidf"), make)
    batch = pa.record_batch([pa.array(range(docs)), bags], names=["doc_id", "bag"])
    out = pa.Table.from_batches(list(task(iter([batch])))).to_pylist()
    assert searched.count(len(plan["terms"])) == 1 and sum(summed) <= 4
    weight = np.zeros((n_texts, docs))
    for d in range(docs):
        for j in range(6):
            if (3 * d + j) % 70 < 50:
                for i in range(n_texts):
                    weight[i, d] += (1 + d % 3) * (1 + ((3 * d + j) % 70 - i) % 60) * (((3 * d + j) % 70 - i) % 60 < 3)
    got = {(r["of_pair"], r["idx"]): (r["x"], r["y"]) for r in out if r["model"] == "count"}
    assert got[True, 4][0] == weight[4] @ weight[5] and got[False, 4] == (weight[4] @ weight[4], weight[4].sum())
