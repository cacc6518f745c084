import pytest

from lexigauge import ModelConfig
from lexigauge.operators import lsa, tables
from lexigauge.operators import matrix as mx
from lexigauge.operators import similarity as sim
from lexigauge.plans import store
from lexigauge.plans.apply import matrix_similarities
from lexigauge.sources import model_store as ms


def test_saved_models_give_what_fresh_ones_give(spark, tiny, tmp_path):
    texts = spark.createDataFrame([("a", "the cow"), ("b", "a lamp on fire"), ("c", "unknown words")], "text_id string, text string")
    pairs = spark.createDataFrame([("q", "1", "a", "b"), ("q", "2", "a", "c")], "lp_id string, sp_id string, a string, b string")
    configs = [
        ModelConfig("docbyterm", 1, False, "count"),
        ModelConfig("docbyterm", 1, False, "tfidf", output="named"),
        ModelConfig("lsa", 1, False, "count", svd_components=4),
    ]
    paths = store.save_grid(tiny, configs, str(tmp_path / "grid"), [])
    assert [p.rsplit("/", 1)[1] for p in paths] == [configs[0].label(), "named", configs[2].label()]
    found = store.saved_models(spark, str(tmp_path / "grid"))
    assert sorted(p.rsplit("/", 1)[1] for p in found) == sorted(p.rsplit("/", 1)[1] for p in paths)
    got = {(r.filename, r.sp_id): r.similarity for r in store.apply_saved(spark, found, texts, pairs, []).collect()}
    fresh = matrix_similarities(mx.fit_matrix(tiny), texts, pairs, ("count", "tfidf"), 1)
    for r in fresh.collect():
        name = "named" if r.model == "tfidf" else configs[0].label()
        assert got[name, r.sp_id] == pytest.approx(r.similarity, abs=1e-9)
    assert len(got) == 6


def test_saved_models_keep_how_texts_were_taken_apart(spark, tiny, tmp_path):
    """A pattern of its own and a stop list of its own, which the caller need not repeat."""
    pattern, stop = "[a-z]+", ["the", "on"]
    texts = spark.createDataFrame([("a", "The cow's lamp"), ("b", "lamp on fire 12ab")], "text_id string, text string")
    pairs = spark.createDataFrame([("q", "1", "a", "b")], "lp_id string, sp_id string, a string, b string")
    fitted = mx.fit_matrix(tiny, stop, pattern=pattern)
    config = ModelConfig("docbyterm", 2, True, "count")
    reduced = ModelConfig("lsa", 2, True, "count", svd_components=3)
    ms.save_matrix(fitted, config, str(tmp_path / "m" / "one"), source="tiny")
    ms.save_lsa(lsa.fit_lsa(fitted, reduced), reduced, str(tmp_path / "m" / "two"), fitted, "tiny")
    for name in ("one", "two"):
        meta = ms.read_meta(spark, str(tmp_path / "m" / name)).first()
        assert (meta["token_pattern"], sorted(meta["stop_list"]), meta["source"]) == (pattern, sorted(stop), "tiny")
        assert meta["ignored"] == spark.read.parquet(str(tmp_path / "m" / name / "ignored")).count() > 0
    got = store.apply_saved(spark, [str(tmp_path / "m" / "one")], texts, pairs).first()["similarity"]
    bags = sim.text_bags(texts, stop, pattern=pattern)
    rows = fitted.rows("count", 2)
    want = sim.pair_cosines(pairs, bags, fitted.vocab(2), rows, 4).first()["similarity"]
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("blocks", [False, True])
def test_saved_models_of_one_vocabulary_share_a_pass(spark, tiny, tmp_path, monkeypatch, blocks):
    """Three scores, one pass; a model with another vocabulary has its own. The join gives the same."""
    texts = spark.createDataFrame([("a", "the cow"), ("b", "a lamp on fire"), ("c", "unknown words")], "text_id string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "a string, b string")
    configs = [ModelConfig("docbyterm", 2, False, s) for s in ("count", "zeroone", "tfidf")]
    configs.append(ModelConfig("docbyterm", 1, False, "tfidf", output="wide"))
    paths = store.save_grid(tiny, configs, str(tmp_path / "grid"), [])
    name = "_sums_by_join" if blocks else "_sums_by_broadcast"
    passes, made = [], getattr(sim, name)
    monkeypatch.setattr(sim, name, lambda full, known, rows, *more: (passes.append(rows), made(full, known, rows, *more))[1])
    if blocks:
        monkeypatch.setattr(sim.pair_cosines, "__defaults__", (*sim.pair_cosines.__defaults__[:2], 0, None))
    got = {(r.filename, r.a, r.b): r.similarity for r in store.apply_saved(spark, paths, texts, pairs, []).collect()}
    assert len(passes) == (4 if blocks else 2) and len(got) == 12
    fitted = mx.fit_matrix(tiny)
    for config, path in zip(configs, paths):
        want = matrix_similarities(fitted, texts, pairs, (config.score,), config.min_document_frequency).collect()
        for r in want:
            assert got[path.rsplit("/", 1)[1], r.a, r.b] == pytest.approx(r.similarity, abs=1e-12)


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    tables.check_shared("file:/tmp/warehouse", "local[4]")
    tables.check_shared("hdfs://store/warehouse", "spark://host:7077")
    for folder in ("file:/tmp/warehouse", "/tmp/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.check_shared(folder, "spark://host:7077")
