"""Every query on the driver's tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.config import sweep_configs
from lexigauge.functions import labels
from lexigauge.functions import text as tx
from lexigauge.functions.stats import round6
from lexigauge.functions.stopwords import ENGLISH
from lexigauge.operators import evaluation as ev
from lexigauge.operators import lsa
from lexigauge.operators import matrix as mx
from lexigauge.operators import ranking as rk
from lexigauge.operators import similarity as sim
from lexigauge.operators.tables import durable, largest_group, shared_folder, spread
from lexigauge.plans import apply as ap
from lexigauge.plans import store as st
from lexigauge.plans import sweep as sw
from lexigauge.plans.oracles import oracles  # noqa: F401
from lexigauge.sources import corpus as cp
from lexigauge.sources import model_store as ms
from lexigauge.sources import questionnaire as qn
from lexigauge.sources import study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

MIN_DF = 2


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spread(cp.from_table(_read(spark, sf, "documents")))


def _short_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_read(spark, sf, "benchmark")).select(F.col("item_id").alias("text_id"), "text")


def _dialogue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Texts, pairs and the most candidates of a lead: turn 0 against each later turn."""
    turns = _read(spark, sf, "conversations")
    text_id = F.concat_ws("/", "conv_id", "turn")
    texts = spread(turns).select(text_id.alias("text_id"), "text")
    leads = turns.filter("turn = 0").select("conv_id", text_id.alias("a"))
    cands = turns.filter("turn > 0").select("conv_id", "turn", text_id.alias("b"))
    pairs = cands.join(leads, "conv_id").select(
        F.col("conv_id").alias("lp_id"), F.concat(F.lit("SP"), "turn").alias("sp_id"), "a", "b"
    )
    return texts, pairs, largest_group(turns.filter("turn > 0"), ["conv_id"])


def _line_id():
    """Lines of the synthetic table may share a number, so this takes more of the line."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", cents)


def _order_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Two rankings per order: its lines by quantity and by price."""
    lines = _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("lp_id"),
        _line_id().alias("sp_id"),
        F.col("l_quantity").alias("human"),
        F.floor(F.col("l_extendedprice") / 5000).cast("double").alias("machine"),
    )
    return lines, largest_group(lines, ["lp_id"])


# ---------------------------------------------------------------- sources


@query
def corpus_scan(spark, sf):
    return cp.from_table(_read(spark, sf, "documents"))


@query
def tag_text(spark, sf):
    return cp.from_tagged_column(_read(spark, sf, "pages"), "html", ["page_id"], "p").select(
        "page_id", F.col("position").cast("bigint").alias("position"), "text"
    )


@query
def corpus_prefix(spark, sf):
    return cp.prefix(_corpus(spark, sf), 3).select("doc_id", "text")


@query
def corpus_prefix_all_but_last(spark, sf):
    return cp.prefix(_corpus(spark, sf), 1).select("doc_id", "text")


@query
def corpus_regroup(spark, sf):
    corpus = _corpus(spark, sf)
    return cp.regroup(corpus, corpus.count() // 4)


@query
def corpus_regroup_counts(spark, sf):
    corpus = _corpus(spark, sf)
    groups = cp.regroup_map(corpus, corpus.count() // 4)
    return cp.regroup_counts(mx.term_counts(mx.document_bags(corpus)), groups)


@query
def wide_to_candidates(spark, sf):
    columns = ("c_name", "c_mktsegment", "c_nationkey", "c_custkey", "c_mktsegment", "c_name")
    nested = qn.sheet_to_questionnaire(_read(spark, sf, "customer"), "c_custkey", "c_name", columns)
    return qn.candidate_rows(nested)


# ---------------------------------------------------------------- text


@query
def normalize_text(spark, sf):
    return _corpus(spark, sf).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query
def tokenize(spark, sf):
    found = F.posexplode_outer(tx.tokens(F.col("text")))
    corpus = _corpus(spark, sf)
    return tx.unnest(corpus, ["doc_id"], found, "position", "token").select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "token"
    )


@query
def stopword_filter(spark, sf):
    counts = mx.term_counts(mx.document_bags(_corpus(spark, sf), ENGLISH))
    return counts.select("doc_id", "term", F.col("n").cast("bigint").alias("n"))


@query
def stopword_flags(spark, sf):
    words = F.posexplode_outer(tx.split_words(F.col("text")))
    corpus = _corpus(spark, sf)
    return tx.unnest(corpus, ["doc_id"], words, "position", "word").select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "word",
        F.col("word").isin(*ENGLISH).alias("is_stop"),
    )


@query
def empty_text_guard(spark, sf):
    texts = _read(spark, sf, "conversations")
    found = tx.guarded(tx.tokens(F.col("text"), ENGLISH))
    return texts.select("conv_id", "turn", found.alias("t")).select(
        "conv_id", "turn",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.array_contains("t", "").alias("is_empty"),
    )


@query
def token_multiset(spark, sf):
    bags = sim.text_bags(_short_texts(spark, sf))
    return bags.select("text_id", "term", F.col("n").cast("bigint").alias("n"))


# ---------------------------------------------------------------- matrix


def _long(cells: DataFrame) -> DataFrame:
    return cells.select("term", "doc_id", round6(F.col("weight")).alias("weight"))


@query
def term_doc_count(spark, sf):
    return _long(mx.cells(mx.score_rows(mx.document_bags(_corpus(spark, sf)), "count")))


@query
def term_doc_zeroone(spark, sf):
    return _long(mx.cells(mx.score_rows(mx.document_bags(_corpus(spark, sf)), "zeroone")))


@query
def term_doc_tfidf(spark, sf):
    return _long(mx.cells(mx.fit_matrix(_corpus(spark, sf)).rows("tfidf", MIN_DF)))


@query
def term_doc_tfidf_stop(spark, sf):
    return _long(mx.cells(mx.fit_matrix(_corpus(spark, sf), ENGLISH).rows("tfidf", MIN_DF)))


@query
def document_frequency(spark, sf):
    return mx.document_frequency(mx.document_bags(_corpus(spark, sf)))


@query
def vocab_pruned(spark, sf):
    fitted = mx.fit_matrix(_corpus(spark, sf))
    counts = mx.pruned_counts(fitted.bags, fitted.vocab(MIN_DF), fitted.facts)
    return counts.select("term", "doc_id", F.col("n").cast("bigint").alias("n"))


@query
def ignored_terms(spark, sf):
    return mx.ignored_terms(mx.document_frequency(mx.document_bags(_corpus(spark, sf))), MIN_DF)


@query
def vocab_index(spark, sf):
    vocab = mx.vocabulary(mx.document_frequency(mx.document_bags(_corpus(spark, sf))), MIN_DF)
    return mx.vocab_index(vocab).select("term", "term_id", "df")


@query
def model_stats(spark, sf):
    fitted = mx.fit_matrix(_corpus(spark, sf))
    return mx.model_stats(fitted.frequency, fitted.facts, MIN_DF)


# ---------------------------------------------------------------- apply


def _short_text_model(spark, sf):
    fitted = mx.fit_matrix(_corpus(spark, sf))
    tokens = sim.text_bags(_short_texts(spark, sf))
    return fitted, tokens


@query
def word_vectors(spark, sf):
    fitted, tokens = _short_text_model(spark, sf)
    matrix = mx.cells(fitted.rows("tfidf", MIN_DF)).select("term", "doc_id", "weight")
    out = sim.word_vectors(tokens, fitted.vocab(MIN_DF), matrix)
    return out.select(
        "text_id", "term", F.col("n").cast("bigint").alias("n"), "known", "doc_id",
        round6(F.col("weight")).alias("weight"),
    )


@query
def oov_tokens(spark, sf):
    fitted, tokens = _short_text_model(spark, sf)
    out = sim.unknown_tokens(tokens, fitted.vocab(MIN_DF))
    return out.select("text_id", "term", F.col("n").cast("bigint").alias("n"))


@query
def text_vectors(spark, sf):
    fitted, tokens = _short_text_model(spark, sf)
    matrix = mx.term_counts(fitted.bags).withColumnRenamed("n", "weight")
    out = sim.text_vectors(tokens, fitted.vocab(MIN_DF), matrix.select("term", "doc_id", "weight"))
    return out.select(
        "text_id", "doc_id", F.round("value", 12).alias("value"), F.round("base", 12).alias("base"),
    )


@query
def cosine_pairs(spark, sf):
    """Each short text against the next one, in the zero-one model."""
    fitted = mx.fit_matrix(_corpus(spark, sf))
    texts = _short_texts(spark, sf)
    pairs = texts.select(F.col("text_id").alias("a"), (F.col("text_id") + 1).alias("b"))
    pairs = pairs.join(texts.select(F.col("text_id").alias("b")), "b").select("a", "b")
    out = ap.matrix_similarities(fitted, texts, pairs, ("zeroone",), MIN_DF)
    return out.select("a", "b", round6(F.col("similarity")).alias("similarity"))


@query
def text_match(spark, sf):
    """Each turn of a conversation against the one before it, in the tf-idf model."""
    fitted = mx.fit_matrix(_corpus(spark, sf))
    turns = _read(spark, sf, "conversations").select("conv_id", "turn", "text")
    text_id = F.concat_ws("/", "conv_id", "turn")
    later = turns.select("conv_id", "turn", text_id.alias("b"))
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), text_id.alias("a"))
    pairs = later.join(earlier, ["conv_id", "turn"])
    out = ap.matrix_similarities(
        fitted, turns.select(text_id.alias("text_id"), "text"), pairs, ("tfidf",), MIN_DF
    )
    return out.select("conv_id", "turn", round6(F.col("similarity")).alias("similarity"))


def _dialogue_similarities(spark, sf, scores=("count",)):
    fitted = mx.fit_matrix(_corpus(spark, sf))
    texts, pairs, most = _dialogue(spark, sf)
    return ap.matrix_similarities(fitted, texts, pairs, scores, MIN_DF), most


@query
def lead_vs_candidates(spark, sf):
    out, _ = _dialogue_similarities(spark, sf)
    return out.select("lp_id", "sp_id", round6(F.col("similarity")).alias("similarity"))


@query
def rank_candidates(spark, sf):
    out, most = _dialogue_similarities(spark, sf)
    ranked = rk.rank_candidates(out, ["lp_id"], group_size=most)
    return ranked.select("lp_id", "sp_id", "rank", round6(F.col("similarity")).alias("similarity"))


@query
def ranked_ids(spark, sf):
    out, most = _dialogue_similarities(spark, sf)
    ranked = rk.rank_candidates(out, ["lp_id"], group_size=most)
    return rk.ranked_ids(ranked, ["lp_id"]).select(
        "lp_id", F.concat_ws(",", "ranked_ids").alias("ranked_ids")
    )


def _all_matrix_models(spark, sf):
    """All six matrix models over the dialogues, ranked."""
    texts, pairs, most = _dialogue(spark, sf)
    out = ap.matrix_models(
        ap.stop_variants(_corpus(spark, sf)), texts, pairs, ("count", "zeroone", "tfidf"), MIN_DF
    )
    described = labels.model_description(
        F.col("action"), F.col("svd_components"), F.col("score"), F.col("stopwords")
    )
    named = out.select(described.alias("model"), "lp_id", "sp_id", "similarity")
    return rk.rank_candidates(named, ["model", "lp_id"], group_size=most), most


@query
def multi_model_rank(spark, sf):
    ranked, _ = _all_matrix_models(spark, sf)
    return ranked.select(
        "model", "lp_id", "sp_id", "rank", round6(F.col("similarity")).alias("similarity")
    )


@query
def saved_models_rank(spark, sf):
    """The six matrix models fitted, saved, found again in their folder, loaded and applied; the
    ranking goes through result files."""
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    st.save_grid(_corpus(spark, sf), [c for c in sweep_configs() if not c.is_lsa], folder)
    texts, pairs, most = _dialogue(spark, sf)
    out = st.apply_saved(spark, st.saved_models(spark, folder), texts, pairs)
    ranked = rk.rank_candidates(durable(out, "saved"), ["filename", "lp_id"], group_size=most)
    named = texts.withColumnsRenamed({"text_id": "b", "text": "cand_text"})
    leads = texts.withColumnsRenamed({"text_id": "a", "text": "lead_text"})
    args = F.struct(
        "action", F.lit(MIN_DF).alias("min_document_frequency"), "stopwords", "score", "svd_components",
        F.lit(None).cast("int").alias("truncate_matrix"), F.lit(None).cast("string").alias("output"),
    )
    ranked = ranked.join(pairs, ["lp_id", "sp_id", "a", "b"]).join(named, "b").join(leads, "a")
    files = ranked.select(
        "filename", args.alias("args"), "lp_id", "lead_text", "sp_id", "cand_text",
        F.col("rank").cast("int").alias("rank"), "similarity",
    )
    study.write_results(study.nest_results(files, "dialogues"), f"{folder}-results")
    back = study.result_rows(study.read_results(spark, f"{folder}-results"))
    return back.select(
        "model", "lp_id", "sp_id", F.col("rank").cast("bigint").alias("rank"), round6(F.col("similarity")).alias("similarity")
    )


@query
def questionnaire_files(spark, sf):
    """The dialogues as questionnaire files and back."""
    turns = _read(spark, sf, "conversations")
    leads = turns.filter("turn = 0").select("conv_id", F.col("text").alias("answer"))
    items = turns.filter("turn > 0").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    nested = items.join(leads, "conv_id").select(
        F.col("conv_id").cast("string").alias("lp_id"), "answer",
        F.transform("t", lambda x: F.struct(F.concat(F.lit("SP"), x["turn"]).alias("id"), x["text"].alias("text"))).alias("possible_answers"),
    )
    path = f"{shared_folder(spark)}/questionnaire-{uuid.uuid4().hex}"
    qn.write_questionnaire(nested.select(*spark.createDataFrame([], qn.SCHEMA).columns), path)
    return qn.candidate_rows(spark.read.schema(qn.SCHEMA).json(path))


@query
def cells_csv(spark, sf):
    """The count matrix of the short texts through its CSV form."""
    corpus = _short_texts(spark, sf).withColumnRenamed("text_id", "doc_id")
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    ms.write_cells_csv(mx.fit_matrix(corpus).rows("count", MIN_DF), path)
    return ms.read_cells_csv(spark, path).select("term", "doc_id", round6(F.col("weight")).alias("weight"))


@query
def wide_csv(spark, sf):
    """The same through words down, documents across."""
    corpus = _short_texts(spark, sf).withColumnRenamed("text_id", "doc_id")
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    ids = [r[0] for r in corpus.select("doc_id").orderBy("doc_id").limit(TRUNCATE).collect()]
    ms.write_wide_csv(mx.cells(mx.fit_matrix(corpus).rows("count", MIN_DF)), path, ids)
    return ms.read_wide_csv(spark, path).select("term", "doc_id", round6(F.col("weight")).alias("weight"))


@query
def block_files(spark, sf):
    """The same through sparse row blocks and, from those, dense ones."""
    corpus = _short_texts(spark, sf).withColumnRenamed("text_id", "doc_id")
    fitted = mx.fit_matrix(corpus)
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    vocab = durable(mx.vocab_index(fitted.vocab(MIN_DF)), "vocab")
    ms.write_blocks(mx.cells(fitted.rows("tfidf", MIN_DF)), vocab, f"{path}-sparse", block_terms=100)
    back = ms.read_blocks(spark, f"{path}-sparse")
    ms.write_blocks(back, vocab, f"{path}-dense", dense_columns=fitted.facts.n_docs, block_terms=100)
    return ms.read_blocks(spark, f"{path}-dense").select("term", "doc_id", round6(F.col("weight")).alias("weight"))


@query
def worker_answer_files(spark, sf):
    """Customers as workers' answers, in files of two widths and orders, read by each file's header."""
    ranks = [((F.col("c_custkey") * i) % 7).alias(c) for i, c in enumerate(study.ANSWERS, 1)]
    status = F.when(F.col("c_nationkey") % 5 == 0, "Rejected").otherwise("Approved")
    wide = _read(spark, sf, "customer").select(
        "c_custkey", status.alias(study.STATUS), F.col("c_mktsegment").alias(study.LEAD), F.col("c_name").alias("More"), *ranks
    )
    columns = [f"`{c}`" for c in (study.STATUS, study.LEAD, *study.ANSWERS)]
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    wide.filter("c_custkey % 2 = 0").select(*columns).write.csv(f"{path}/one", header=True)
    wide.filter("c_custkey % 2 = 1").select("More", *reversed(columns)).write.csv(f"{path}/two", header=True)
    return study.read_worker_answers(spark, path).select("status", "lp_id", "sp_id", F.col("score").cast("bigint").alias("score"))


@query
def dense_cosine(spark, sf):
    """Each stored vector against the next one: the cosine the reduced models use."""
    vectors = _read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("text_id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    pairs = vectors.select(F.col("text_id").alias("a"), (F.col("text_id") + 1).alias("b"))
    out = sim.dense_pair_cosines(pairs, vectors)
    return out.select("a", "b", round6(F.col("similarity")).alias("similarity"))


# ---------------------------------------------------------------- reduced models

LSA_K = 20
TRUNCATE = 1000


def _term_rows(spark, sf, score="tfidf"):
    return lsa.term_rows(mx.fit_matrix(_corpus(spark, sf)), score, MIN_DF)


def _singular_values(spark, svd):
    rows = [(i + 1, float(x)) for i, x in enumerate(svd.sigma)]
    return spark.createDataFrame(rows, "component bigint, sigma double")


@query
def lsa_singular_values(spark, sf):
    svd = lsa.truncated_svd(_term_rows(spark, sf), LSA_K)
    return _singular_values(spark, svd).select("component", round6(F.col("sigma")).alias("sigma"))


@query
def lsa_randomized(spark, sf):
    svd = lsa.randomized_svd(_term_rows(spark, sf), LSA_K)
    return _singular_values(spark, svd).select("component", F.round("sigma", 2).alias("sigma"))


@query
def lsa_entries(spark, sf):
    """The rank-k matrix at every cell that the matrix itself fills."""
    fitted = mx.fit_matrix(_corpus(spark, sf))
    svd = lsa.truncated_svd(lsa.term_rows(fitted, "count", MIN_DF), LSA_K)
    cells = mx.cells(mx.score_rows(fitted.bags, "count"))
    out = lsa.reconstruct(cells, durable(svd.term_factors()), durable(svd.doc_factors()))
    return out.select("term", "doc_id", round6(F.col("weight")).alias("weight"))


def _full_rank(spark, sf, method):
    """All components of the short texts' count matrix: the reduced model is then the matrix itself."""
    corpus = _short_texts(spark, sf).withColumnRenamed("text_id", "doc_id")
    fitted = mx.fit_matrix(corpus)
    source = lsa.term_rows(fitted, "count", MIN_DF)
    return fitted, method(source, fitted.facts.n_docs)


@query
def lsa_full_rank_entries(spark, sf):
    """Every cell of the short texts' matrix from its truncated decomposition, nothing truncated."""
    fitted, svd = _full_rank(spark, sf, lsa.truncated_svd)
    cells = mx.pruned_counts(fitted.bags, fitted.vocab(MIN_DF), fitted.facts)
    out = lsa.reconstruct(cells, durable(svd.term_factors()), durable(svd.doc_factors()))
    return out.select("term", "doc_id", F.round(F.col("weight"), 4).alias("weight"))


@query
def lsa_full_rank_similarities(spark, sf):
    """The dialogues under the randomised decomposition of all the short texts: unknown words included,
    the cosines of the matrix model."""
    _, svd = _full_rank(spark, sf, lsa.randomized_svd)
    texts, pairs, _ = _dialogue(spark, sf)
    out = sw.lsa_similarities(lsa.lsa_model(svd), durable(sim.text_bags(texts)), pairs)
    return out.select("lp_id", "sp_id", F.round(F.col("similarity"), 5).alias("similarity"))


@query
def lsa_energy(spark, sf):
    """Sums of the second and fourth powers of all singular values of the short texts' matrix."""
    _, svd = _full_rank(spark, sf, lsa.truncated_svd)
    squares = [float(s) ** 2 for s in svd.sigma]
    rows = [(sum(squares), sum(q * q for q in squares))]
    df = spark.createDataFrame(rows, "squares double, fourth double")
    return df.select(F.round("squares", 4).alias("squares"), F.round("fourth", 4).alias("fourth"))


@query
def lsa_truncate(spark, sf):
    """Kept columns of a truncated model: how much of each document the k components hold."""
    corpus = _corpus(spark, sf)
    svd = lsa.truncated_svd(lsa.term_rows(mx.fit_matrix(corpus), "tfidf", MIN_DF), LSA_K)
    kept = lsa.first_documents(corpus, TRUNCATE)
    share = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    found = kept.join(svd.doc_factors(kept), "doc_id", "left")
    return found.select("doc_id", F.coalesce(round6(share), F.lit(0.0)).alias("share"))


@query
def lsa_rank(spark, sf):
    """The dialogues ranked by one reduced model, made from options as a user would."""
    config = sweep_configs(dims=(LSA_K,))[1]
    corpus = _corpus(spark, sf)
    model = lsa.fit_lsa(mx.fit_matrix(corpus, ENGLISH), config, corpus)
    texts, pairs, most = _dialogue(spark, sf)
    out = sw.lsa_similarities(model, durable(sim.text_bags(texts, ENGLISH)), pairs)
    ranked = rk.rank_candidates(out, ["lp_id"], group_size=most)
    return ranked.select("lp_id", "sp_id", "rank", round6(F.col("similarity")).alias("similarity"))


@query
def model_sweep(spark, sf):
    """All 18 models of the study grid, at ranks 100 and 300 cut to the first 1,000 documents, the reduced
    ones by the randomised decomposition."""
    texts, pairs, most = _dialogue(spark, sf)
    configs = sweep_configs()
    out = sw.sweep(_corpus(spark, sf), texts, pairs, configs, method="randomized")
    described = labels.model_description(*[F.col(c) for c in sw.OPTIONS])
    named = durable(out.select(described.alias("model"), "lp_id", "sp_id", "similarity"), "sweep")
    ranked = rk.rank_candidates(named, ["model", "lp_id"], group_size=most)
    return ranked.select(
        "model", "lp_id", "sp_id", "rank", round6(F.col("similarity")).alias("similarity")
    )


# ---------------------------------------------------------------- evaluation


def _event_answers(spark, sf):
    return _read(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("lp_id"), F.col("event_type").alias("sp_id"),
        F.col("value").alias("score"),
    )


@query
def human_rank(spark, sf):
    out = rk.human_ranking(
        _event_answers(spark, sf), ["lp_id"], accepted=~F.col("sp_id").startswith("error")
    )
    return out.select("lp_id", "sp_id", round6(F.col("mean_score")).alias("mean_score"), "rank")


@query
def chart_worker_points(spark, sf):
    accepted = _event_answers(spark, sf).filter(~F.col("sp_id").startswith("error"))
    out = ev.worker_points(
        accepted, ["lp_id"], "sp_id", F.col("event_id"), "score"
    )
    return out.select("lp_id", "sp_id", "worker", "score")


def _turn_order(spark, sf, most):
    """Stand-in for people: candidates in the order of the dialogue."""
    turns = _read(spark, sf, "conversations").filter("turn > 0").select(
        F.col("conv_id").alias("lp_id"), F.concat(F.lit("SP"), "turn").alias("sp_id"),
        F.col("turn").cast("double").alias("score"),
    )
    ranked = rk.human_ranking(turns, ["lp_id"], group_size=most)
    return ranked.select("lp_id", "sp_id", F.col("rank").alias("human"))


def _joined(spark, sf):
    ranked, most = _all_matrix_models(spark, sf)
    machine = durable(
        ranked.select("model", "lp_id", "sp_id", F.col("rank").alias("machine"), "similarity"), "machine"
    )
    return ev.join_rankings(_turn_order(spark, sf, most), machine, ["lp_id", "sp_id"]), most


@query
def human_machine_join(spark, sf):
    joined, _ = _joined(spark, sf)
    return joined.select("model", "lp_id", "sp_id", "human", "machine")


@query
def chart_points(spark, sf):
    joined, _ = _joined(spark, sf)
    return ev.chart_points(joined).select(
        "model", "lp_id", "sp_id", "human", "machine",
        F.round("similarity", 6).alias("similarity"), F.round("marker", 4).alias("marker"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[round6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def spearman(spark, sf):
    lines, size = _order_lines(spark, sf)
    out = ev.spearman(lines, ["lp_id"], size=size)
    return _rounded(out.select("lp_id", "n", "spearman_corr"))


@query
def spearman_p(spark, sf):
    lines, size = _order_lines(spark, sf)
    out = ev.spearman(lines, ["lp_id"], size=size)
    return _rounded(out.select("lp_id", "spearman_corr", "spearman_p_value"))


@query
def spearman_large_groups(spark, sf):
    """The same over groups that hold a third of all rows."""
    lines = _read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("lp_id"),
        F.concat_ws("-", "l_orderkey", _line_id()).alias("sp_id"),
        F.col("l_quantity").alias("human"), F.col("l_extendedprice").alias("machine"),
    )
    return _rounded(ev.spearman(lines, ["lp_id"]).select("lp_id", "n", "spearman_corr"))


@query
def kendall(spark, sf):
    lines, size = _order_lines(spark, sf)
    out = ev.kendall(lines, ["lp_id"], size=size)
    return _rounded(out.select("lp_id", "kendall_corr"))


@query
def kendall_p(spark, sf):
    lines, size = _order_lines(spark, sf)
    return _rounded(ev.kendall(lines, ["lp_id"], size=size))


@query
def order_preservation(spark, sf):
    lines, size = _order_lines(spark, sf)
    return _rounded(ev.order_preservation(lines, ["lp_id"], size=size))


@query
def evaluate_models(spark, sf):
    joined, most = _joined(spark, sf)
    joined = durable(joined.select("model", "lp_id", "sp_id", "human", "machine"), "joined")
    return _rounded(ev.evaluate(joined, ["model", "lp_id"], size=most))


@query
def metric_pivot(spark, sf):
    """Spearman of quantity and price per return flag (rows) and line status (columns, as the table has
    them)."""
    lines = _read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("lp_id"),
        F.concat_ws("-", "l_orderkey", _line_id()).alias("sp_id"),
        F.col("l_quantity").alias("human"), F.col("l_extendedprice").alias("machine"),
    )
    out = ev.spearman(lines, ["model", "lp_id"])
    found = [r[0] for r in lines.select("lp_id").distinct().orderBy("lp_id").collect()]
    return _rounded(ev.pivot_metric(out, "spearman_corr", found))


@query
def model_label(spark, sf):
    """Labels of models whose options are read off the orders."""
    lsa = F.col("o_orderstatus") == "F"
    options = _read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(lsa, "lsa").otherwise("docbyterm").alias("action"),
        (F.col("o_custkey") % 300 + 1).alias("dim"),
        F.element_at(F.array(F.lit("tfidf"), F.lit("zeroone"), F.lit("count")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("score"),
        (F.col("o_totalprice") > 100000).alias("stop"),
    )
    args = [F.col(c) for c in ("action", "dim", "score", "stop")]
    return options.select(
        "o_orderkey",
        labels.model_description(*args).alias("description"),
        labels.model_name(*args).alias("name"),
        labels.model_filename(F.lit("orders"), F.lit(2), *args).alias("filename"),
    )
