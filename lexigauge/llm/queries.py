"""One query for each operator on the driver's tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigauge.llm import (
    decontaminate, divergence, html_text, language, licenses, mixing, ngram_join, quality, ranked_search, syncmers,
    token_counts, topk, toxicity,
)
from lexigauge.llm.common import read
from lexigauge.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query
def op3_exact_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@query
def op4_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query
def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query
def op6_quality_classifier(spark, sf_dir):
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.link_documents(read(spark, sf_dir, "documents"))


@query
def op8_html_extraction(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"), html_text.train())


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.read_vocabulary())


@query
def op10_source_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark, sf_dir):
    return ranked_search.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_syncmer_fingerprints(spark, sf_dir):
    return syncmers.fingerprint_edits(read(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))
