"""From raw documents to a training mix: five stages, each reading what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm import decontaminate, language, mixing, ngram_join, quality
from lexigauge.llm.common import read
from lexigauge.operators.tables import durable


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, scores 0.3 or more."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their labelled texts teach."""
    return language.keep_known(docs, language.train(docs))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word n-grams, similarity 0.75)."""
    return ngram_join.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that it takes any of."""
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix_sources),
]

# The first two stages are fitted models, which SQL cannot express; tests run the others' brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
