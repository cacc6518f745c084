"""Term × document matrix as rows: counts, presence or tf-idf, and its vocabulary.

A corpus is ``(doc_id, text)`` with ``doc_id`` unique. The matrix has two equal forms:
one row per document, ``(doc_id, entries array<struct<term, .., n, weight>>)``, and one row per
cell, ``(doc_id, term, .., n, weight)``. The first is made from a text without any shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.functions import text as tx
from lexigauge.operators.tables import durable, number_rows, skew_join

# The functions that run in tasks travel with them: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A vocabulary up to this size may travel to every task.
VOCAB_BYTES = 64 << 20
# Documents whose rows a task makes at a time.
ROW_DOCUMENTS = 500


def document_bags(
    corpus: DataFrame,
    stop_words: Iterable[str] | None = None,
    preprocess: Callable[[Column], Column] = tx.normalize,
    pattern: str = tx.TOKEN_PATTERN,
) -> DataFrame:
    """``(doc_id, bag array<struct<term, n>>)``."""
    found = tx.tokens(F.col("text"), stop_words, preprocess, pattern)
    return corpus.select("doc_id", tx.bag(found).alias("bag"))


def without_stop_words(bags: DataFrame, stop_words: Iterable[str]) -> DataFrame:
    """Bags of the same corpus with a stop list, without reading the texts again."""
    words = sorted(set(stop_words))
    return bags.withColumn("bag", F.filter("bag", lambda e: ~e["term"].isin(words)))


def term_counts(bags: DataFrame) -> DataFrame:
    """Count score, one row per (document, term)."""
    return tx.unnest(bags, ["doc_id"], F.inline_outer("bag"))


def document_frequency(bags: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(term, df)``; with ``only`` just for those terms, the rest left out before the shuffle."""
    terms = tx.unnest(bags, [], F.explode_outer("bag.term"), "term")
    if only is not None:
        terms = terms.join(only.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(frequency: DataFrame, min_df: int) -> DataFrame:
    return frequency.filter(F.col("df") >= min_df)


def ignored_terms(frequency: DataFrame, min_df: int) -> DataFrame:
    return frequency.filter(F.col("df") < min_df)


def vocab_index(vocab: DataFrame) -> DataFrame:
    """Terms in sorted order, numbered from 0."""
    return number_rows(vocab, ["term"], "term_id")


@dataclass(frozen=True)
class CorpusFacts:
    n_docs: int
    n_cells: int


def corpus_facts(bags: DataFrame) -> CorpusFacts:
    row = bags.agg(F.count("*"), F.sum(F.size("bag"))).first()
    return CorpusFacts(int(row[0]), int(row[1] or 0))


def smooth_idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(n_docs + 1)) / (df + 1)) + 1.0


def pruned_counts(bags: DataFrame, vocab: DataFrame, facts: CorpusFacts) -> DataFrame:
    """Cells of the terms in ``vocab`` only."""
    keep = vocab.select("term", "df")
    return skew_join(term_counts(bags), keep, ["term"], "df", facts.n_cells, ["doc_id"], "left_semi")


def weighted_rows(
    bags: DataFrame,
    vocab: DataFrame,
    facts: CorpusFacts,
    score: str = "count",
    carry: Iterable[str] = (),
) -> DataFrame:
    """Document rows holding the terms of ``vocab``, each with its count and its weight.

    ``carry`` names vocabulary columns (such as ``term_id``) to keep in the entries. A vocabulary of at
    most VOCAB_BYTES goes to the documents and nothing is shuffled; beyond that one join on the term,
    with hot terms spread, and one shuffle to bring each document together again. The unit length
    of tf-idf is a matter of the row either way. Documents without a term of ``vocab`` have no row.
    """
    extra = list(carry)
    width = F.octet_length("term") + F.lit(16 + 8 * len(extra))
    if int(vocab.agg(F.sum(width)).first()[0] or 0) <= VOCAB_BYTES:
        return _weighted_in_rows(bags, vocab, facts, score, extra)
    side = vocab.select("term", *extra, smooth_idf(F.col("df"), facts.n_docs).alias("_idf"), "df")
    cells = skew_join(term_counts(bags), side, ["term"], "df", facts.n_cells, ["doc_id"])
    raw = {
        "count": F.col("n").cast("double"),
        "zeroone": F.lit(1.0),
        "tfidf": F.col("n") * F.col("_idf"),
    }[score]
    entry = F.struct("term", *extra, "n", raw.alias("weight"))
    rows = cells.groupBy("doc_id").agg(F.collect_list(entry).alias("entries"))
    return unit_length(rows) if score == "tfidf" else rows


def _weighted_in_rows(bags: DataFrame, vocab: DataFrame, facts: CorpusFacts, score: str, extra: list[str]) -> DataFrame:
    spark = bags.sparkSession
    table = vocab.select("term", *extra, smooth_idf(F.col("df"), facts.n_docs).alias("_idf")).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(table)
    cell = bags.schema["bag"].dataType.elementType
    entry = T.StructType([cell["term"], *[vocab.schema[c] for c in extra], cell["n"], T.StructField("weight", T.DoubleType())])
    schema = T.StructType([bags.schema["doc_id"], T.StructField("entries", T.ArrayType(entry))])
    return bags.select("doc_id", "bag").mapInArrow(_row_task(shared, extra, score), schema)


def _row_task(shared, extra: list[str], score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        terms = table["term"].combine_chunks()
        for batch in batches:
            # the words are looked up once a batch, the rows are made of few documents at a time
            found = pc.index_in(batch.column("bag").flatten().field("term"), terms)
            lo = 0
            for start in range(0, batch.num_rows, ROW_DOCUMENTS):
                part = batch.slice(start, ROW_DOCUMENTS)
                held = len(part.column("bag").flatten())
                yield _rows(part, found.slice(lo, held), table, extra, score)
                lo += held

    return run


def _rows(batch: pa.RecordBatch, at: pa.Array, table: pa.Table, extra: list[str], score: str) -> pa.RecordBatch:
    """The rows of some documents, whose cells have these places in the vocabulary."""
    bag = batch.column("bag")
    known = np.asarray(pc.is_valid(at))
    doc = np.repeat(np.arange(len(bag)), np.asarray(pc.fill_null(pc.list_value_length(bag), 0)))[known]
    at, cells = at.drop_null(), bag.flatten().filter(pa.array(known))
    n = np.asarray(cells.field("n")).astype(float)
    weight = {"count": lambda: n, "zeroone": lambda: np.ones(len(n)), "tfidf": lambda: n * np.asarray(table["_idf"].take(at))}[score]()
    if score == "tfidf":
        weight = weight / np.sqrt(np.bincount(doc, weight * weight, len(bag)))[doc]
    size = np.bincount(doc, minlength=len(bag))
    columns = [cells.field("term"), *[table[c].take(at).combine_chunks() for c in extra], cells.field("n"), pa.array(weight)]
    entries = pa.StructArray.from_arrays(columns, ["term", *extra, "n", "weight"])
    offsets = pa.array(np.concatenate(([0], np.cumsum(size[size > 0]))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").filter(pa.array(size > 0)), pa.ListArray.from_arrays(offsets, entries)],
        names=["doc_id", "entries"])


def score_lists(bags: DataFrame, vocab: DataFrame, facts: CorpusFacts, scores: Iterable[str]) -> tuple[DataFrame, Callable] | None:
    """For a task that wants the tf-idf rows as Arrow lists, ``terms``, which are places in the vocabulary, and one named
    by each score: the bags, and the function that makes those rows of them there. None for a vocabulary that does not travel."""
    width = F.octet_length("term") + F.lit(16)
    if int(vocab.agg(F.sum(width)).first()[0] or 0) > VOCAB_BYTES:
        return None
    table = vocab.select("term", smooth_idf(F.col("df"), facts.n_docs).alias("_idf")).toArrow().combine_chunks()
    table = table.append_column("_at", pa.array(np.arange(table.num_rows, dtype=np.int32)))
    return bags.select("doc_id", "bag"), _list_task(bags.sparkSession.sparkContext.broadcast(table), tuple(scores))


def _list_task(shared, scores: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value["term"].combine_chunks()
        for batch in _row_task(shared, ["_at"], "tfidf")(batches):
            rows = batch.column("entries")
            cells = rows.values
            term = pa.DictionaryArray.from_arrays(cells.field("_at"), words)
            score = {
                "count": lambda: cells.field("n").cast(pa.float64()),
                "zeroone": lambda: pa.array(np.ones(len(cells))),
                "tfidf": lambda: cells.field("weight"),
            }
            lists = [pa.ListArray.from_arrays(rows.offsets, x) for x in (term, *[score[s]() for s in scores])]
            yield pa.RecordBatch.from_arrays(lists, names=["terms", *scores])

    return run


def unit_length(rows: DataFrame) -> DataFrame:
    """Scale the entries of each document so that their squares add up to one."""

    def scale(entries: Column) -> Column:
        square = F.aggregate(
            entries, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]
        )
        return tx.let(
            F.sqrt(square),
            lambda norm: F.transform(
                entries, lambda e: e.withField("weight", e["weight"] / norm)
            ),
        )

    return rows.withColumn("entries", tx.let(F.col("entries"), scale))


def score_rows(bags: DataFrame, score: str) -> DataFrame:
    """Document rows for the two scores that need nothing but the document itself."""
    weight = {"count": lambda e: e["n"].cast("double"), "zeroone": lambda e: F.lit(1.0)}[score]
    return bags.select(
        "doc_id",
        F.transform(
            "bag",
            lambda e: F.struct(
                e["term"].alias("term"), e["n"].alias("n"), weight(e).alias("weight")
            ),
        ).alias("entries"),
    )


def cells(rows: DataFrame) -> DataFrame:
    """Document rows as one row per cell."""
    return tx.unnest(rows, ["doc_id"], F.inline_outer("entries"))


@dataclass(frozen=True)
class FittedMatrix:
    """A corpus taken apart once and written: what all scores share."""

    bags: DataFrame
    facts: CorpusFacts
    pattern: str = tx.TOKEN_PATTERN
    stop_list: list[str] | None = None  # the words left out, none being an empty list; None if not known

    @cached_property
    def frequency(self) -> DataFrame:
        """Document frequency of every term, counted when first asked for."""
        return durable(document_frequency(self.bags), "frequency")

    def vocab(self, min_df: int, only: DataFrame | None = None) -> DataFrame:
        """Terms of the model; with ``only`` just those asked for, counted on their own."""
        counted = self.frequency if only is None else document_frequency(self.bags, only)
        return vocabulary(counted, min_df)

    @cached_property
    def _indexes(self) -> dict[int, DataFrame]:
        return {}

    def index(self, min_df: int) -> DataFrame:
        """The numbered terms of the model, made when first asked for."""
        if min_df not in self._indexes:
            self._indexes[min_df] = durable(vocab_index(self.vocab(min_df)), "vocab")
        return self._indexes[min_df]

    def rows(self, score: str, min_df: int) -> DataFrame:
        return weighted_rows(self.bags, self.vocab(min_df), self.facts, score)

    def without(self, stop_words: Iterable[str]) -> FittedMatrix:
        """The same corpus without these words; the texts are not read again."""
        words = sorted({*stop_words, *(self.stop_list or [])})
        return fitted(durable(without_stop_words(self.bags, stop_words), "bags", compression="zstd"), self.pattern, words)


def fitted(bags: DataFrame, pattern: str = tx.TOKEN_PATTERN, stop_list: Iterable[str] | None = None) -> FittedMatrix:
    return FittedMatrix(bags, corpus_facts(bags), pattern, None if stop_list is None else list(stop_list))


def fit_matrix(
    corpus: DataFrame,
    stop_words: Iterable[str] | None = None,
    preprocess: Callable[[Column], Column] = tx.normalize,
    pattern: str = tx.TOKEN_PATTERN,
) -> FittedMatrix:
    """Tokenise once and write the bags."""
    words = sorted(set(stop_words)) if stop_words else []
    return fitted(durable(document_bags(corpus, words, preprocess, pattern), "bags", compression="zstd"), pattern, words)


def model_stats(frequency: DataFrame, facts: CorpusFacts, min_df: int, truncate: int | None = None) -> DataFrame:
    """One row: size of the model, of the corpus, and of what was left out."""
    stored = facts.n_docs if truncate is None else min(truncate, facts.n_docs)
    kept = F.col("df") >= min_df
    words = F.coalesce(F.sum(kept.cast("bigint")), F.lit(0))
    return frequency.agg(
        words.alias("wordcount"),
        F.lit(facts.n_docs).cast("bigint").alias("n_documents"),
        F.lit(stored).cast("bigint").alias("n_columns"),
        F.coalesce(F.sum((~kept).cast("bigint")), F.lit(0)).alias("ignored_count"),
        F.concat(words.cast("string"), F.lit("x"), F.lit(str(stored))).alias("size_label"),
    )
