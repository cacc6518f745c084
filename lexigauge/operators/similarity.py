"""Texts as vectors of a model, and cosines of pairs of texts.

A text vector is the mean over all its tokens of the term rows of the model, an unknown token
having the same small weight in every document. For a cosine the mean may be a sum, and the
constant part needs only how many unknown tokens there are and the sum of the known part:
no dense row is ever built.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.functions import stats
from lexigauge.functions import text as tx
from lexigauge.operators.tables import durable, skew_join, spread

# The functions that run in tasks travel with them: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN_WEIGHT = 1e-5
# A questionnaire up to this many (text, token) rows and pairs travels to every task; a larger one in blocks.
BROADCAST_ROWS = 20_000_000
# Beyond this many blocks, each a pass over the documents, the questionnaire is joined.
MAX_BLOCKS = 64
# Memory of the cells of documents that a task multiplies together, cells that it takes from a batch, entries that it
# looks at, and products that it makes, at once.
CHUNK_BYTES = 224 << 20
SLICE_CELLS = 1 << 20
STEP = 1 << 17
GROUP = 1 << 22
# Tokens of the texts that a task makes the means of, and numbers of the vectors that it needs for them.
BLOCK_TOKENS = 1_000_000
BLOCK_CELLS = 1 << 23
PRODUCTS = 1 << 22
# Numbers of the dense table of the words of most texts, and of the values of some documents for all texts.
DENSE_CELLS = 1 << 23
VALUE_CELLS = 1 << 20
# Time of a product of two terms and of a look-up, in parts of that of adding a cell to a text that holds its term.
PRODUCT_COST = 2
LOOKUP_COST = 3
SUMS = ("ab", "aa", "bb", "sa", "sb")


def text_bags(
    texts: DataFrame,
    stop_words: Iterable[str] | None = None,
    preprocess: Callable[[Column], Column] = tx.normalize,
    pattern: str = tx.TOKEN_PATTERN,
) -> DataFrame:
    """``(text_id, term, n)``: the token multiset of each text, one empty word for an empty one."""
    found = tx.guarded(tx.tokens(F.col("text"), stop_words, preprocess, pattern))
    return tx.unnest(texts, ["text_id"], F.inline_outer(tx.bag(found)))


def mark_known(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``known``: is the term a row of the model?"""
    present = vocab.select("term", F.lit(True).alias("known"))
    return tokens.join(present, "term", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens of each text that the model lacks."""
    return mark_known(tokens, vocab).filter(~F.col("known")).select("text_id", "term", "n")


def word_vectors(
    tokens: DataFrame, vocab: DataFrame, matrix: DataFrame, default: float = UNKNOWN_WEIGHT
) -> DataFrame:
    """Sparse vector of each token: its cells, or one row without document for the constant."""
    marked = mark_known(tokens, vocab)
    known = marked.filter("known").join(matrix, "term").select(
        "text_id", "term", "n", "known", "doc_id", "weight"
    )
    unknown = marked.filter("not known").select(
        "text_id", "term", "n", "known",
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(default).alias("weight"),
    )
    return known.unionByName(unknown)


def text_vectors(
    tokens: DataFrame, vocab: DataFrame, matrix: DataFrame, default: float = UNKNOWN_WEIGHT
) -> DataFrame:
    """Mean vector of each text: ``value`` where a known token touches the document, and ``base``,
    the value in every other document."""
    marked = mark_known(tokens, vocab)
    size = marked.groupBy("text_id").agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("_m"),
    )
    touched = (
        marked.filter("known").join(matrix, "term")
        .groupBy("text_id", "doc_id").agg(F.sum(F.col("n") * F.col("weight")).alias("_s"))
    )
    base = F.col("_m") * F.lit(default) / F.col("_n")
    return touched.join(size, "text_id").select(
        "text_id", "doc_id", (F.col("_s") / F.col("_n") + base).alias("value"), base.alias("base")
    )


# ---------------------------------------------------------------- cosines of given pairs


def pair_cosines(
    pairs: DataFrame,
    tokens: DataFrame,
    vocab: DataFrame,
    rows: DataFrame | dict[str, DataFrame],
    n_docs: int,
    default: float = UNKNOWN_WEIGHT,
    weights: tuple[str, ...] = ("weight",),
    broadcast_rows: int = BROADCAST_ROWS,
    lists: tuple[DataFrame, Callable] | None = None,
) -> DataFrame:
    """``pairs`` plus ``model`` (the name of the weight used) and ``similarity``.

    ``pairs`` has the text ids ``a`` and ``b`` and any other columns, which must make its rows
    unique; ``rows`` are document rows whose entries hold every field named in ``weights``.
    Only given pairs are compared. The questionnaire goes to the documents, in blocks where it is
    large, and each task returns one line per pair, so the matrix is not shuffled at all. ``lists``, where
    given, is a table and the function that makes the same rows of it in a task, see ``matrix.score_lists``.
    Models of one vocabulary and corpus whose rows are separate tables, with the field ``weight``, are given as a
    dictionary; all its tables are read in one pass and its keys are the values of ``model``.
    """
    if isinstance(rows, dict):
        weights = tuple(rows)
    marked = durable(mark_known(tokens, vocab), "tokens")
    unknown = marked.groupBy("text_id").agg(
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).cast("double").alias("_m")
    )
    full = durable(
        pairs.join(unknown.withColumnsRenamed({"text_id": "a", "_m": "ma"}), "a")
        .join(unknown.withColumnsRenamed({"text_id": "b", "_m": "mb"}), "b"),
        "pairs",
    )
    known = marked.filter("known").select("text_id", "term", "n")
    most = max(known.count(), full.count())
    if most <= broadcast_rows:
        sums = _sums_by_broadcast(full, known, rows, weights, lists)
    elif most <= broadcast_rows * MAX_BLOCKS:
        sums = _sums_by_blocks(full, known, rows, weights, -(-most // broadcast_rows), lists)
    elif isinstance(rows, dict):
        def named(w: str) -> Column:
            return F.transform("entries", lambda e: F.struct(e["term"].alias("term"), e["weight"].alias(w))).alias("entries")

        sums = reduce(DataFrame.unionByName, [_sums_by_join(full, known, r.select("doc_id", named(w)), (w,)) for w, r in rows.items()])
    else:
        sums = _sums_by_join(full, known, rows, weights)
    names = F.explode(F.array(*[F.lit(w) for w in weights])).alias("model")
    out = full.select("*", names).join(sums, [*full.columns, "model"], "left")
    ab, aa, bb, sa, sb = (F.coalesce(F.col(c), F.lit(0.0)) for c in SUMS)
    ma, mb = F.col("ma"), F.col("mb")
    eps, square = F.lit(default), F.lit(n_docs * default * default)
    similarity = stats.cosine_from(
        ab + eps * (mb * sa + ma * sb) + square * ma * mb,
        aa + eps * 2.0 * ma * sa + square * ma * ma,
        bb + eps * 2.0 * mb * sb + square * mb * mb,
    )
    return out.select(*pairs.columns, "model", similarity.alias("similarity"))


def _sums_by_join(
    pairs: DataFrame, tokens: DataFrame, rows: DataFrame, weights: tuple[str, ...]
) -> DataFrame:
    """Any size: both texts of a pair side by side per term, then per document, then per pair."""
    key = pairs.columns

    def side(text: str, left: Column, right: Column) -> DataFrame:
        renamed = tokens.withColumnRenamed("text_id", text)
        return pairs.join(renamed, text).select(*key, "term", left.alias("na"), right.alias("nb"))

    n, zero = F.col("n"), F.lit(0)
    terms = durable(
        side("a", n, zero).unionByName(side("b", zero, n))
        .groupBy(*key, "term").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")),
        "pair-terms",
    )
    asked = terms.groupBy("term").agg(F.count("*").alias("_pairs"))
    cells = tx.unnest(rows, ["doc_id"], F.inline_outer("entries")).join(asked, "term", "left_semi")
    frequency = durable(cells.groupBy("term").agg(F.count("*").alias("_df")), "pair-df")
    total = int(frequency.agg(F.sum("_df")).first()[0] or 0)
    # A hot term is spread over its documents; each part meets all pairs that hold the term.
    joined = skew_join(
        cells, terms.join(frequency, "term"), ["term"], "_df", total, ["doc_id"]
    )
    named = F.explode(
        F.array(*[F.struct(F.lit(w).alias("model"), F.col(w).alias("w")) for w in weights])
    ).alias("m")
    per_doc = (
        joined.select(*key, "doc_id", "na", "nb", named)
        .groupBy(*key, "doc_id", "m.model")
        .agg(F.sum(F.col("na") * F.col("m.w")).alias("x"), F.sum(F.col("nb") * F.col("m.w")).alias("y"))
    )
    x, y = F.col("x"), F.col("y")
    return per_doc.groupBy(*key, "model").agg(
        F.sum(x * y).alias("ab"), F.sum(x * x).alias("aa"), F.sum(y * y).alias("bb"),
        F.sum(x).alias("sa"), F.sum(y).alias("sb"),
    )


def _sums_by_blocks(
    pairs: DataFrame, tokens: DataFrame, rows: DataFrame | dict[str, DataFrame], weights: tuple[str, ...], blocks: int,
    lists: tuple[DataFrame, Callable] | None = None,
) -> DataFrame:
    """Larger questionnaires: the pairs in blocks of their first texts, one pass over the rows for each."""
    numbered = pairs.withColumn("_block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    parts = []
    for i in range(blocks):
        block = durable(numbered.filter(F.col("_block") == i).drop("_block"), "pair-block")
        listed = block.select(F.col("a").alias("text_id")).unionByName(block.select(F.col("b").alias("text_id")))
        own = tokens.join(listed.distinct(), "text_id", "left_semi")
        parts.append(_sums_by_broadcast(block, own, rows, weights, lists))
    return reduce(DataFrame.unionByName, parts)


def _sums_by_broadcast(
    pairs: DataFrame, tokens: DataFrame, rows: DataFrame | dict[str, DataFrame], weights: tuple[str, ...],
    lists: tuple[DataFrame, Callable] | None = None,
) -> DataFrame:
    """Bounded questionnaire: one pass over the document rows. A task returns a line for each pair whose
    texts meet in its documents, and one for each text that they touch; tasks are as many as can run.

    A product of two texts is the sum of the products of their terms: with G the products of the terms'
    rows, a'Gb. That work grows with the squares of the documents' lengths and, once a task, with the lengths of
    the pairs. A document so long that its values for all texts cost less than its square is added that way
    instead, so no document costs more than either."""
    spark = pairs.sparkSession
    key = pairs.columns
    table = pairs.toArrow()
    text_ids = pc.unique(
        pa.chunked_array([*table["a"].chunks, *table["b"].chunks], table["a"].type)
    )
    # the terms of most texts first: their rows of products are the shortest
    term_ids = tokens.groupBy("term").count().orderBy(F.desc("count"), "term").select("term").toArrow()["term"].combine_chunks()
    plan = {
        "a": np.asarray(pc.index_in(table["a"], text_ids)),
        "b": np.asarray(pc.index_in(table["b"], text_ids)),
        "n_texts": len(text_ids),
        "terms": term_ids,
        **_token_lists(tokens, text_ids, term_ids),
    }
    shared = spark.sparkContext.broadcast(plan)
    terms = F.col("entries.term").alias("terms")
    if isinstance(rows, dict):
        weight = F.col("entries.weight").cast("array<double>").alias("weight")
        source, make = reduce(DataFrame.unionByName, [r.select(terms, weight, F.lit(w).alias("model")) for w, r in rows.items()]), None
    else:
        values = [F.col(f"entries.{w}").cast("array<double>").alias(w) for w in weights]
        source, make = lists or (rows.select(terms, *values), None)
    few = source.coalesce(spark.sparkContext.defaultParallelism)
    lines = few.mapInArrow(_line_maker(shared, weights, make), "model string, of_pair boolean, idx bigint, x double, y double")
    lines = durable(lines.groupBy("model", "of_pair", "idx").agg(F.sum("x").alias("x"), F.sum("y").alias("y")), "sums")
    number = pa.array(np.arange(table.num_rows))
    placed = table.append_column("_p", number).append_column("_a", pa.array(plan["a"])).append_column("_b", pa.array(plan["b"]))
    named = spark.createDataFrame(placed).select(
        "*", F.explode(F.array(*[F.lit(w) for w in weights])).alias("model")
    )

    def part(of_pair: bool, at: str, x: str, y: str) -> DataFrame:
        return lines.filter(F.col("of_pair") == of_pair).select(
            "model", F.col("idx").alias(at), F.col("x").alias(x), F.col("y").alias(y)
        )

    joined = (
        named.join(part(True, "_p", "ab", "_"), ["model", "_p"], "left")
        .join(part(False, "_a", "aa", "sa"), ["model", "_a"], "left")
        .join(part(False, "_b", "bb", "sb"), ["model", "_b"], "left")
    )
    return joined.select(*key, "model", *SUMS)


def _token_lists(tokens: DataFrame, text_ids: pa.Array, term_ids: pa.Array) -> dict:
    """The texts that hold each term and how often, term by term. Tokens reach the driver as numbers, in few bytes each."""
    spark = tokens.sparkSession

    def numbers(ids: pa.Array, name: str, number: str) -> DataFrame:
        return spark.createDataFrame(pa.table({name: ids, number: pa.array(np.arange(len(ids), dtype=np.int32))}))

    named = tokens.join(numbers(text_ids, "text_id", "_text"), "text_id").join(numbers(term_ids, "term", "_term"), "term")
    found = named.select("_text", "_term", "n").toArrow()
    text, term, n = (found[c].to_numpy() for c in ("_text", "_term", "n"))
    order = np.argsort(term, kind="stable")
    n = _short_floats(n[order].astype(float))
    return {"text": text[order].astype(np.int32), "n": n, "length": np.bincount(term, minlength=len(term_ids))}


def _short_floats(values: np.ndarray) -> np.ndarray:
    """The same numbers in half the memory, where they stay the same."""
    short = values.astype(np.float32)
    return short if (short == values).all() else values


def _line_maker(shared, weights: tuple[str, ...], make: Callable | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        met = {w: np.zeros((1, len(plan["a"]))) for w in weights}
        touched = {w: np.zeros((2, plan["n_texts"])) for w in weights}
        totals = {w: np.zeros(len(plan["terms"])) for w in weights}
        waiting, docs, held = {}, 0, 0  # columns of cells by the scores of a table

        def add():
            nonlocal docs, held
            for own, parts in waiting.items():
                columns = []
                for column in parts:
                    columns.append(np.concatenate(column))
                    column.clear()
                _add_short(plan, columns[0], columns.pop(1), dict(zip(own, columns[1:], strict=True)), met, touched)
            waiting.clear()
            docs = held = 0

        for batch in make(batches) if make else batches:
            for own, table in _tables(batch, weights):
                # few cells at a time; only the short documents wait for others
                for part in _parts(table):
                    term, doc, values = _add_long(plan, part, own, met, touched, totals)
                    columns = [term.astype(np.int32), (doc + docs).astype(np.int32), *map(_short_floats, values.values())]
                    for column, more in zip(waiting.setdefault(own, [[] for _ in columns]), columns, strict=True):
                        column.append(more)
                    docs += part.num_rows
                    held += len(term) * 8 + sum(x.nbytes for x in columns)
                    if held >= CHUNK_BYTES:
                        add()
        add()
        _add_totals(plan, totals, touched)
        for w in weights:
            for of_pair, sums in ((True, met[w]), (False, touched[w])):
                idx = np.flatnonzero(sums.any(axis=0))
                yield pa.record_batch(
                    [pa.array([w] * len(idx), pa.string()), pa.array([of_pair] * len(idx), pa.bool_()), pa.array(idx),
                     pa.array(sums[0, idx]), pa.array(sums[-1, idx])],
                    names=["model", "of_pair", "idx", "x", "y"])

    return run


def _tables(batch: pa.RecordBatch, weights: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], pa.RecordBatch]]:
    """The documents of a batch with the scores that they have: all, or that of the model they are rows of."""
    if "model" not in batch.schema.names:
        yield weights, batch
        return
    model = batch.column("model")
    for w in pc.unique(model).to_pylist():
        own = batch.filter(pc.equal(model, w))
        yield (w,), pa.record_batch([own.column("terms"), own.column("weight")], names=["terms", w])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of up to SLICE_CELLS cells, a longer document alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column("terms")), 0)).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_CELLS, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... (count[0] numbers), first[1], ... in one array."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _steps(count: np.ndarray) -> Iterator[slice]:
    """Slices of lists of these lengths, each of about STEP entries in all, or of one longer list."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")))
        yield slice(lo, hi)
        lo = hi


def _numbers(plan: dict, terms: pa.Array) -> pa.Array:
    """Numbers of the terms in the plan. Terms that come as places in a vocabulary need one search of that."""
    if not pa.types.is_dictionary(terms.type):
        return pc.index_in(terms, plan["terms"])
    words = terms.dictionary
    key = (words.buffers()[-1].address, words.offset, len(words))
    if plan.get("vocabulary", (None,))[0] != key:
        plan["vocabulary"] = key, words, pc.index_in(words, plan["terms"])
    return plan["vocabulary"][2].take(terms.indices)


def _asked_cells(plan: dict, batch: pa.RecordBatch, weights: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Term number, document and values of the cells of a batch that some text asks for."""
    lists = batch.column("terms")
    found = _numbers(plan, lists.flatten())
    hit = np.asarray(pc.is_valid(found))
    term = np.asarray(found.drop_null()).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))[hit]
    return term, doc, *[np.asarray(batch.column(w).flatten())[hit] for w in weights]


def _text_lists(plan: dict) -> dict:
    """The terms of each text side by side, and the pairs that it is in, as made from the plan once a worker."""
    if "lists" not in plan:
        m, n_texts, pairs = len(plan["terms"]), plan["n_texts"], np.arange(len(plan["a"]))
        term = np.repeat(np.arange(m, dtype=np.int32), plan["length"])
        order = np.argsort(plan["text"], kind="stable")
        x, y = np.concatenate([plan["a"], plan["b"]]), np.concatenate([plan["b"], plan["a"]])
        by_x, degree, size = np.argsort(x, kind="stable"), np.bincount(x, minlength=n_texts), np.bincount(plan["text"], minlength=n_texts)
        plan["lists"] = {
            "term": term[order], "n": plan["n"][order], "size": size, "first": np.cumsum(size) - size,
            "other": y[by_x], "pair": np.concatenate([pairs, pairs])[by_x], "degree": degree, "from": np.cumsum(degree) - degree,
            "looks": float((size.astype(float) * size).sum() / 2 + (size[plan["a"]].astype(float) * size[plan["b"]]).sum()),
        }
        # the words of most texts as a dense table; a document's values for all texts are one product with it
        length = plan["length"]
        dense = np.argsort(-length, kind="stable")[: min(256, DENSE_CELLS // max(1, n_texts))]
        dense = dense[length[dense] * 16 >= max(16, n_texts)]
        column = np.full(m, -1)
        column[dense] = np.arange(len(dense))
        table = np.zeros((n_texts, len(dense)))
        hot = column[term] >= 0
        np.add.at(table, (plan["text"][hot], column[term][hot]), plan["n"][hot])
        plan["lists"] |= {
            "dense": table, "column": column, "cost": np.where(column >= 0, 0, length),
            "value_cost": n_texts * len(dense) / 64 + (n_texts + 2 * len(pairs)) / 3,
        }
    return plan["lists"]


def _add_batch(plan: dict, batch: pa.RecordBatch, weights: tuple[str, ...], met: dict, touched: dict) -> None:
    """Add the documents of one Arrow batch to the products of every pair and to the squares and sums of
    every text, each document by the way that costs less."""
    totals = {w: np.zeros(len(plan["terms"])) for w in weights}
    _add_short(plan, *_add_long(plan, batch, weights, met, touched, totals), met, touched)
    _add_totals(plan, totals, touched)


def _add_totals(plan: dict, totals: dict, touched: dict) -> None:
    """Add to the sum of every text those of its terms over the documents."""
    for w, total in totals.items():
        touched[w][1] += np.bincount(plan["text"], plan["n"] * np.repeat(total, plan["length"]), plan["n_texts"])


def _add_long(
    plan: dict, batch: pa.RecordBatch, weights: tuple[str, ...], met: dict, touched: dict, totals: dict
) -> tuple[np.ndarray, np.ndarray, dict]:
    """Add the cells of all documents of a batch to the sums of their terms, and of documents whose square costs more
    than their values for all texts also the products. Returns the cells of the others."""
    term, doc, *values = _asked_cells(plan, batch, weights)
    values = dict(zip(weights, values, strict=True))
    if not len(term):
        return term, doc, values
    side, m = _text_lists(plan), len(plan["terms"])
    order = np.argsort(doc * m + term, kind="stable")
    term, doc, values = term[order], doc[order], {w: v[order] for w, v in values.items()}
    new = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
    if not new.all():  # a document that holds a term twice
        values = {w: np.add.reduceat(v, np.flatnonzero(new)) for w, v in values.items()}
        term, doc = term[new], doc[new]
    for w, v in values.items():
        totals[w] += np.bincount(term, v, m)
    square, whole = _costs(side, term, doc)
    long = (square > whole)[doc]
    if long.any():
        _add_values(plan, term[long], doc[long], {w: v[long] for w, v in values.items()}, met, touched)
    return term[~long], doc[~long], {w: v[~long] for w, v in values.items()}


def _costs(side: dict, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the square of each document costs, and what its values for all texts do."""
    size = np.bincount(doc)
    return PRODUCT_COST * size * (size + 1.0) / 2, np.bincount(doc, side["cost"][term]) + side["value_cost"]


def _add_short(plan: dict, term: np.ndarray, doc: np.ndarray, values: dict, met: dict, touched: dict) -> None:
    """Add the products of the other documents, sorted by document and term: all by the look-ups, which cost the
    same for any number of documents, or all by their values."""
    if not len(term):
        return
    side = _text_lists(plan)
    doc = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    square, whole = _costs(side, term, doc)
    add = _add_values if LOOKUP_COST * side["looks"] + square.sum() > whole.sum() else _add_products
    add(plan, term, doc, values, met, touched)


def _add_values(plan: dict, term: np.ndarray, doc: np.ndarray, values: dict, met: dict, touched: dict) -> None:
    """Products and squares of the cells of whole documents by their values for all texts, a few documents at a
    time: the words of most texts by one dense product, the others cell by cell to the texts that hold them."""
    side, n_texts, length = _text_lists(plan), plan["n_texts"], plan["length"]
    texts_from = np.cumsum(length) - length
    few = max(1, VALUE_CELLS // max(1, n_texts, len(plan["a"])))
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    bounds = [*at[::few], len(doc)]
    numbers = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        t, d = term[lo:hi], numbers[lo:hi] - numbers[lo]
        column, n_docs = side["column"][t], int(numbers[hi - 1] - numbers[lo]) + 1
        hot = column >= 0
        rare = np.flatnonzero(~hot & (length[t] > 0))
        found = {}
        for w, v in values.items():
            some = np.zeros((side["dense"].shape[1], n_docs))
            some[column[hot], d[hot]] = v[lo:hi][hot]
            found[w] = side["dense"] @ some
        for part in _steps(length[t[rare]]):
            c = rare[part]
            held = length[t[c]]
            own = _ranges(texts_from[t[c]], held)
            to, n = plan["text"][own].astype(np.int64) * n_docs, plan["n"][own].astype(float)
            to += np.repeat(d[c], held)
            for w, v in values.items():
                np.add.at(found[w].reshape(-1), to, n * np.repeat(v[lo:hi][c], held))
        for w, x in found.items():
            touched[w][0] += np.einsum("ij,ij->i", x, x)
            met[w][0] += np.einsum("ij,ij->i", x[plan["a"]], x[plan["b"]])


def _add_products(plan: dict, term: np.ndarray, doc: np.ndarray, values: dict, met: dict, touched: dict) -> None:
    """The same without those values. The products of a term with those up to itself, its own one halved,
    are added up over the documents that hold it; then the texts that hold it look up there what the terms of
    their partners, and their own, bring. Both directions of a pair together make the whole product."""
    side, m = _text_lists(plan), len(plan["terms"])
    size = np.bincount(doc)
    # terms of the cell's document up to it
    before = (np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size) + 1).astype(np.int32)
    length, held = plan["length"], np.bincount(term, minlength=m)
    by_term = np.argsort(term, kind="stable").astype(np.int32)
    cells_from, texts_from = np.cumsum(held) - held, np.cumsum(length) - length
    asked = np.flatnonzero((held > 0) & (length > 0))
    brings = np.bincount(term, before, m)[asked]
    looks = np.bincount(np.repeat(np.arange(m), length), 1.0 + side["degree"][plan["text"]], m)[asked]
    slots = max(1, min(PRODUCTS, 64 * len(term)) // m)
    products = {w: np.zeros(min(slots, len(asked)) * m) for w in values}
    # rare terms many at a time, a frequent one alone; each has its row of products
    for terms in _groups(asked, slots, brings, looks):
        cells = by_term[_ranges(cells_from[terms], held[terms])]
        row, count = np.repeat(np.arange(len(terms)) * m, held[terms]), before[cells].astype(np.int64)
        start, made = cells - count + 1, []
        for part in _steps(count):
            held_by, one = count[part], cells[part]
            at = _ranges(start[part], held_by)
            to = np.repeat(row[part], held_by)
            to += term.take(at)
            for w, v in values.items():
                x = np.repeat(v.take(one).astype(float), held_by)
                x *= v.take(at)
                np.add.at(products[w], to, x)
            made.append(to)
        diagonal = np.arange(len(terms)) * m + terms
        for w in values:
            products[w][diagonal] /= 2
        own = _ranges(texts_from[terms], length[terms])
        text, n, t = plan["text"][own], plan["n"][own], np.repeat(np.arange(len(terms)), length[terms])
        degree = side["degree"][text]
        link = _ranges(side["from"][text], degree)
        partner, weight = np.concatenate([text, side["other"][link]]), np.concatenate([n, np.repeat(n, degree)])
        t = np.concatenate([t, np.repeat(t, degree)])
        first = side["first"][partner]
        upto = _upto(side["term"], first, side["size"][partner], terms[t])
        some = np.flatnonzero(upto)
        for part in _steps(upto[some]):
            j = some[part]
            listed = upto[j]
            at = _ranges(first[j], listed)
            to = np.repeat(t[j] * m, listed)
            to += side["term"].take(at)
            times, ends, mine = side["n"].take(at), np.cumsum(listed) - listed, j < len(text)
            for w in values:
                x = products[w].take(to)
                x *= times
                found = np.add.reduceat(x, ends) * weight[j]
                np.add.at(touched[w][0], partner[j[mine]], 2.0 * found[mine])
                np.add.at(met[w][0], side["pair"][link[j[~mine] - len(text)]], found[~mine])
        for to in made:
            for w in values:
                products[w][to] = 0.0


def _upto(terms: np.ndarray, first: np.ndarray, size: np.ndarray, term: np.ndarray) -> np.ndarray:
    """How many of the sorted terms of each list, which begins there, are no larger than its term."""
    lo, hi = first.copy(), first + size
    for _ in range(int(size.max(initial=0)).bit_length()):
        middle = (lo + hi) >> 1
        small = (lo < hi) & (terms.take(middle, mode="clip") <= term)
        hi = np.where(small, hi, np.minimum(hi, middle))
        lo = np.where(small, middle + 1, lo)
    return lo - first


def _groups(terms: np.ndarray, most: int, *loads: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of at most so many terms, with no load above GROUP unless a term alone has it."""
    sums = [np.cumsum(x) for x in loads]
    lo = 0
    while lo < len(terms):
        ends = [int(np.searchsorted(s, (s[lo - 1] if lo else 0) + GROUP, side="right")) for s in sums]
        hi = max(lo + 1, min(lo + most, *ends))
        yield terms[lo:hi]
        lo = hi


# ---------------------------------------------------------------- dense models


def dense_text_vectors(tokens: DataFrame, term_vectors: DataFrame, unknown: list[float]) -> DataFrame:
    """Mean of the term vectors of each text, for models that give every term a short array.

    Texts are dealt into blocks; a block gets its tokens and, once each, the vectors of its terms, so that
    a vector does not travel for every token."""
    spark = tokens.sparkSession
    most = BLOCK_CELLS // len(unknown)
    if term_vectors.count() <= most:  # all of them fit a task
        most = BLOCK_TOKENS
    blocks = max(spark.sparkContext.defaultParallelism, -(-tokens.count() // max(1, min(most, BLOCK_TOKENS))))
    kinds = dict(tokens.dtypes)
    dealt = tokens.select(F.pmod(F.xxhash64("text_id"), F.lit(blocks)).alias("block"), "text_id", "term", F.col("n").cast("double").alias("n"))
    asked = dealt.select("block", "term").distinct()
    vectors = asked.join(term_vectors, "term").select(
        "block", F.lit(None).cast(kinds["text_id"]).alias("text_id"), "term", F.lit(None).cast("double").alias("n"), "vec"
    )
    whole = dealt.withColumn("vec", F.lit(None).cast("array<double>")).unionByName(vectors)
    return whole.groupBy("block").applyInArrow(_text_means(unknown), f"text_id {kinds['text_id']}, vec array<double>")


def _text_means(unknown: list[float]) -> Callable[[pa.Table], pa.Table]:
    """Means of the vectors of the texts of one block, a bounded number of tokens at a time."""

    def run(table: pa.Table) -> pa.Table:
        vec = table["vec"].combine_chunks()
        given = pc.is_valid(vec)
        names, vec = table["term"].combine_chunks().filter(given), vec.filter(given)
        own = table.filter(pc.invert(given))
        texts = own["text_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        text, n = np.asarray(texts.indices), np.asarray(own["n"])
        at = np.asarray(pc.fill_null(pc.index_in(own["term"].combine_chunks(), names), len(names)))
        k = len(unknown)
        rows = np.vstack([np.asarray(vec.flatten()).reshape(-1, k), np.asarray([unknown], float)])
        order = np.argsort(text, kind="stable")
        total = np.zeros((len(texts.dictionary), k))
        for lo in range(0, len(order), max(1, STEP // k)):
            part = order[lo : lo + max(1, STEP // k)]
            ids, first = np.unique(text[part], return_index=True)
            total[ids] += np.add.reduceat(rows[at[part]] * n[part][:, None], first, axis=0)
        total /= np.bincount(text, n, len(total))[:, None]
        offsets = pa.array(np.arange(len(total) + 1, dtype=np.int32) * k)
        return pa.table({"text_id": texts.dictionary, "vec": pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))})

    return run


def dense_pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` plus ``similarity`` from one vector per text."""
    va = vectors.withColumnsRenamed({"text_id": "a", "vec": "va"})
    vb = vectors.withColumnsRenamed({"text_id": "b", "vec": "vb"})
    return pairs.join(va, "a").join(vb, "b").select(
        *pairs.columns, stats.cosine(F.col("va"), F.col("vb")).alias("similarity")
    )
