"""Audit of how far the sources of a language are apart in their words, with copies of a text collapsed.

Identical texts of a language become one row with the number of documents that each source has of it;
that text is tokenised once, and its term counts are added to each source so many times. Pairs of sources
are then compared through the terms that they hold: for all other terms a source has one and the same
share, so a sum over the whole vocabulary is a constant plus corrections at the cells that exist.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared, pieces, texts_of
from lexigauge.operators.tables import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the contract.
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TERM_RANKS = 50

# Counts that a task holds before it hands them on.
HELD = 1 << 19
# Cells (source, term) of a block of terms whose pairs of sources are added up in one task: as many as a
# language has pairs of sources, so that there are no more sums than cells, within these bounds.
BLOCK_CELLS = (1 << 15, 1 << 21)

_LETTERS = bytes([c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)])


def terms_of(text: bytes | None) -> list[bytes]:
    """Lower-cased terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_LETTERS).split() if text else []


def collapse(docs: DataFrame) -> DataFrame:
    """``(lang, text, sources array<struct<source, n>>)``: each text of a language once, with the documents
    that each source has of it. Texts are compared by their SHA-256. Copies are taken together before the
    shuffle, so a text that fills a third of all rows reaches its task as one row of each."""
    keyed = docs.select("lang", "source", "text", F.unhex(F.sha2("text", 256)).alias("key"))
    counted = keyed.groupBy("lang", "key", "source").agg(F.count("*").alias("n"))
    sources = counted.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    once = keyed.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return once.join(sources, ["lang", "key"]).select("lang", "text", "sources")


def source_counts(collapsed: DataFrame) -> DataFrame:
    """``(lang, source, term, docs, n)``: documents of a source that hold a term, and its occurrences."""
    schema = "lang string, source string, term string, docs bigint, n bigint"

    def hand_on(docs: dict, times: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), held in docs.items():
            terms = list(held)
            own = times[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64()),
                 pa.array([own[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, times, held = defaultdict(Counter), defaultdict(Counter), 0
        for piece in pieces(batches):
            for lang, text, sources in zip(piece.column("lang").to_pylist(), texts_of(piece), piece.column("sources").to_pylist(), strict=True):
                words = terms_of(text)
                counts = Counter(words) if len(sources) > 1 or sources[0]["n"] > 1 else None
                for s in sources:
                    key, n = (lang, s["source"]), s["n"]
                    before = len(docs[key])
                    if n == 1:
                        docs[key].update(set(words))
                        times[key].update(words)
                    else:
                        own_docs, own_times = docs[key], times[key]
                        for term, c in counts.items():
                            own_docs[term] += n
                            own_times[term] += n * c
                    held += len(docs[key]) - before
                    if held > HELD:
                        yield from hand_on(docs, times)
                        docs, times, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from hand_on(docs, times)

    found = collapsed.mapInArrow(run, schema)
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * vocabulary)), exact at any size."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    below = (total + SMOOTH * vocabulary).cast("decimal(19,0)")
    return (F.call_function("div", top, below) + 1).cast("bigint")


def _block_sums(shared: Shared):
    """Sums over the terms of a block, for pairs of sources: what each source's own cells add to the
    constant, and what cells of the same term take back."""

    def run(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        names, base = shared.value[lang]
        number = {s: i for i, s in enumerate(names)}
        source = np.array([number[s] for s in table["source"].to_pylist()], np.int64)
        term = np.asarray(table["term"].combine_chunks().dictionary_encode().indices).astype(np.int64)
        p = np.asarray(table["p"]).astype(np.int64)
        at = np.argsort(term, kind="stable")
        source, term, p = source[at], term[at], p[at]
        size = np.bincount(term)
        begin = np.cumsum(size) - size
        by_source = np.argsort(source, kind="stable")
        ends = np.cumsum(np.bincount(source, minlength=len(names)))
        low, high, value = [], [], []
        everyone = np.arange(len(names))
        for i in np.unique(source).tolist():
            own = by_source[ends[i - 1] if i else 0 : ends[i]]
            # own cells against the constant of every other source
            held = np.sort(p[own])
            below = np.concatenate([[0], np.cumsum(held)])
            under = np.searchsorted(held, base)
            apart = (base * under - below[under]) + (below[-1] - below[under] - base * (len(held) - under))
            total = apart - len(held) * np.abs(base[i] - base)
            # cells of the same terms
            times = size[term[own]]
            every = np.repeat(begin[term[own]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            mine, other, yours = np.repeat(p[own], times), source[every], p[every]
            more = np.abs(mine - yours) - np.abs(mine - base[other]) - np.abs(base[i] - yours) + np.abs(base[i] - base[other])
            later = other > i  # each pair of cells once
            np.add.at(total, other[later], more[later])
            keep = everyone != i
            low.append(np.minimum(everyone, i)[keep])
            high.append(np.maximum(everyone, i)[keep])
            value.append(total[keep])
        low, high, value = np.concatenate(low), np.concatenate(high), np.concatenate(value)
        pair, which = np.unique(low * len(names) + high, return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, which, value)
        low, high = [names[i] for i in (pair // len(names)).tolist()], [names[i] for i in (pair % len(names)).tolist()]
        return pa.table({"lang": pa.array([lang] * len(pair), pa.string()), "a": pa.array(low, pa.string()), "b": pa.array(high, pa.string()), "x": pa.array(total)})

    return run


def _pairs(cells: DataFrame, groups: DataFrame, block_cells: tuple[int, int]) -> DataFrame:
    """``(lang, source, item, value)`` for all pairs of sources of a language."""
    spark = cells.sparkSession
    # one entry for each group; the result has a row for each two of them
    known = defaultdict(list)
    for r in groups.select("lang", "source", "base").collect():
        known[r["lang"]].append((r["source"], r["base"]))
    table = {g: ([s for s, _ in sorted(x)], np.array([b for _, b in sorted(x)], np.int64)) for g, x in known.items()}
    shared = Shared(spark, table)
    least, most = block_cells
    pairs = F.pow(F.approx_count_distinct("source"), F.lit(2))
    size = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), pairs))
    blocks = cells.groupBy("lang").agg(F.ceil(F.count("*") / size).alias("blocks"))
    # one row for each language; by a shuffled join all blocks of a language would stay in one task
    dealt = cells.join(F.broadcast(blocks), "lang").select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    sums = dealt.groupBy("lang", "block").applyInArrow(_block_sums(shared), "lang string, a string, b string, x bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))
    one, two = groups.alias("g"), groups.alias("h")
    met = one.join(two, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source"))).select(
        F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("h.source").alias("item"),
        F.least("g.source", "h.source").alias("a"), F.greatest("g.source", "h.source").alias("b"),
        (F.col("g.vocabulary") * F.abs(F.col("g.base") - F.col("h.base"))).alias("constant"),
    )
    value = F.col("constant") + F.coalesce("x", F.lit(0))
    return met.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", value.cast("bigint").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, block_cells: tuple[int, int] = BLOCK_CELLS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: how far each source of a language is from each other one, the sum of the differences of
    their smoothed shares over the terms that at least ``min_docs`` documents of the language hold. Part
    ``term``: the ``ranks`` terms of which a source has more than its language, by how much. Null text,
    lang and source count as ''. An empty text counts as a document of its group. Repeated rows count each
    time, through their number. A language without kept terms has pairs of value 0. An empty table gives
    no rows. Other columns are not looked at.
    """
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # the rows of one term, one for each source, side by side: rare terms go before anything is written
    of_term = Window.partitionBy("lang", "term")
    cells = source_counts(collapse(filled)).withColumn("held", F.sum("docs").over(of_term)).withColumn("all", F.sum("n").over(of_term))
    cells = durable(cells.filter(F.col("held") >= min_docs).select("lang", "source", "term", "n", "all"), "kept-cells")
    kept = cells.groupBy("lang", "term").agg(F.first("all").alias("all"))
    languages = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("all").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = filled.select("lang", "source").distinct().join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    groups = durable(
        groups.select(
            "lang", "source", F.coalesce("vocabulary", none).alias("vocabulary"), "lang_total", total.alias("total"),
            F.when(F.col("vocabulary") > 0, share(none, total, F.col("vocabulary"))).otherwise(none).alias("base"),
        ),
        "groups",
    )
    placed = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
        share(F.col("all"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
    )
    placed = durable(placed, "shares")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))

    pairs = ranked(_pairs(placed, groups, block_cells), "pair")
    over = placed.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(ranked(over, "term").filter(F.col("rank") <= ranks))
