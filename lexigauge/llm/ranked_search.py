"""Ranked lexical search: short lists term at a time, long lists document at a time.

Documents are indexed in segments of bounded size. Within a segment a query's short lists are summed
into accumulators (term at a time); these then stand as one more list, with the largest accumulator as
its bound, beside the long lists, over which documents go by in ranges. Lists whose bounds together
stay below the score of the k-th best document so far bring in no document; they are only looked up for
the documents that others bring in and that can still reach that score. Ranges whose bounds do not reach
it are left out whole. Each task keeps its best documents per query; only these are shuffled.
"""

from __future__ import annotations

import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared, letter_words, pieces, texts_of
from lexigauge.operators.tables import durable, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 20
# Text of one segment; a longer text is a segment of its own.
SEGMENT_BYTES = 16 << 20
# Terms up to this size travel to the index builders; beyond that the index holds every term.
TERM_BYTES = 32 << 20
# (item, term) rows of the queries that are searched for in one pass over the index.
BLOCK_ROWS = 200_000
# A list of at most a SHORT-th of a segment's documents is summed beforehand.
SHORT = 32
# Documents that go by at once.
RANGE = 512
# Tasks' results of an item meet in so many places first, then in one.
MERGE = 64

INDEX_SCHEMA = "ids array<bigint>, sizes array<bigint>, terms array<binary>, dfs array<int>, docs array<int>, tfs array<int>"


# ---------------------------------------------------------------- index


def _one_row(values: list[pa.Array]) -> pa.RecordBatch:
    columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "terms", "dfs", "docs", "tfs"])


def _segment(ids: list, sizes: list[int], words: dict[bytes, int], lists: list[tuple]) -> pa.RecordBatch:
    """One segment from each document's (term numbers, frequencies), in the order of the terms."""
    spelled = sorted(words)
    place = np.empty(len(spelled), np.int64)
    place[np.fromiter((words[w] for w in spelled), np.int64, len(spelled))] = np.arange(len(spelled))
    doc = np.repeat(np.arange(len(lists)), [len(x) for x, _ in lists])
    term = place[np.fromiter((t for x, _ in lists for t in x), np.int64, len(doc))]
    tf = np.fromiter((n for _, x in lists for n in x), np.int64, len(doc))
    at = np.argsort(term, kind="stable")
    return _one_row([
        pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spelled, pa.binary()),
        pa.array(np.bincount(term, minlength=len(spelled)).astype(np.int32)),
        pa.array(doc[at].astype(np.int32)), pa.array(tf[at].astype(np.int32)),
    ])


def build_index(docs: DataFrame, keep: Shared | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Written inverted segments of ``docs (doc_id, text)``: numbers and lengths of the documents that
    hold a term, the terms in byte order, and their lists (document's place, frequency) one after the
    other. ``keep`` is a set of terms outside which no list is made; lengths count all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if keep is None else keep.value
        ids, sizes, lists, words, size = [], [], [], {}, 0
        for piece in pieces(batches):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts_of(piece), strict=True):
                found = letter_words(text)
                if not found:
                    continue
                if ids and size + len(text) > segment_bytes:
                    yield _segment(ids, sizes, words, lists)
                    ids, sizes, lists, words, size = [], [], [], {}, 0
                counts = Counter(found)
                own = counts.keys() if wanted is None else counts.keys() & wanted
                ids.append(doc_id)
                sizes.append(len(found))
                lists.append(([words.setdefault(w, len(words)) for w in own], [counts[w] for w in own]))
                size += len(text)
        if ids:
            yield _segment(ids, sizes, words, lists)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return durable(rows.mapInArrow(run, INDEX_SCHEMA), "index")


def query_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, n)``: terms of each item with their occurrences."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches):
        for piece in pieces(batches):
            at, terms, times = [], [], []
            for i, text in enumerate(texts_of(piece)):
                counts = Counter(letter_words(text))
                at += [i] * len(counts)
                terms += counts.keys()
                times += counts.values()
            yield pa.RecordBatch.from_arrays(
                [piece.column("item_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())],
                names=["item_id", "term", "n"])

    once = items.select("item_id", "text").filter("item_id IS NOT NULL").distinct()
    found = once.mapInArrow(run, f"item_id {kind}, term binary, n bigint")
    return durable(found.groupBy("item_id", "term").agg(F.sum("n").alias("n")), "asked")


# ---------------------------------------------------------------- search in a segment


class Best:
    """The k best documents of a query so far; equal scores by smaller id, a null id last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def cutoff(self) -> int:
        """No document below this score can come in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.append(self.score, score), np.append(self.id, ids), np.append(self.null, null)
        at = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[at], ids[at], null[at]


class Lists:
    """The asked terms' lists of a segment with the impact of every entry, cut at ranges of documents."""

    def __init__(self, segment: dict, terms: dict[bytes, int], n_docs: int, n_terms: int):
        size = np.asarray(segment["sizes"].values).astype(np.int64)
        ids = segment["ids"].values
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.count = len(size)
        norm = 75 + (25 * size * n_docs) // n_terms
        dfs = np.asarray(segment["dfs"].values).astype(np.int64)
        self.where = np.full(len(terms), -1)
        mine = [(i, terms[t]) for i, t in enumerate(segment["terms"].values.to_pylist()) if t in terms]
        begin = np.cumsum(dfs) - dfs
        at = np.concatenate([np.arange(begin[i], begin[i] + dfs[i]) for i, _ in mine] + [np.zeros(0, np.int64)])
        self.where[[t for _, t in mine]] = np.arange(len(mine))
        self.length = dfs[[i for i, _ in mine]]
        self.start = np.cumsum(self.length) - self.length
        self.docs = np.asarray(segment["docs"].values)[at].astype(np.int64)
        tf = np.asarray(segment["tfs"].values)[at].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * norm[self.docs])
        # cuts[i, r]: where list i enters range r; highest[i, r]: its largest impact there
        self.ranges = -(-self.count // RANGE)
        owner = np.repeat(np.arange(len(mine)), self.length)
        cell = owner * self.ranges + self.docs // RANGE
        per = np.bincount(cell, minlength=len(mine) * self.ranges).reshape(len(mine), self.ranges)
        self.cuts = self.start[:, None] + np.concatenate([np.zeros((len(mine), 1), np.int64), np.cumsum(per, axis=1)], axis=1)
        self.highest = np.zeros(len(mine) * self.ranges, np.int64)
        if len(cell):
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            self.highest[cell[first]] = np.maximum.reduceat(self.impact, first)
        self.highest = self.highest.reshape(len(mine), self.ranges)


def search_lists(lists: Lists, asked: np.ndarray, weight: np.ndarray, best: Best, buffer: np.ndarray) -> None:
    """Add the segment's documents to the best ones of a query with these terms and weights.

    ``buffer`` is zero for every document of the segment, and is left so.
    """
    own = lists.where[asked]
    use = (own >= 0) & (weight > 0)
    own, weight = own[use], weight[use]
    if not len(own):
        return
    short = lists.length[own] * SHORT <= lists.count
    # term at a time: sums of the short lists
    touched = [np.zeros(0, np.int64)]
    for i, w in zip(own[short].tolist(), weight[short].tolist()):
        part = slice(lists.start[i], lists.start[i] + lists.length[i])
        buffer[lists.docs[part]] += w * lists.impact[part]
        touched.append(lists.docs[part])
    acc_docs = np.unique(np.concatenate(touched))
    acc = buffer[acc_docs]
    buffer[acc_docs] = 0
    cutoff = best.cutoff
    if len(acc) + len(best.score) >= best.k:
        # so many documents have at least these scores already
        known = np.concatenate([acc, best.score])
        cutoff = max(cutoff, int(np.partition(known, len(known) - best.k)[len(known) - best.k]))
    acc_cuts = np.searchsorted(acc_docs, np.arange(lists.ranges + 1) * RANGE)
    long, weight = own[~short], weight[~short]
    # document at a time: the accumulators are one list among the long ones
    bounds = weight[:, None] * lists.highest[long]
    acc_bound = np.zeros(lists.ranges, np.int64)
    some = np.flatnonzero(np.diff(acc_cuts))
    if len(some):
        acc_bound[some] = np.maximum.reduceat(acc, acc_cuts[some])
    bounds = np.concatenate([bounds, acc_bound[None]])
    reach = bounds.sum(axis=0)
    last = len(long)
    for r in np.flatnonzero(reach >= max(1, cutoff)).tolist():
        if reach[r] < cutoff:
            continue
        bound = bounds[:, r]
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        skipped = int(np.searchsorted(below, cutoff, "left"))  # lists that cannot reach the cutoff together
        seen = [np.zeros(0, np.int64)]
        for i in order[skipped:].tolist():
            if i == last:
                docs, value = acc_docs[acc_cuts[r] : acc_cuts[r + 1]], acc[acc_cuts[r] : acc_cuts[r + 1]]
            else:
                part = slice(lists.cuts[long[i], r], lists.cuts[long[i], r + 1])
                docs, value = lists.docs[part], weight[i] * lists.impact[part]
            buffer[docs] += value
            seen.append(docs)
        found = np.unique(np.concatenate(seen))
        score = buffer[found]
        buffer[found] = 0
        for j in range(skipped - 1, -1, -1):
            alive = score + below[j] >= cutoff
            found, score = found[alive], score[alive]
            if not len(found):
                break
            i = int(order[j])
            if i == last:
                docs, value, times = acc_docs[acc_cuts[r] : acc_cuts[r + 1]], acc[acc_cuts[r] : acc_cuts[r + 1]], 1
            else:
                part = slice(lists.cuts[long[i], r], lists.cuts[long[i], r + 1])
                docs, value, times = lists.docs[part], lists.impact[part], weight[i]
            if len(docs):
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                score = score + np.where(docs[at] == found, value[at] * times, 0)
        alive = score >= max(1, cutoff)
        if alive.any():
            found = found[alive]
            best.add(score[alive], lists.ids[found], lists.null[found])
            cutoff = max(cutoff, best.cutoff)


# ---------------------------------------------------------------- search


def _search_block(index: DataFrame, asked: DataFrame, df: DataFrame, n_docs: int, n_terms: int, k: int) -> str:
    """Best documents of each task for the queries of one block, written; the path."""
    spark = index.sparkSession
    kind = dict(asked.dtypes)["item_id"]
    table = asked.join(df, "term").select("item_id", "term", "n", "df").toArrow().combine_chunks()
    items = table["item_id"].combine_chunks().dictionary_encode() if table.num_rows else None
    terms: dict[bytes, int] = {}
    number = np.array([terms.setdefault(t, len(terms)) for t in table["term"].to_pylist()], np.int64)
    frequency = np.asarray(table["df"]).astype(np.float64)
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * frequency + 1))).astype(np.int64) * np.asarray(table["n"])
    order = np.argsort(np.asarray(items.indices), kind="stable") if items else np.zeros(0, np.int64)
    names = items.dictionary if items else pa.array([], pa.int64())
    ends = np.cumsum(np.bincount(np.asarray(items.indices), minlength=len(names))) if items else np.zeros(0, np.int64)
    shared = Shared(spark, (names, terms, number[order], weight[order], ends))

    def run(batches):
        names, terms, number, weight, ends = shared.value
        best = [Best(k) for _ in names]
        for batch in batches:
            for row in range(batch.num_rows):
                lists = Lists({c: batch.column(c)[row] for c in batch.schema.names}, terms, n_docs, n_terms)
                buffer = np.zeros(lists.count, np.int64)
                start = 0
                for q, end in enumerate(ends.tolist()):
                    search_lists(lists, number[start:end], weight[start:end], best[q], buffer)
                    start = end
        at = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(at):
            ids, null = np.concatenate([b.id for b in best]), np.concatenate([b.null for b in best])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(at)), pa.array(ids, mask=null), pa.array(np.concatenate([b.score for b in best]))],
                names=["item_id", "doc_id", "score"])

    path = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    index.mapInArrow(run, f"item_id {kind}, doc_id bigint, score bigint").write.parquet(path)
    shared.release()
    return path


def search(index: DataFrame, asked: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of a written index for each query of
    ``asked (item_id, term, n)``, see ``top_documents``. Queries go in blocks of about ``block_rows``
    rows; a block's results are written and its copy in the tasks released before the next one starts."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
    df = index.select(F.inline(F.arrays_zip("terms", "dfs"))).groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    df = durable(df.join(asked.select("term").distinct(), "term", "left_semi"), "df")
    blocks = max(1, -(-asked.count() // block_rows))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    paths = [_search_block(index, asked.filter(block == b), df, int(n_docs or 0), int(n_terms or 0), k) for b in range(blocks)]
    found = spark.read.schema(f"item_id {dict(asked.dtypes)['item_id']}, doc_id bigint, score bigint").parquet(*paths)
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))
        return rows.withColumn("rank", place).filter(F.col("rank") <= k)

    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE)))
    return best(best(dealt, ["item_id", "part"]), ["item_id"]).select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, segment_bytes: int = SEGMENT_BYTES,
                  block_rows: int = BLOCK_ROWS, term_bytes: int = TERM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k best documents with a score above 0.

    The score of a document adds up, over the item's terms with repeats, a weight that falls with the
    number of documents holding the term, times an impact that grows with its occurrences and falls with
    the document's length, in integers. Equal scores go by smaller doc_id, a null one last. Null and empty
    texts hold no term. Rows with the same doc_id are documents of their own. Rows of ``items`` that are
    wholly alike count once; different texts of one item_id are one query with the terms of all; a null
    item_id is no query. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    asked = query_terms(items)
    distinct = asked.select("term").distinct()
    size = int(distinct.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0)
    keep = None
    if size <= term_bytes:
        keep = Shared(spark, frozenset(distinct.toArrow()["term"].to_pylist()))
    return search(build_index(docs, keep, segment_bytes), asked, k, block_rows)
