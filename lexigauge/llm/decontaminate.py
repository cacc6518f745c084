"""Benchmark passages in documents, by suffix arrays of the documents.

The documents are cut into shards, slices of bounded size of their partitions. A shard's words
become numbers and its suffixes are sorted; every benchmark suffix is looked up in that order by
binary search, which gives its longest verbatim match and all places of its first words.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.llm.common import Shared, letter_words, map_pieces, text_bytes, texts_of
from lexigauge.operators.tables import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
# Benchmark text that is broadcast at once; a larger benchmark is looked up block after block.
BLOCK_BYTES = 4 << 20

DIGEST = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
)
MATCHES = "item_id string, item_word bigint, n_words bigint, doc_id bigint, doc_word bigint"


@dataclass
class Block:
    """Benchmark items as word numbers, 0 after each item."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    item_of: np.ndarray  # of each word, -1 for a separator
    left: np.ndarray  # words from here to the item's end
    start_of: np.ndarray  # first word of the item
    names: list[str]
    windows: np.ndarray  # first word of every distinct window
    lengths: np.ndarray  # its words
    holders: list[list[int]]  # the items that have it
    longest: int


def build_block(items: list[tuple[str, list[bytes]]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    words, item_of, left, start_of, names = [], [], [], [], []
    seen: dict[tuple, int] = {}
    windows, lengths, holders = [], [], []
    for name, found in items:
        if not found:
            continue
        number, begin = len(names), len(words)
        names.append(name)
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        size = min(window, len(ids))
        for k in range(len(ids) - size + 1):
            u = seen.setdefault(tuple(ids[k : k + size]), len(windows))
            if u == len(windows):
                windows.append(begin + k)
                lengths.append(size)
                holders.append([])
            if not holders[u] or holders[u][-1] != number:
                holders[u].append(number)
        words += [*ids, 0]
        item_of += [*[number] * len(ids), -1]
        left += [*range(len(ids), 0, -1), 0]
        start_of += [begin] * (len(ids) + 1)
    as_array = lambda x: np.array(x, np.int64)
    longest = max((len(f) for _, f in items), default=0)
    return Block(vocabulary, as_array(words), as_array(item_of), as_array(left), as_array(start_of), names,
                 as_array(windows), as_array(lengths), holders, longest)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words, by prefix doubling."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_keys = words[order]
    k = 1
    while n:
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])))
        if k >= depth or rank[order[-1]] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        k *= 2
    return order


def compare(shard, at, test, start, limit):
    """Sign of shard suffix against benchmark suffix over ``limit`` words, and the words they share."""
    sign, shared = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    live, d = np.arange(len(at)), 0
    while True:
        live = live[limit[live] > d]
        if not live.size:
            return sign, shared
        a, b = shard[at[live] + d], test[start[live] + d]
        sign[live] = np.sign(a - b)
        live = live[a == b]
        d += 1
        shared[live] = d


def search(shard, order, test, start, limit, after: bool) -> np.ndarray:
    """For each benchmark suffix its place in the suffix array: before or after its equals."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        sign, _ = compare(shard, order[mid], test, start[open_], limit[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


@dataclass
class Shard:
    """Words of some documents and the suffixes that a benchmark window can match at all."""

    sizes: np.ndarray  # words of each document
    doc_of: np.ndarray  # document of each word or separator
    first: np.ndarray  # place of each document's first word
    kept: np.ndarray  # numbers of the kept words, 0 between runs
    place: np.ndarray  # where they stand among all words
    order: np.ndarray


def build_shard(texts: list[bytes | None], block: Block) -> Shard:
    """Only runs of benchmark words that are as long as the shortest window are sorted: no suffix
    outside of them can hold a window."""
    lists = [letter_words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    get = block.vocabulary.get
    flat = np.zeros(int(sizes.sum()) + len(lists), np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1].astype(np.int64)
    for begin, found in zip(first, lists, strict=True):
        flat[begin : begin + len(found)] = [get(w, 0) for w in found]
    doc_of = np.repeat(np.arange(len(lists)), sizes + 1)
    known = np.concatenate(([0], (flat > 0).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(known))
    starts, ends = edge[::2], edge[1::2]
    least = int(block.lengths.min()) if len(block.lengths) else 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    runs = ends - starts + 1  # with the separator behind
    place = np.repeat(starts - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(int(runs.sum())) if len(runs) else np.zeros(0, np.int64)
    kept = flat[place] if len(place) else np.zeros(0, np.int64)
    order = suffix_array(kept, block.longest)
    return Shard(sizes, doc_of, first, np.concatenate((kept, np.zeros(block.longest + 1, np.int64))), place, order)


def window_places(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Every place (first word among all words of the shard) of every distinct window."""
    start, limit = block.windows, block.lengths
    low = search(shard.kept, shard.order, block.words, start, limit, after=False)
    high = search(shard.kept, shard.order, block.words, start, limit, after=True)
    count = high - low
    which = np.repeat(np.arange(len(start)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return shard.place[shard.order[np.repeat(low, count) + step]], which


def longest_in_shard(shard: Shard, block: Block):
    """Longest match of every benchmark suffix in the shard: words, and the place of one."""
    start = np.flatnonzero(block.item_of >= 0)
    limit = block.left[start]
    best, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    if len(shard.order):
        at = search(shard.kept, shard.order, block.words, start, limit, after=False)
        for near in (at - 1, at):
            inside = np.flatnonzero((near >= 0) & (near < len(shard.order)))
            suffix = shard.order[near[inside]]
            _, shared = compare(shard.kept, suffix, block.words, start[inside], limit[inside])
            better = shared > best[inside]
            best[inside[better]] = shared[better]
            place[inside[better]] = shard.place[suffix[better]]
    return start, best, place


def look_up(texts: list[bytes | None], block: Block):
    """Words, hit marks of each document's words, and items of each document."""
    shard = build_shard(texts, block)
    marks = np.zeros(len(shard.doc_of) + 1, np.int64)
    place, which = window_places(shard, block)
    np.add.at(marks, place, 1)
    np.add.at(marks, place + block.lengths[which], -1)
    hit = np.cumsum(marks[:-1]) > 0
    items: list[set[str]] = [set() for _ in texts]
    pairs = np.unique(shard.doc_of[place] * (len(block.windows) + 1) + which) if len(place) else np.zeros(0, np.int64)
    for pair in pairs.tolist():
        doc, u = divmod(pair, len(block.windows) + 1)
        items[doc].update(block.names[i] for i in block.holders[u])
    return shard, hit, items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Distinct (item, text) rows in blocks of about ``block_bytes``, dealt by a hash; each is
    collected on its own, so the driver never holds more than a block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna().distinct()
    n = max(1, -(-text_bytes(items) // block_bytes))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], letter_words(r[1].encode())) for r in part.toLocalIterator()]


def _carry(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int):
    """All blocks but the last leave their hits and items in two more columns; returns the last
    block and the names of those columns."""
    blocks = benchmark_blocks(benchmark, block_bytes)
    block, hits, found = build_block(next(blocks), window), "__hits__", "__items__"
    spark = docs.sparkSession
    if any(c in docs.columns for c in (hits, found)):
        raise ValueError(f"columns {hits} and {found} are taken")
    carried = False
    for rows in blocks:
        schema = docs.schema if carried else T.StructType([*docs.schema, T.StructField(hits, T.BinaryType()), T.StructField(found, T.ArrayType(T.StringType()))])
        docs = durable(map_pieces(docs, _adder(Shared(spark, block), hits, found), schema), "hits")
        block, carried = build_block(rows, window), True
    return docs, Shared(spark, block), hits, found


def _adder(block, hits: str, found: str):
    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        _, packed, items = merged(piece, block.value, hits, found)
        table = pa.Table.from_batches([piece]).select([c for c in piece.schema.names if c not in (hits, found)])
        table = table.append_column(hits, pa.array([np.packbits(p).tobytes() for p in packed], pa.binary()))
        return table.append_column(found, pa.array(items, pa.list_(pa.string()))).combine_chunks().to_batches()[0]

    return f


def merged(piece: pa.RecordBatch, block: Block, hits: str, found: str):
    """Words, hit marks and sorted items of each row, with those of earlier blocks."""
    shard, hit, items = look_up(texts_of(piece), block)
    marks = [hit[a : a + n] for a, n in zip(shard.first, shard.sizes, strict=True)]
    if hits in piece.schema.names:
        for k, (bits, names) in enumerate(zip(piece.column(hits).to_pylist(), piece.column(found).to_pylist(), strict=True)):
            marks[k] = marks[k] | np.unpackbits(np.frombuffer(bits, np.uint8), count=len(marks[k])).astype(bool)
            items[k].update(names)
    return shard.sizes, marks, [sorted(x) for x in items]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words inside a benchmark window, items with such windows.

    A null or empty text has no words and is clean; an item that is null, empty or without id takes
    no part; repeated rows each get their row; other columns are not looked at. An item of fewer
    words than ``window`` is one window. A benchmark above ``block_bytes`` is broadcast in blocks, each
    a pass over the documents. The digest of no items is that of an empty string.
    """
    docs, block, hits, found = _carry(docs.select("doc_id", "text"), benchmark, window, block_bytes)

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        sizes, marks, items = merged(piece, block.value, hits, found)
        n_hit = [int(m.sum()) for m in marks]
        return pa.RecordBatch.from_arrays([
            piece.column("doc_id").cast(pa.int64()),
            pa.array(sizes),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
            pa.array([n > 0 for n in n_hit]),
        ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_pieces(docs, f, DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    columns = docs.columns
    docs, block, hits, found = _carry(docs, benchmark, window, block_bytes)

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        _, marks, _ = merged(piece, block.value, hits, found)
        return piece.filter(pa.array([not m.any() for m in marks], pa.bool_()))

    return map_pieces(docs, f, docs.schema).select(*[f"`{c}`" for c in columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every word of every item the longest run from there that stands in a document, with the
    smallest such place; runs shorter than ``least`` words, or than the item if it is shorter, are left out."""
    spark, out = docs.sparkSession, None
    for rows in benchmark_blocks(benchmark, block_bytes):
        block = Shared(spark, build_block(rows, least))

        def f(piece: pa.RecordBatch, block=block) -> pa.RecordBatch:
            b = block.value
            shard = build_shard(texts_of(piece), b)
            start, best, place = longest_in_shard(shard, b)
            item_words = b.left[b.start_of[start]]
            good = best >= np.minimum(least, item_words)
            start, best, place = start[good], best[good], place[good]
            doc = shard.doc_of[place] if len(place) else place
            ids = np.array(piece.column("doc_id").cast(pa.int64()).to_pylist(), object)
            return pa.RecordBatch.from_arrays([
                pa.array([b.names[i] for i in b.item_of[start]], pa.string()),
                pa.array(start - b.start_of[start], pa.int64()),
                pa.array(best, pa.int64()),
                pa.array(ids[doc].tolist(), pa.int64()),
                pa.array(place - shard.first[doc] if len(place) else place, pa.int64()),
            ], names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        found = map_pieces(docs.select("doc_id", "text"), f, MATCHES)
        out = found if out is None else out.unionAll(found)
    at = F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")
    best = out.groupBy("item_id", "item_word").agg(F.min(at).alias("at"))
    return best.select("item_id", "item_word", (-F.col("at.n")).alias("n_words"), "at.doc_id", "at.doc_word")
