"""Exact top-k inner products by a three-phase uniform threshold.

The components of all vectors are cut into blocks, each a column of a written table; a block's tasks
read that column alone and know partial scores only. Phase 1: every block lists its highest partial
scores of each query; the listed vectors' scores are resolved, and the k-th best of them is a cutoff
that the true k-th score cannot fall below. Phase 2: the cutoffs are broadcast; a vector that reaches
the cutoff reaches its uniform share, cutoff / blocks, in some block, and what a block lacks of the
cutoff when all others give their highest, so a block sends only entries that reach both. Phase 3:
what was sent meets its vector, the partial scores that were not sent are looked up for the queries
that named it, and for no others, and scores of the cutoff or more go on to the ranking.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared
from lexigauge.operators.tables import durable, release, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Two: each further block lowers the uniform share and so sends many more entries.
BLOCKS = 2
# Bytes of query vectors broadcast at once; more queries go in further passes.
QUERY_BYTES = 8 << 20
# Partial scores held at once by a task.
CELLS = 2 << 20
# Phase 1 lists so many times k entries of a block: the longer the lists, the higher the cutoff.
DEPTH = 10
ENTRIES = "query_id bigint, key bigint, block int, part bigint"
PACKED = "key bigint, block int, query_ids array<bigint>, parts array<bigint>"
TOTALS = "query_id bigint, key bigint, score bigint, looked_up int"
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, components as floor(scale * x)."""
    x = F.col("embedding")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select("vec_id", whole.alias("v"))


def check_range(whole: DataFrame) -> None:
    """Raise if a score could leave 64 bits."""
    size = F.aggregate("v", F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e.cast("double"))))
    most, dim = whole.agg(F.max(size), F.max(F.size("v"))).first()
    if most and most * most * dim >= 2.0**62:
        raise ValueError(f"components up to {most:g} times the scale: scores of {dim} of them do not fit 64 bits")


def _edges(dim: int, blocks: int) -> list[int]:
    return [b * dim // blocks for b in range(blocks + 1)]


def distinct_vectors(whole: DataFrame, k: int, blocks: int) -> DataFrame:
    """``(key, dim, owners, b0, b1, ...)``: each different vector once, its components cut into block columns.

    ``owners`` holds the k + 1 smallest ids with that vector and how often each has it, k at most: of copies,
    however many, no query can list more. The window keeps k + 1 rows a vector ahead of its shuffle.
    """
    counted = whole.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = counted.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    owned = kept.groupBy("v").agg(F.collect_list(F.struct("vec_id", "times")).alias("owners"))
    dim = F.size("v")
    cut = []
    for b in range(blocks):
        start, end = F.expr(f"({b} * size(v)) div {blocks}"), F.expr(f"({b + 1} * size(v)) div {blocks}")
        cut.append(F.slice("v", (start + 1).cast("int"), (end - start).cast("int")).alias(f"b{b}"))
    return owned.select(F.monotonically_increasing_id().alias("key"), dim.alias("dim"), "owners", *cut)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows; in doubles where those are exact."""
    most = np.abs(queries).max(initial=0).astype(float) * np.abs(vectors).max(initial=0).astype(float)
    kind = np.float64 if most * max(1, queries.shape[1]) < 2**52 else np.int64
    return (queries.astype(kind) @ vectors.astype(kind).T).astype(np.int64)


def _chunks(batches, block: int, blocks: int, groups: dict) -> Iterator[tuple]:
    """``(dim, keys, partial scores of all queries of that length)`` of bounded size."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim, (query_ids, queries) in groups.items():
            a, b = _edges(dim, blocks)[block : block + 2]
            rows, step = np.flatnonzero(dims == dim), max(1, CELLS // max(1, len(query_ids)))
            for start in range(0, len(rows), step):
                part = batch.take(pa.array(rows[start : start + step]))
                vectors = np.asarray(part.column("part").flatten()).reshape(part.num_rows, b - a)
                yield dim, np.asarray(part.column("key")), products(queries[:, a:b], vectors)


def _entries(query_ids, keys, block: int, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids), pa.array(keys), pa.array(np.full(len(keys), block, np.int32)), pa.array(parts)],
        names=["query_id", "key", "block", "part"])


def _column(table: DataFrame, block: int) -> DataFrame:
    return table.select("key", "dim", F.col(f"b{block}").alias("part"))


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def local_lists(table: DataFrame, queries: Shared, length: int, blocks: int) -> DataFrame:
    """Phase 1: the ``length`` highest partial scores of every query and block, as ENTRIES."""

    def of(block):
        def run(batches):
            groups, best = queries.value, {}
            for dim, keys, p in _chunks(batches, block, blocks, groups):
                keys = np.broadcast_to(keys, p.shape)
                if dim in best:
                    keys, p = np.hstack((best[dim][0], keys)), np.hstack((best[dim][1], p))
                if p.shape[1] > length:
                    top = np.argpartition(p, p.shape[1] - length, axis=1)[:, -length:]
                    keys, p = np.take_along_axis(keys, top, 1), np.take_along_axis(p, top, 1)
                best[dim] = keys, p
            for dim, (keys, p) in best.items():
                yield _entries(np.repeat(groups[dim][0], p.shape[1]), keys.ravel(), block, p.ravel())

        return run

    found = _together([_column(table, b).mapInArrow(of(b), ENTRIES) for b in range(blocks)])
    order = Window.partitionBy("query_id", "block").orderBy(F.desc("part"), "key")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= length).drop("place")


def packed(entries: DataFrame) -> DataFrame:
    """ENTRIES as PACKED: one row a vector and block, with at most the queries of one broadcast block."""
    pairs = entries.groupBy("key", "block").agg(F.collect_list(F.struct("query_id", "part")).alias("e"))
    return pairs.select("key", "block", F.col("e.query_id").alias("query_ids"), F.col("e.part").alias("parts"))


def sufficient_entries(table: DataFrame, queries: Shared, needs: Shared, blocks: int) -> DataFrame:
    """Phase 2: the entries whose partial score is ``needs`` of its query and block or more, as PACKED."""

    def of(block):
        def run(batches):
            groups = queries.value
            for dim, keys, p in _chunks(batches, block, blocks, groups):
                c, q = np.nonzero((p >= needs.value[dim][:, block][:, None]).T)
                own, start = np.unique(c, return_index=True)
                edges = pa.array(np.append(start, len(c)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (groups[dim][0][q], p[q, c])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[own]), pa.array(np.full(len(own), block, np.int32)), *lists],
                    names=["key", "block", "query_ids", "parts"])

        return run

    return _together([_column(table, b).mapInArrow(of(b), PACKED) for b in range(blocks)])


def resolve(table: DataFrame, queries: Shared, sent: DataFrame, blocks: int, needs: Shared | None = None) -> DataFrame:
    """Phase 3: ``(query_id, key, score, looked_up)`` of every query and vector of ``sent``, or of those with
    the cutoff of ``needs``. Partial scores that were sent are taken as they are; ``looked_up`` counts the others."""
    columns = [f"b{b}" for b in range(blocks)]
    # one entry a block in a list
    met = sent.groupBy("key").agg(F.collect_list(F.struct("block", "query_ids", "parts")).alias("sent"))
    met = met.join(table.select("key", "dim", *columns), "key")

    def run(batches):
        groups = {d: (np.argsort(i), np.sort(i), q) for d, (i, q) in queries.value.items()}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                order, ids, vectors = groups[dim]
                same = batch.take(pa.array(np.flatnonzero(dims == dim)))
                lists = same.column("sent")
                row = np.repeat(np.arange(same.num_rows), np.diff(np.asarray(lists.offsets)))
                block, asked, parts = lists.flatten().flatten()
                times = np.diff(np.asarray(asked.offsets))
                row, block = np.repeat(row, times), np.repeat(np.asarray(block), times)
                q = np.searchsorted(ids, np.asarray(asked.flatten()))
                pairs, at = np.unique(row * np.int64(len(ids)) + q, return_inverse=True)
                known = np.zeros((blocks, len(pairs)), bool)
                score = np.zeros((blocks, len(pairs)), np.int64)
                known[block, at], score[block, at] = True, np.asarray(parts.flatten())
                row, q = pairs // len(ids), pairs % len(ids)
                edges = _edges(dim, blocks)
                for b, (first, end) in enumerate(zip(edges, edges[1:], strict=False)):
                    own = np.asarray(same.column(f"b{b}").flatten(), np.int64).reshape(same.num_rows, end - first)
                    lacking, step = np.flatnonzero(~known[b]), max(1, CELLS // max(1, end - first))
                    for start in range(0, len(lacking), step):
                        i = lacking[start : start + step]
                        score[b, i] = (vectors[order[q[i]], first:end] * own[row[i]]).sum(axis=1)
                total, looked = score.sum(axis=0), (~known).sum(axis=0).astype(np.int32)
                keep = np.full(len(pairs), True) if needs is None else total >= needs.value[dim][order[q], blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q][keep]), pa.array(np.asarray(same.column("key"))[row[keep]]), pa.array(total[keep]), pa.array(looked[keep])],
                    names=["query_id", "key", "score", "looked_up"])

    return met.mapInArrow(run, TOTALS)


def ranked(table: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best, every vector under each of its ids."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    near = totals.withColumn("place", F.rank().over(best)).filter(F.col("place") <= k + 1).drop("place")
    rows = near.join(table.select("key", "owners"), "key").select("query_id", "score", F.explode("owners").alias("o"))
    rows = rows.filter(F.col("o.vec_id") != F.col("query_id"))
    rows = rows.select("query_id", "score", F.explode(F.array_repeat("o.vec_id", F.col("o.times"))).alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    places = rows.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return places.select("query_id", "rank", "vec_id", "score")


def block_needs(groups: dict, heads: DataFrame, first: DataFrame, k: int, blocks: int) -> dict:
    """What an entry must reach, by length as an array of queries × (blocks + 1): the uniform share of the cutoff
    and the cutoff less the highest partial scores of the other blocks; last the cutoff itself. A few numbers a query."""
    cut = {r[0]: r[1] for r in first.filter(F.col("rank") == k).select("query_id", "score").collect()}
    top: dict = {}
    for query_id, block, part in heads.groupBy("query_id", "block").agg(F.max("part")).collect():
        top.setdefault(query_id, [0] * blocks)[block] = part
    lowest = -(2**62)  # fewer candidates than k: everything is sent
    needs = {}
    for dim, (ids, _) in groups.items():
        needs[dim] = np.full((len(ids), blocks + 1), lowest, np.int64)
        for i, query_id in enumerate(ids.tolist()):
            if query_id in cut:
                high = top[query_id]
                share = -(-cut[query_id] // blocks)
                needs[dim][i] = [*(max(share, cut[query_id] - (sum(high) - h)) for h in high), cut[query_id]]
    return needs


def query_blocks(queries: DataFrame, query_bytes: int):
    """Queries, one for each id, in blocks of about ``query_bytes``, as {length: (ids, vectors)}."""
    queries = durable(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "top_k_queries")
    total = int(queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0)
    n = max(1, -(-total // query_bytes))
    for b in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) == b).collect()
        groups: dict[int, tuple[list, list]] = {}
        for vec_id, v in rows:
            ids, vs = groups.setdefault(len(v), ([], []))
            ids.append(vec_id)
            vs.append(v)
        if groups:
            yield {d: (np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), d)) for d, (i, v) in groups.items()}
    release(queries)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, blocks: int = BLOCKS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for every row whose id ``every`` divides.

    Null, partly null and non-finite vectors and null ids take no part. A query meets vectors of its
    own length only. Rows that share the query's id are its own; a repeated candidate row is
    listed as often as it occurs; rows with the same query id query once, by the smallest vector.
    Fewer rows than k: all. Empty table, or no query: no rows. Components so large that a score could
    leave 64 bits are an error.

    Each block of queries is finished and written before the next starts.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, scale)
    check_range(whole)
    table = durable(distinct_vectors(whole, k, blocks), "top_k_vectors")
    out = f"{shared_folder(spark)}/top_k-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(out)
    for groups in query_blocks(whole.filter(F.pmod("vec_id", F.lit(every)) == 0), query_bytes):
        queries = Shared(spark, groups)
        heads = durable(local_lists(table, queries, DEPTH * k + 1, blocks), "top_k_lists")
        first = ranked(table, resolve(table, queries, packed(heads), blocks), k)
        needs = Shared(spark, block_needs(groups, heads, first, k, blocks))
        sent = sufficient_entries(table, queries, needs, blocks)
        ranked(table, resolve(table, queries, sent, blocks, needs), k).write.mode("append").parquet(out)
        release(heads)
        for shared in (queries, needs):
            shared.release()
    release(table)
    return spark.read.schema(RESULT).parquet(out)
