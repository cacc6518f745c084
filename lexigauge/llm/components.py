"""Connected components of links between documents, as DataFrame joins that halve distances."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.tables import durable, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 60
# Links that a task contracts at once.
STRETCH = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, sorted, and for each the smallest node that those links reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        p, q = top[x], top[y]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[top]
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := top[top], top):
            top = up


def contract(batches):
    """The links ``u, v`` of a stretch as fewer ones with the same components: each node to the smallest."""

    def few(held: list[tuple]) -> pa.RecordBatch:
        nodes, top = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        own = nodes != top
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(top[own])], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
        size += batch.num_rows
        if size >= STRETCH:
            yield few(held)
            size = 0
    if held:
        yield few(held)


def unsettled(edges: DataFrame) -> int:
    """Nodes that are linked to several smaller ones, or to a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("top"), F.lit(False).alias("above"))
    ends = ends.unionAll(edges.select("v", F.lit(None).cast("bigint"), F.lit(True)))
    found = ends.groupBy("node").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.max("above").alias("above"))
    return found.filter("low < high OR above AND low IS NOT NULL").count()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links (a, b)``, component the smallest node reachable.

    Each round, tasks contract the links that they read; then a node's smaller neighbours, and itself, go to
    the smallest of them, and from there to the smallest neighbour of that one, until every node but the
    smallest has one link, to the smallest. After the contraction a node has at most one link from a stretch
    to a smaller node, so one with very many links is no burden to the first step.
    """
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for _ in range(ROUNDS):
        least = edges.mapInArrow(contract, "u bigint, v bigint").groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("all"))
        others = F.filter("all", lambda v: v != F.col("m"))
        linked = least.select(F.explode(F.concat(F.array("u"), others)).alias("u"), "m")
        higher = least.select(F.col("u").alias("m"), F.col("m").alias("top"))
        linked = linked.join(higher, "m", "left").select("u", F.coalesce("top", "m").alias("v"))
        last, edges = edges, durable(linked, "edges")
        release(last)
        if not unsettled(edges):
            break
    else:
        raise RuntimeError(f"links are not settled after {ROUNDS} rounds")
    ends = F.explode(F.array(F.col("u"), F.col("v")))
    return edges.select(ends.alias("node"), F.col("v").alias("component")).distinct()
