"""Documents linked by the Jaccard similarity of their word n-grams, by a prefix-tree join.

An n-gram is a 64-bit number; all sets stand in one global order in which frequent n-grams come last.
Two similar sets share several of their first n-grams, so only documents that share so many with
another of a fitting size go on, and they go in groups that no fitting pair leaves. Within a group the
sets are stored in a prefix tree; a set walks down it, carrying the overlap of the path so far, and
leaves a branch when the n-grams that remain on both sides cannot make the similarity.

Links within a component that is already known are not looked for: the result is the components,
which need one path between two documents, not every pair.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared, map_pieces, pieces, space_words, texts_of
from lexigauge.llm.components import components, roots
from lexigauge.operators.tables import durable, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
PERCENT = 75
# n-grams that the order puts last, at most; any list gives the same links, a good one less work.
HOT_LIMIT = 1 << 20
# Stretch of n-grams in which one of several documents is noticed.
COUNT_GRAMS = 4 << 20
# n-grams of one bucket, and of one block of a group.
BUCKET_GRAMS = 1 << 22
BLOCK_GRAMS = 1 << 21
# Pairs of documents are counted under an n-gram that no more than so many share; more are chained.
FEW = 8
# Candidate groups above this go through a second look, in the exact order of frequency among them.
REFINE_GRAMS = 1 << 18
# Sets of a group that may be similar to one by their sizes alone, before its first n-grams are looked up.
PROBE = 64
# Buckets of a first look at which documents take part in any group.
SIEVE = 1 << 20

# What a batch of documents sends to a bucket: n-grams, how many are each document's, and whether
# they are early in it; those documents and the sizes of their sets.
SENT = ("bucket", "grams", "times", "early", "ids", "n")
_TOP = np.uint64(1 << 63)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_sets(texts: list[bytes | None], n: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct n-grams as sorted 63-bit numbers; a text of fewer words is one n-gram."""
    lists = [space_words(t) for t in texts]
    number = {w: xxhash.xxh64_intdigest(w) for w in {w for x in lists for w in x}}
    flat = np.fromiter((number[w] for x in lists for w in x), np.uint64, sum(map(len, lists)))
    out, begin = [], 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for k in range(n):
            rolled = (rolled + flat[k : k + len(rolled)]) * _MUL
        for words in lists:
            size = len(words)
            if size >= n:
                own = rolled[begin : begin + size - n + 1]
            elif size:
                own = np.full(1, size, np.uint64)
                for h in flat[begin : begin + size]:
                    own = (own + h) * _MUL
            else:
                own = rolled[:0]
            out.append(np.unique(_mix(own) & ~_TOP))
            begin += size
    return out


class HotOrder:
    """Marks the frequent n-grams by the top bit, which puts them last."""

    def __init__(self, hot: np.ndarray):
        self.hot = np.sort(hot)
        self.near = np.zeros(1 << 22, bool)
        self.near[(self.hot & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def order(self, grams: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.near[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe):
            return grams
        at = np.searchsorted(self.hot, grams[maybe])
        at[at == len(self.hot)] = 0
        found = maybe[self.hot[at] == grams[maybe]]
        if not len(found):
            return grams
        out = grams.copy()
        out[found] |= _TOP
        return np.sort(out)


def least_overlap(a: int, b: int) -> int:
    """Smallest common size of two sets of sizes a and b that makes the similarity."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shared_firsts(n):
    """A similar pair shares, among the first n-grams of both, at least the smaller of its two numbers."""
    return 1 + n // 20


def prefix_length(n):
    """First n-grams of a set that hold ``shared_firsts`` ones of every similar set: what the overlap
    cannot do without, and so many more."""
    return n - (PERCENT * n + 99) // 100 + shared_firsts(n)


def prefix_sql(n):
    """``prefix_length`` of a column."""
    return n - F.ceil(n * PERCENT / 100) + 1 + F.floor(n / 20)


def frequent_grams(docs: DataFrame, limit: int = HOT_LIMIT, n: int = WORDS) -> np.ndarray:
    """n-grams that several different texts of a stretch of COUNT_GRAMS share, the most frequent ones, at
    most ``limit``: what reaches the driver is bounded by that."""

    def often(grams: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(grams)
        grams.clear()
        every.sort()
        edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        times = np.diff(np.append(edge, len(every)))
        return pa.RecordBatch.from_arrays([pa.array(every[edge[times > 1]].astype(np.int64)), pa.array(times[times > 1])], names=["g", "n"])

    def count(batches):
        seen, grams, size = set(), [np.zeros(0, np.uint64)], 0
        for piece in pieces(batches):
            for g in gram_sets(texts_of(piece), n):
                key = (len(g), g[:4].tobytes(), g[-4:].tobytes())
                if key not in seen:  # copies within the stretch count once
                    seen.add(key)
                    grams.append(g)
                    size += len(g)
            if size >= COUNT_GRAMS:
                yield often(grams)
                seen, grams, size = set(), [np.zeros(0, np.uint64)], 0
        if size:
            yield often(grams)

    found = docs.select("text").mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    found = durable(found.withColumn("step", F.floor(F.log2("n") * 4).cast("int")), "frequent")
    room, least = limit, None
    for step, size in sorted(found.groupBy("step").count().collect(), reverse=True):
        if size > room:
            break
        room, least = room - size, step
    if least is None:
        return np.zeros(0, np.uint64)
    return np.asarray(found.filter(F.col("step") >= least).select("g").toArrow()["g"]).astype(np.uint64)


def signatures(docs: DataFrame, order: Shared, n: int = WORDS) -> DataFrame:
    """``(doc_id, n, sig_a, sig_b, prefix)``: size and fingerprint of each set, and its first n-grams."""

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets = gram_sets(texts_of(piece), n)
        with np.errstate(over="ignore"):
            a = [int(g.sum(dtype=np.uint64).astype(np.int64)) for g in sets]
            b = [int(np.bitwise_xor.reduce(_mix(g * _MUL)).astype(np.int64)) if len(g) else 0 for g in sets]
        prefix = [order.value.order(g)[: prefix_length(len(g))].tobytes() if len(g) else b"" for g in sets]
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array(a, pa.int64()),
             pa.array(b, pa.int64()), pa.array(prefix, pa.binary())],
            names=["doc_id", "n", "sig_a", "sig_b", "prefix"])

    return map_pieces(docs.select("doc_id", "text"), f, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, prefix binary")


def candidate_links(sets: DataFrame, buckets: int) -> DataFrame:
    """``(a, b)`` such that every pair that may be similar lies in one component of them.

    A similar pair shares at least ``shared_firsts`` prefix n-grams. Under an n-gram of at most FEW
    documents its pairs are counted; those that come to that number are links. The documents of a more
    frequent n-gram are chained in the order of their sizes, so a pair that shares such a one is in one
    component without being listed. Never all pairs of an n-gram.
    """

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            size = np.array([len(x) for x in lists])
            grams = np.concatenate([*lists, np.zeros(0, np.uint64)])
            row = np.repeat(np.arange(len(lists), dtype=np.int32), size)
            # may be the smaller set of a pair: early enough in its order
            n = np.asarray(batch.column("n"))[row]
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            early = place < n - (-(-2 * PERCENT * n // (100 + PERCENT))) + shared_firsts(n)
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[at])) + 1
            rows = {k: [] for k in SENT}
            ids, sizes = np.asarray(batch.column("doc_id")), np.asarray(batch.column("n"))
            for part in np.split(at, edges) if len(at) else []:
                own, times = np.unique(row[part], return_counts=True)  # the part is in the order of the rows
                rows["bucket"].append(int(bucket[part[0]]))
                rows["grams"].append(grams[part].tobytes())
                rows["times"].append(times.astype(np.int32).tobytes())
                rows["early"].append(np.packbits(early[part]).tobytes())
                rows["ids"].append(ids[own].tobytes())
                rows["n"].append(sizes[own].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], pa.int64() if k == "bucket" else pa.binary()) for k in SENT], names=list(SENT))

    def chain(parts: list[tuple]) -> pa.RecordBatch:
        grams = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
        early = np.concatenate([np.unpackbits(np.frombuffer(p[2], np.uint8), count=len(p[0]) // 8) for p in parts]).astype(bool)
        times = np.concatenate([np.frombuffer(p[1], np.int32) for p in parts])
        row = np.repeat(np.arange(len(times), dtype=np.int32), times)
        ids = np.concatenate([np.frombuffer(p[3], np.int64) for p in parts])
        n = np.concatenate([np.frombuffer(p[4], np.int32) for p in parts]).astype(np.int64)
        parts.clear()
        at = np.argsort(grams)
        g = grams[at]
        same = g[1:] == g[:-1]
        at = at[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        # only n-grams of several documents go on
        grams, early, ids, n = grams[at], early[at], ids[row[at]], n[row[at]]
        at = np.arange(len(at))
        at = at[np.lexsort((ids[at], ~early[at], n[at], grams[at]))]
        g, ids, n, early = grams[at], ids[at], n[at], early[at]
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(g)))
        few = np.repeat(size <= FEW, size)
        found = []
        for step in range(1, FEW):
            i = np.flatnonzero(few[:-step] & (g[step:] == g[:-step]))
            i = i[(100 * n[i] >= PERCENT * n[i + step]) & (ids[i] != ids[i + step])]
            found.append((ids[i], ids[i + step], np.ones(len(i), np.int64), shared_firsts(np.minimum(n[i], n[i + step]))))
        # link each document of the others to the last one before it that may be the smaller of a pair
        last = np.maximum.accumulate(np.where(early, np.arange(len(g)), -1)) if len(g) else np.zeros(0, np.int64)
        before = np.concatenate(([-1], last[:-1])) if len(g) else last
        i = np.flatnonzero((before >= 0) & ~few)
        i = i[(g[before[i]] == g[i]) & (100 * n[before[i]] >= PERCENT * n[i]) & (ids[before[i]] != ids[i])]
        found.append((ids[before[i]], ids[i], np.full(len(i), 1 << 32), np.ones(len(i), np.int64)))
        a, b, c, need = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs, which = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        count = np.bincount(which, weights=c, minlength=len(pairs)).astype(np.int64)
        least = np.full(len(pairs), np.iinfo(np.int64).max)
        np.minimum.at(least, which, need)
        # links that the bucket settles go on as one of each document to the smallest that it reaches by
        # them; pairs within what they reach are not needed
        sure = count >= least
        nodes, top = roots(pairs[sure, 0], pairs[sure, 1])
        reach = pairs[~sure].copy()
        if len(nodes):
            at = np.minimum(np.searchsorted(nodes, reach), len(nodes) - 1)
            reach = np.where(nodes[at] == reach, top[at], reach)
        apart = reach[:, 0] != reach[:, 1]
        own = nodes != top
        a, b = (np.concatenate((x[own], y[apart])) for x, y in ((top, pairs[~sure, 0]), (nodes, pairs[~sure, 1])))
        count = np.concatenate((np.full(own.sum(), 1 << 32), count[~sure][apart]))
        least = np.concatenate((np.ones(own.sum(), np.int64), least[~sure][apart]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(count), pa.array(least)], names=["a", "b", "c", "need"])

    def collect(batches):
        current, parts = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in SENT]
            for bucket, *rest in zip(*columns, strict=True):
                if bucket != current and parts:
                    yield chain(parts)
                    parts = []
                current = bucket
                parts.append(rest)
        if parts:
            yield chain(parts)

    dealt = sets.select("doc_id", "n", "prefix").mapInArrow(deal, ", ".join(f"{k} {'bigint' if k == 'bucket' else 'binary'}" for k in SENT))
    counted = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(collect, "a bigint, b bigint, c bigint, need bigint")
    counted = counted.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need"))
    return counted.filter("c >= need").select("a", "b")


class Node:
    """A stretch of n-grams that the sets ``low`` to ``high`` (in tree order) share after the path above."""

    __slots__ = ("grams", "low", "high", "smallest", "depth", "children", "child_low", "child_high")

    def __init__(self, grams, low, high, smallest, depth):
        self.grams, self.low, self.high, self.smallest, self.depth = grams, low, high, smallest, depth
        self.children: list[Node] = []


def build_tree(sets: list[np.ndarray]) -> Node:
    """Path-compressed prefix tree of sets that are sorted as sequences."""

    def make(low: int, high: int, depth: int) -> Node:
        first, last = sets[low], sets[high - 1]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        return Node(first[depth:end], low, high, min(len(s) for s in sets[low:high]), end)

    root = Node(np.zeros(0, np.uint64), 0, len(sets), 0, 0)
    stack = [root]
    while stack:
        node = stack.pop()
        k = node.low
        while k < node.high and len(sets[k]) == node.depth:
            k += 1  # sets that end here
        while k < node.high:
            token, begin = sets[k][node.depth], k
            while k < node.high and sets[k][node.depth] == token:
                k += 1
            node.children.append(make(begin, k, node.depth))
        node.child_low = np.array([c.low for c in node.children], np.int64)
        node.child_high = np.array([c.high for c in node.children], np.int64)
        stack += [c for c in node.children if c.high - c.low > 1 or c.depth < len(sets[c.low])]
        for c in node.children:
            if c.high - c.low == 1:
                c.child_low = c.child_high = np.zeros(0, np.int64)
    return root


def rare_first(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets in new numbers, those of n-grams that fewer of these sets hold first, and how many n-grams
    of each another one holds."""
    size = [len(s) for s in sets]
    known, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(known), np.uint64)
    number[np.argsort(held, kind="stable")] = np.arange(len(known), dtype=np.uint64)
    shared = np.bincount(np.repeat(np.arange(len(sets)), size), weights=held[at] > 1, minlength=len(sets))
    return [np.sort(x) for x in np.split(number[at], np.cumsum(size)[:-1])], shared.astype(np.int64)


def tree_links(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the similar sets of a group into their components, each set's to the smallest id; at
    most one less than there are sets.

    A set looks for the larger ones that are similar. Where more than PROBE may be, only those are walked to
    that share as many of the first n-grams as a similar one must, rare n-grams coming first. None is that has
    too few n-grams which any other set of a large group holds."""
    if len(sets) < 2:
        return []
    shared = np.array([len(s) for s in sets])
    if len(sets) > PROBE:
        sets, shared = rare_first(sets)
    order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    root, count = build_tree(sets), len(sets)
    size = np.array([len(s) for s in sets])
    # from here sets go by their place in the order of size; ``spot`` is that in the tree
    spot = np.argsort(size, kind="stable")
    size, place, shared = size[spot], np.argsort(spot), shared[order][spot]
    until = np.searchsorted(size, 100 * size // PERCENT, "right")
    label, members = np.arange(count), {k: [k] for k in range(count)}
    if count > PROBE:
        # n-grams among the first ones of each set, and the sets that have them, smaller ones first
        first = prefix_length(size)
        grams = np.concatenate([sets[k][:p] for k, p in zip(spot.tolist(), first.tolist(), strict=True)]).astype(np.int64)
        keys = np.sort(grams * count + np.repeat(np.arange(count), first))

    def join(x: int, y: int) -> None:
        a, b = int(label[x]), int(label[y])
        if a != b:
            a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            label[members[b]] = a
            members[a] += members.pop(b)

    for x in range(count):
        own, n = sets[spot[x]], int(size[x])
        if shared[x] < least_overlap(n, n):
            continue
        found = x + 1 + np.flatnonzero(label[x + 1 : until[x]] != label[x])
        if len(found) > PROBE:
            probe = own[: first[x]].astype(np.int64) * count
            low, high = np.searchsorted(keys, probe + x + 1), np.searchsorted(keys, probe + until[x])
            met = high > low
            hits = [keys[a:b] for a, b in zip(low[met].tolist(), high[met].tolist(), strict=True)]
            found, times = np.unique(np.concatenate([keys[:0], *hits]) % count, return_counts=True)
            found = found[(times >= shared_firsts(n)) & (label[found] != label[x])]
        found = found[np.minimum(shared[x], shared[found]) >= least_overlap(n, size[found])]
        if not len(found):
            continue
        stack = [(root, 0, np.sort(spot[found]))]
        while stack:
            node, overlap, wanted = stack.pop()
            if len(node.grams):
                at = np.searchsorted(own, node.grams)
                at[at == n] = 0
                overlap += int((own[at] == node.grams).sum())
                passed = int(np.searchsorted(own, node.grams[-1], "right"))
                if overlap + n - passed < least_overlap(n, max(node.smallest, n)):
                    continue
            below = int(np.searchsorted(wanted, node.child_low[0])) if node.children else len(wanted)
            for y in wanted[:below].tolist():
                if overlap >= least_overlap(n, len(sets[y])):
                    join(x, int(place[y]))
            if below < len(wanted):
                wanted = wanted[below:]
                child = np.searchsorted(node.child_low, wanted, "right") - 1
                edge = np.flatnonzero(np.diff(child)) + 1
                stack += [(node.children[child[0 if not k else edge[k - 1]]], overlap, part) for k, part in enumerate(np.split(wanted, edge))]
    out = []
    for rows in members.values():
        own = sorted(ids[spot[k]] for k in rows)
        out += [(own[0], i) for i in own[1:]]
    return out


def in_any(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents of ``groups`` and few others, by a list of at most SIEVE rows, whatever
    the groups; it keeps most other texts out of a shuffle."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    sieve = F.broadcast(groups.select(part.alias("part")).distinct())
    return docs.select("doc_id", "text", part.alias("part")).join(sieve, "part", "left_semi").drop("part")


def exact_prefixes(docs: DataFrame, heavy: DataFrame, order: Shared, n: int = WORDS) -> DataFrame:
    """``(doc_id, n, prefix)`` of the documents ``heavy (doc_id)``, their n-grams by how many of them hold each.

    The n-grams that ``order`` knows as frequent come last, unshuffled, and of those no more than a prefix can
    need; the others are counted in a table, so that an own n-gram always comes before a shared one, however
    many are shared.
    """

    def spell(batches):
        for piece in pieces(batches):
            sets = [order.value.order(g) for g in gram_sets(texts_of(piece), n)]
            cold = [int(np.searchsorted(g, _TOP)) for g in sets]
            sent = [g[: max(c, prefix_length(len(g)))] for g, c in zip(sets, cold, strict=True)]
            times = [len(g) for g in sent]
            grams = np.concatenate([*sent, np.zeros(0, np.uint64)])
            ids = np.repeat(np.asarray(piece.column("doc_id")), times)
            sizes = np.repeat(np.array([len(g) for g in sets], np.int64), times)
            step = 1 << 18
            for at in range(0, len(grams), step):
                part = slice(at, at + step)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(sizes[part]), pa.array(grams[part].view(np.int64))], names=["doc_id", "n", "g"])

    def pack(batches):
        for batch in batches:
            prefix = [np.array(x, np.int64).tobytes() for x in batch.column("prefix").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(prefix, pa.binary())], names=["doc_id", "n", "prefix"])

    near = in_any(docs, heavy).join(heavy, "doc_id", "left_semi")
    spelled = near.mapInArrow(spell, "doc_id bigint, n bigint, g bigint")
    # a window spills where a table in a task would not fit; the top bit, a negative number, marks the frequent
    held = F.count("*").over(Window.partitionBy("g"))
    counted = spelled.filter("g >= 0").withColumn("held", held).unionAll(spelled.filter("g < 0").withColumn("held", F.lit(1 << 62)))
    firsts = counted.groupBy("doc_id").agg(
        F.max("n").alias("n"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("held", "g"))), lambda x: x["g"])).alias("all")
    )
    return firsts.select("doc_id", "n", F.slice("all", F.lit(1), prefix_sql(F.col("n")).cast("int")).alias("prefix")).mapInArrow(
        pack, "doc_id bigint, n bigint, prefix binary"
    )


def candidate_groups(docs: DataFrame, once: DataFrame, order: Shared, n: int = WORDS, refine_grams: int = REFINE_GRAMS) -> DataFrame:
    """``(node, n, component)``: groups that no similar pair leaves, from ``once (doc_id, n, prefix)``.

    Where the order knows too few of the frequent n-grams, those chain documents that have little in common.
    So the documents of large groups are looked at again, by ``exact_prefixes``; small groups stay.
    """
    buckets = lambda grams: max(1, (grams or 0) // BUCKET_GRAMS)
    grams = once.agg(F.sum(prefix_sql(F.col("n")))).first()[0]
    member = components(candidate_links(once, buckets(grams))).join(once.select(F.col("doc_id").alias("node"), "n").distinct(), "node")
    member = durable(member, "member")
    weight = member.groupBy("component").agg(F.sum("n").alias("w"))
    heavy = member.join(weight.filter(F.col("w") > refine_grams), "component", "left_semi").select(F.col("node").alias("doc_id"), "n", "component")
    heavy = durable(heavy, "heavy")
    grams = heavy.agg(F.sum(prefix_sql(F.col("n")))).first()[0]
    if not grams:
        return member
    again = durable(exact_prefixes(docs, heavy.select("doc_id"), order, n), "prefixes")
    refined = components(candidate_links(again, buckets(grams)))
    release(again)
    light = member.join(heavy.select("component").distinct(), "component", "left_anti")
    refined = refined.join(heavy.select(F.col("doc_id").alias("node"), "n").distinct(), "node")
    return durable(light.select("node", "n", "component").unionAll(refined.select("node", "n", "component")), "member")


def similar_links(docs: DataFrame, groups: DataFrame, order: Shared, n: int = WORDS) -> DataFrame:
    """``(a, b)``: links within the groups ``grp`` of ``(doc_id, grp, bundle, part)``, by a prefix tree each;
    a task works on the groups of one bundle and part."""

    def join(table: pa.Table) -> pa.Table:
        members: dict[int, dict[int, bytes]] = {}
        for doc_id, text, grp in zip(table["doc_id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist(), table["grp"].to_pylist(), strict=True):
            members.setdefault(grp, {}).setdefault(doc_id, text)
        links = []
        for rows in members.values():
            ids = sorted(rows)
            links += tree_links(ids, [order.value.order(g) for g in gram_sets([rows[i] for i in ids], n)])
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return in_any(docs, groups).join(groups, "doc_id").groupBy("bundle", "part").applyInArrow(join, "a bigint, b bigint")


def link_documents(
    docs: DataFrame, n: int = WORDS, hot_limit: int = HOT_LIMIT, block_grams: int = BLOCK_GRAMS, refine_grams: int = REFINE_GRAMS
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every document.

    A document's set is its distinct n-grams, a shorter text being one; two link when 100 * common >=
    75 * union. ``component_id`` is the smallest doc_id reachable. A null or empty text has an empty set
    and links with nothing. Rows with the same doc_id are one document and each get their row. A null doc_id
    takes no part and its component is null. Copies of a set meet in its fingerprint (size and 128 bits),
    n-grams are compared by 63 bits. Other columns are not looked at.
    """
    spark = docs.sparkSession
    order = Shared(spark, HotOrder(frequent_grams(docs, hot_limit, n)))
    sets = durable(signatures(docs, order, n), "sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    copies = ["n", "sig_a", "sig_b"]
    firsts = durable(known.groupBy(*copies).agg(F.min("doc_id").alias("doc_id")), "firsts")
    once = known.join(firsts.select("doc_id"), "doc_id", "left_semi")
    member = candidate_groups(docs, once, order, n, refine_grams)
    slim = durable(sets.drop("prefix"), "sizes")
    release(sets)
    known = slim.filter("n > 0 AND doc_id IS NOT NULL")
    # groups too large for one task are cut into blocks; every pair of blocks meets in a task
    weight = member.groupBy("component").agg(F.sum("n").alias("w"))
    weight = weight.withColumn("k", F.ceil(F.col("w") / F.lit(block_grams)).cast("int"))
    small = int(weight.filter("k = 1").agg(F.sum("w")).first()[0] or 0)
    bundles = max(1, 2 * small // block_grams)
    placed = member.join(weight, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    others = F.sequence(F.lit(0), F.col("k") - 1)
    meets = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(others, lambda o: o != F.col("own")))
    alone = F.col("k") == 1
    groups = placed.withColumn("other", F.explode(meets)).select(
        F.col("node").alias("doc_id"), F.col("component").alias("grp"),
        F.when(alone, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.col("component")).alias("bundle"),
        F.when(alone, F.lit(-1)).otherwise(F.least("own", "other") * F.col("k") + F.greatest("own", "other")).alias("part"),
    )
    groups = durable(groups.distinct(), "groups")
    links = similar_links(docs, groups, order, n)
    same = known.join(firsts.select(*copies, F.col("doc_id").alias("first")), copies).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(links.unionAll(same))
    return (
        slim.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns; of rows that
    share a doc_id one stays. Documents with an empty set or a null doc_id all stay."""
    linked = durable(link_documents(docs, n).filter("doc_id = component_id").select("doc_id").distinct(), "kept")
    place = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    name = "place"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    once = docs.join(linked, "doc_id", "left_semi").withColumn(name, F.row_number().over(place))
    once = once.filter(F.col(name) == 1).drop(name)
    return once.select(*docs.columns).unionAll(docs.filter("doc_id IS NULL"))
