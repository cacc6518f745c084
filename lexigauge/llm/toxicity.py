"""Toxicity of a text: a small recurrent network over overlapping windows of words.

A word enters by what its own hash and those of its character n-grams tell, counted over labelled
documents. A gated recurrent network reads a window forwards and backwards, attention pools its
states, and the highest window makes the document's score. All is trained in numpy.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared, letter_words, map_pieces, texts_of
from lexigauge.operators.tables import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Labelled documents that are learned from, clean and toxic ones, at most, and the characters of all that are
# held for it: whole texts, fewer of them where they are long.
TRAIN_DOCS = (4000, 1500)
TRAIN_CHARS = 24_000_000
# Parts of the labelled texts that are each read with the odds of the others.
FOLDS = 4
# Words of a window, and words between the starts of two.
WINDOW = 32
STRIDE = 16
HIDDEN = 8
BUCKETS = 1 << 17
STEPS = 160
BATCH = 384
PRIOR = 3.0  # documents by which a bucket's odds are drawn to none
RATE = 0.02
SEED = 5
THRESHOLD = 0.3
LANES = 4096
# Words whose inputs a task remembers.
CACHE_WORDS = 400_000
INPUTS = 4

DIGEST = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words one after the other, and where each word's begin: first that of the
    word, then those of its character 3- to 5-grams with its ends marked."""
    marked = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(marked))
    owners = [np.arange(len(words))]
    found = [np.array([zlib.crc32(w) for w in words], np.uint64) * np.uint64(BUCKETS) >> np.uint64(32)]
    with np.errstate(over="ignore"):
        for k in (3, 4, 5):
            at = np.flatnonzero(left >= k)
            h = np.full(len(at), k, np.uint64)
            for i in range(k):
                h = (h + marked[at + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            owners.append(word[at])
            found.append(h >> np.uint64(64 - BUCKETS.bit_length() + 1))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(words)))
    return np.concatenate(found)[order].astype(np.int64), begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Weights: for each direction input (INPUTS, 3H), recurrent (H, 3H) and bias (3H), gates in the
    order update, reset, new; attention (2H); output (2H) and its constant."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"wx{d}"] = draw.normal(0, 0.4, (INPUTS, 3 * h))
            self.p[f"wh{d}"] = draw.normal(0, 0.3, (h, 3 * h))
            self.p[f"b{d}"] = np.zeros(3 * h)
        self.p["att"] = draw.normal(0, 0.3, 2 * h)
        self.p["out"] = draw.normal(0, 0.3, 2 * h)
        self.p["c"] = np.zeros(1)

    def load(self, other: Network, kind) -> Network:
        self.p = {k: v.astype(kind) for k, v in other.p.items()}
        return self

    def direction(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: bool):
        """States (T, lanes, H) from input gates (T, lanes, 3H); with ``keep`` what the way back needs."""
        h, w = HIDDEN, self.p[f"wh{d}"]
        steps = range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1)
        state = np.zeros((gates.shape[1], h), gates.dtype)
        states = np.empty((*gates.shape[:2], h), gates.dtype)
        kept = {}
        for t in steps:
            rec = state @ w
            zr = _sigmoid(gates[t, :, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * rec[:, 2 * h :])
            after = new + z * (state - new)
            after *= mask[t][:, None]
            if keep:
                kept[t] = (state, z, r, new, rec[:, 2 * h :])
            state = states[t] = after
        return states, kept

    def pool(self, both: np.ndarray, mask: np.ndarray):
        a = both @ self.p["att"] + np.where(mask > 0, 0, -30).astype(both.dtype)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tl,tlh->lh", a, both)
        return a, pooled, pooled @ self.p["out"] + self.p["c"]

    def logits(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.direction(d, gates[d], mask, False)[0] for d in "fb"], axis=2)
        return self.pool(both, mask)[2]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Loss and gradients for inputs (T, lanes, INPUTS)."""
        p, h = self.p, HIDDEN
        runs = {d: self.direction(d, x @ p[f"wx{d}"] + p[f"b{d}"], mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        a, pooled, logit = self.pool(both, mask)
        prob = _sigmoid(logit)
        loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
        g = {}
        dl = (prob - y) / len(y)
        g["out"], g["c"] = pooled.T @ dl, np.array([dl.sum()])
        dpool = dl[:, None] * p["out"]
        da = np.einsum("tlh,lh->tl", both, dpool)
        da = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tl,tlh->h", da, both)
        dboth = a[:, :, None] * dpool + da[:, :, None] * p["att"]
        for i, d in enumerate("fb"):
            kept, w = runs[d][1], p[f"wh{d}"]
            dgates = np.zeros((*x.shape[:2], 3 * h))
            gw, carry = np.zeros_like(w), np.zeros((x.shape[1], h))
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                state, z, r, new, rec = kept[t]
                dh = (dboth[t, :, i * h : (i + 1) * h] + carry) * mask[t][:, None]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = dnew * rec * r * (1 - r)
                drec = np.concatenate([dz, dr, dnew * r], axis=1)
                dgates[t] = np.concatenate([dz, dr, dnew], axis=1)
                gw += state.T @ drec
                carry = dh * z + drec @ w.T
            g[f"wh{d}"] = gw
            g[f"wx{d}"] = np.einsum("tli,tlg->ig", x, dgates)
            g[f"b{d}"] = dgates.sum(axis=(0, 1))
        return loss, g


def window_starts(n: int) -> list[int]:
    """First words of a text's windows: all words are covered, neighbours overlap."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


@dataclass
class ToxicityModel:
    odds: np.ndarray  # log odds of a hash bucket
    network: Network
    slope: float  # of the logistic curve over the highest window
    shift: float

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Odds of each word; the highest and the mean odds of its character n-grams; its length."""
        if not words:
            return np.zeros((0, INPUTS))
        flat, begin = buckets(words)
        odds = self.odds[flat]
        own = odds[begin]
        odds[begin] = -np.inf  # leaves the n-grams
        high = np.maximum.reduceat(odds, begin)
        odds[begin] = 0
        n = np.diff(np.append(begin, len(flat))) - 1
        size = np.array([len(w) for w in words])
        return np.stack([own, high, np.add.reduceat(odds, begin) / n, np.minimum(size, 24) / 12 - 1], axis=1)

    def windows(self, texts: list[bytes | None], known: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window its text, its first word there, and its logit."""
        lists = [letter_words(t) for t in texts]
        known.learn(self, {w for x in lists for w in x})
        flat = np.fromiter(map(known.number.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        flat = np.append(flat, np.zeros(WINDOW, np.int64))
        n = np.array([len(x) for x in lists], np.int64)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW + STRIDE) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        first, size = np.repeat(np.cumsum(n) - n, count) + start, np.minimum(WINDOW, n[owner] - start)
        logit = np.zeros(len(owner), np.float32)
        step = np.arange(WINDOW)[:, None]
        for s in range(0, len(first), LANES):
            lanes = slice(s, s + LANES)
            mask = (step < size[None, lanes]).astype(np.float32)
            word = flat[first[None, lanes] + step] * (mask > 0)
            logit[lanes] = self.network.logits({d: known.gates[d][word] for d in "fb"}, mask)
        return owner, start, logit

    def highest(self, texts: list[bytes | None], known: WordTable) -> np.ndarray:
        """Highest window logit of each text; minus infinity without words."""
        owner, _, logit = self.windows(texts, known)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        return best

    def score(self, texts: list[bytes | None], known: WordTable) -> np.ndarray:
        return _sigmoid(self.slope * np.clip(self.highest(texts, known), -12, 12) + self.shift)


class WordTable:
    """Numbers of the words met so far and their input gates; the number 0 is no word. It starts anew
    beyond CACHE_WORDS, so its size is bounded."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gates = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}

    def learn(self, model: ToxicityModel, words: set[bytes]) -> None:
        if len(self.number) > CACHE_WORDS:
            self.__init__()
        new = [w for w in words if w not in self.number]
        x, p = model.inputs(new).astype(np.float32), model.network.p
        self.number.update(zip(new, range(len(self.number) + 1, len(self.number) + 1 + len(new)), strict=True))
        self.gates = {d: np.concatenate([g, x @ p[f"wx{d}"] + p[f"b{d}"]]) for d, g in self.gates.items()}


def bucket_counts(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clean and toxic documents that hold each hash bucket, and how many of either there are."""
    sets = [sorted(set(letter_words(t))) for t in texts]
    words = sorted({w for x in sets for w in x})
    flat, begin = buckets(words)
    end = np.append(begin[1:], len(flat))
    number = {w: k for k, w in enumerate(words)}
    counts = np.zeros((2, BUCKETS))
    for own, label in zip(sets, y, strict=True):
        if own:
            found = np.unique(np.concatenate([flat[begin[k] : end[k]] for k in map(number.__getitem__, own)]))
            counts[int(label), found] += 1
    return counts, np.array([(y == 0).sum(), (y == 1).sum()])[:, None]


def bucket_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of toxic against clean documents for each hash bucket, by presence."""
    rate = (counts + PRIOR * n / max(1, n.sum())) / (n + PRIOR)
    return np.clip(np.log(rate[1] / rate[0]), -3, 5)


def fit(texts: list[bytes], y: np.ndarray) -> ToxicityModel:
    """Network of labelled texts. A toxic text's windows count as toxic where its most telling words
    are, and as neither elsewhere; all windows of a clean text are clean."""
    y = np.asarray(y, float)
    if not len(texts) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(np.zeros(BUCKETS), Network().load(Network(), np.float32), 0.0, float(np.log(rate / (1 - rate))))
    # each fold is learned from with the odds of the others, as unseen texts are read
    fold = [np.arange(len(texts)) % FOLDS == k for k in range(FOLDS)]
    counted = [bucket_counts([t for t, h in zip(texts, f, strict=True) if h], y[f]) for f in fold]
    counts, n = (sum(x) for x in zip(*counted, strict=True))
    odds = [bucket_odds(counts - c, n - m) for c, m in counted]
    net = Network()
    words = [letter_words(t) for t in texts]
    inputs: list[np.ndarray] = [np.zeros((0, INPUTS))] * len(texts)
    for k in range(FOLDS):
        own = np.flatnonzero(fold[k]).tolist()
        every = sorted({w for i in own for w in words[i]})
        number, table = {w: n for n, w in enumerate(every)}, ToxicityModel(odds[k], net, 1.0, 0.0).inputs(every)
        for i in own:
            if words[i]:
                inputs[i] = table[[number[w] for w in words[i]]]
    draw = np.random.default_rng(SEED)
    toxic, clean = [], []
    for x, label in zip(inputs, y, strict=True):
        starts = window_starts(len(x))
        if not starts:
            continue
        telling = np.array([(x[s : s + WINDOW, 0] + x[s : s + WINDOW, 1]).max() for s in starts])
        if label:
            chosen = np.flatnonzero(telling >= max(telling.max() - 1.0, 1.0))[:6]
        else:  # the least obvious ones and some others
            chosen = np.unique([telling.argmax(), *draw.integers(0, len(starts), 5)])
        (toxic if label else clean).extend(x[starts[k] : starts[k] + WINDOW] for k in chosen)
    descend(net, toxic, clean, [], draw)
    # the clean windows that it takes for toxic are shown to it again
    hard = []
    for k in range(FOLDS):
        unmarked = np.flatnonzero((y == 0) & fold[k])
        shown = ToxicityModel(odds[k], Network().load(net, np.float32), 1.0, 0.0)
        owner, start, logit = shown.windows([texts[i] for i in unmarked], WordTable())
        hard += [inputs[unmarked[o]][s : s + WINDOW] for o, s in zip(owner[logit > -3], start[logit > -3], strict=True)]
    descend(net, toxic, clean, hard, draw)
    net.load(net, np.float32)
    best = np.zeros(len(texts))
    for k in range(FOLDS):
        best[fold[k]] = ToxicityModel(odds[k], net, 1.0, 0.0).highest([t for t, h in zip(texts, fold[k], strict=True) if h], WordTable())
    slope, shift = logistic(np.clip(best, -12, 12), y)
    return ToxicityModel(bucket_odds(counts, n), net, slope, shift)


def descend(net: Network, toxic: list, clean: list, hard: list, draw) -> None:
    """STEPS of Adam over batches of half toxic, half clean windows, of which half are hard ones if any."""
    pools = [(toxic, BATCH // 2), (clean, BATCH // 4 if hard else BATCH // 2), (hard, BATCH // 4)]
    pools = [(p, n) for p, n in pools if p]
    labels = np.concatenate([np.full(n, float(p is toxic)) for p, n in pools])
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        picked = [p[k] for p, n in pools for k in draw.integers(0, len(p), n)]
        x, size = np.zeros((WINDOW, len(picked), INPUTS)), np.array([len(w) for w in picked])
        for k, w in enumerate(picked):
            x[: len(w), k] = w
        _, g = net.gradient(x, (np.arange(WINDOW)[:, None] < size).astype(float), labels)
        rate = RATE * (1 - step / (STEPS + 1)) + 1e-4
        for k, v in g.items():
            v = np.clip(v, -1, 1)
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve nearest to ``y``, with a little pull towards 1 and 0."""

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - y * z).sum() + 0.25 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.5 * (a - 1), (p - y).sum() + 0.5 * b])
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.5]])
        move = np.linalg.solve(h, g)
        # a whole step may lead away where the curve is flat
        while loss(a - move[0], b - move[1]) > loss(a, b) and np.abs(move).max() > 1e-9:
            move = move / 2
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = TRAIN_DOCS) -> ToxicityModel:
    """Model of at most ``most`` labelled clean and toxic documents with whole texts, TRAIN_CHARS in all.

    They are the first by a hash of their ids, of either label those whose running length stays within half
    of TRAIN_CHARS, the first one in any case. Null labels do not count; of several label rows of
    a document the larger stands; of several rows of a document the first text.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sides = [known.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in enumerate(most)]
    sample = F.broadcast(sides[0].unionAll(sides[1]))  # sum(most) rows
    found = durable(docs.select("doc_id", "text").join(sample, "doc_id"), "labelled")
    found = found.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = found.withColumn("held", F.coalesce(F.sum(F.length("text")).over(so_far), F.lit(0)) + F.length("text"))
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")))
    rows = held.filter((F.col("held") <= TRAIN_CHARS // 2) | (F.col("place") == 1)).select("doc_id", "y", "text").toLocalIterator()
    rows = sorted((r[0], r[1], r[2].encode()) for r in rows)
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], float))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document.

    ``score`` is the calibrated probability of label 1 of the highest window; a null, empty or wordless
    text has the score of the lowest possible window. Repeated rows each get their row; other columns
    are not looked at. Without labels of both classes all scores are the share of label 1.
    """
    shared = Shared(docs.sparkSession, model)
    memory: dict = {}

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(texts_of(piece), memory.setdefault("words", WordTable()))
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()), piece.column("held_out"), pa.array(s.astype(float)), pa.array((s >= THRESHOLD).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"])

    return map_pieces(docs.select("doc_id", "text", held_out().alias("held_out")), f, DIGEST)
