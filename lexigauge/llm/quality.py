"""Quality of a text: a kernel machine on document statistics.

A text becomes a handful of statistics. Random Fourier features approximate a Gaussian kernel over
them; ridge regression on those is solved from normal equations that each partition sums up for
itself; isotonic regression turns its value into a probability.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared, keep_rows, map_pieces, texts_of
from lexigauge.operators.tables import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 256  # random Fourier features
RIDGE = 1e-5
KERNEL_WIDTH = 8.0
SEED = 11
BINS = 1000  # values of the regression are counted in so many steps for the calibration
THRESHOLD = 0.3

DIGEST = "doc_id bigint, held_out boolean, score double, predicted int"
NAMES = (
    "log_words", "word_length", "long_words", "distinct", "upper", "digits", "marks", "ending_marks", "bars",
    "doubled", "top_word", "same_pairs", "lines", "line_words", "same_lines", "sentence_ends", "vowels", "non_ascii",
)

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_MARKS = b"*#$%&@^~<>{}[]=+_\\/"
_ENDS = b".!?"


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The statistics of NAMES; of a null or empty text those of no words."""
    text = text or b""
    words, n_bytes = text.split(), max(1, len(text))
    n = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x]
    low = text.lower()
    count = lambda chars: n_bytes - len(text.translate(None, chars)) if text else 0
    letters = n_bytes - len(low.translate(None, bytes(range(0x61, 0x7B)))) if text else 0
    return (
        float(np.log1p(len(words))),
        len(text) / n,
        sum(len(w) > 14 for w in words) / n,
        len(counts) / n,
        count(_UPPER) / n_bytes * 4,
        count(_DIGIT) / n_bytes * 4,
        count(_MARKS) / n_bytes * 8,
        sum(text.count(m) for m in (b"!!", b"***", b"$$$", b"###", b"%%%", b"&&&")) / n,
        text.count(b"|") / n * 2,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(counts.values(), default=0) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        float(np.log1p(len(lines))),
        float(np.log1p(len(words) / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        count(_ENDS) / n,
        (n_bytes - len(low.translate(None, b"aeiou"))) / max(1, letters) if text else 0.0,
        (n_bytes - len(text.translate(None, bytes(range(0x80, 0x100))))) / n_bytes if text else 0.0,
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the random features and a constant
    steps: np.ndarray  # ends of the calibration's steps
    levels: np.ndarray  # probability of each

    def value(self, x: np.ndarray) -> np.ndarray:
        return features((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, between the steps' middles by interpolation."""
        if not len(self.steps):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.value(x), self.steps, self.levels), 0.0, 1.0)


def projection(dim: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.normal(size=(dim, FEATURES)) / KERNEL_WIDTH, draw.uniform(0, 2 * np.pi, FEATURES)


def features(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics (cut to 4 deviations), and a constant."""
    w, phase = projection(x.shape[1])
    z = np.cos(np.clip(x, -4, 4) @ w + phase) * np.sqrt(2 / FEATURES)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x array<double>)``, one row per document."""

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts_of(piece)])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), flat], names=["doc_id", "x"])

    return map_pieces(docs.select("doc_id", "text"), f, "doc_id bigint, x array<double>")


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(NAMES))


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of z z' with the label as last column of z, summed within partitions, then line by line of the matrix."""

    width = FEATURES + 2

    def sums(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate([features((_stack(batch.column("x")) - mean) / scale), np.asarray(batch.column("y"))[:, None]], axis=1)
                total, n = total + z.T @ z, n + len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([r.tobytes() for r in total], pa.binary())], names=["line", "s"])

    def add(batches):
        lines = {}
        for batch in batches:
            for line, s in zip(batch.column("line").to_pylist(), batch.column("s").to_pylist(), strict=True):
                lines[line] = np.frombuffer(s) + lines.get(line, 0)
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64()), pa.array([v.tobytes() for v in lines.values()], pa.binary())], names=["line", "s"])

    schema = "line bigint, s binary"
    # width lines of width numbers for the driver, however many partitions
    found = rows.select("x", "y").mapInArrow(sums, schema).repartition("line").mapInArrow(add, schema).collect()
    total = np.zeros((width, width))
    for line, s in found:
        total[line] = np.frombuffer(bytes(s))
    return total, rows.count()


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing values nearest to ``y`` with weights ``w``, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on all labelled documents that are not held out.

    Null labels and repeated label rows of a document (the larger label stands) do not count twice.
    """
    marked = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = durable(stats.filter(~held_out()).join(marked, "doc_id").select("x", "y"), "quality_rows")
    k = len(NAMES)
    moments = rows.agg(*[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)]).first()
    mean = np.array([v or 0.0 for v in moments[:k]])
    scale = np.array([max(v or 0.0, 1e-3) for v in moments[k:]])
    s, n = normal_equations(rows, mean, scale)
    if not n:
        return QualityModel(mean, scale, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    a, b = s[:-1, :-1], s[:-1, -1]
    weights = np.linalg.solve(a + RIDGE * n * np.eye(len(a)) / FEATURES, b)
    raw = QualityModel(mean, scale, weights, np.zeros(0), np.zeros(0))
    shared = Shared(rows.sparkSession, raw)

    def values(batches):
        for batch in batches:
            v = np.clip(shared.value.value(_stack(batch.column("x"))), -1, 2) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(v * BINS).astype(np.int64)), pa.array(v), batch.column("y")], names=["bin", "v", "y"])

    # at most 3 * BINS + 1 rows
    counted = rows.mapInArrow(values, "bin bigint, v double, y double").groupBy("bin")
    counted = counted.agg(F.avg("v").alias("v"), F.avg("y").alias("y"), F.count("*").alias("w")).collect()
    counted.sort()
    v, y, w = (np.array([r[i] for r in counted], float) for i in (1, 2, 3))
    return QualityModel(mean, scale, weights, v, isotonic(y, w))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document; the texts are read once.

    ``score`` is the calibrated probability of quality 1, also for null and empty texts; 0.5 where nothing
    is labelled. Repeated rows each get their row; other columns are not looked at.
    """
    stats = durable(document_statistics(docs), "statistics")
    shared = Shared(docs.sparkSession, train(stats, labels))

    def f(batches):
        for batch in batches:
            s = shared.value.score(_stack(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", held_out()).mapInArrow(f, DIGEST)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a score of THRESHOLD or more, with all their columns."""
    shared = Shared(docs.sparkSession, train(durable(document_statistics(docs), "statistics"), labels))

    def mask(piece: pa.RecordBatch) -> np.ndarray:
        return shared.value.score(np.array([statistics(t) for t in texts_of(piece)])) >= THRESHOLD

    return keep_rows(docs, mask)
