"""Shapes shared by the operators: words of a text, pieces of Arrow batches, broadcast blocks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Task functions travel by value, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that a task works on at once.
PIECE_BYTES = 2 << 20

_WORD = bytes([c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)])
# Lower-cases A-Z; white space is \x20 and \x09-\x0D, as in bytes.split().
_LOWER = bytes([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes; none of a null."""
    return text.translate(_WORD).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; none of a null."""
    return text.translate(_LOWER).split() if text else []


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as bytes: no decoding, so no trouble with broken UTF-8."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, a longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name).cast(pa.binary())), 0)).astype(np.int64).cumsum()
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def map_pieces(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema, name: str = "text") -> DataFrame:
    """``f`` over slices of bounded size."""

    def run(batches):
        for piece in pieces(batches, name):
            yield f(piece)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows for which ``mask`` of their slice is true, all columns as they are."""

    def f(piece):
        return piece.filter(pa.array(mask(piece)))

    return map_pieces(df, f, df.schema)


def text_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts, by one aggregate."""
    return int(df.agg(F.sum(F.octet_length(name))).first()[0] or 0)


def unit(key, seed: int):
    """A number above 0 and below 1 that follows from ``key`` alone; the same in SQL by md5."""
    text = F.concat(key.cast("string"), F.lit(f"/{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


class Shared:
    """A broadcast object of any class: it travels pickled by value and is opened once a task."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "_opened" not in self.__dict__:
            self._opened = cloudpickle.loads(self._sent.value)
        return self._opened

    def release(self) -> None:
        """Take it away from the executors once its last reader has run."""
        self._sent.unpersist()

    def __getstate__(self):
        return {"_sent": self._sent}
