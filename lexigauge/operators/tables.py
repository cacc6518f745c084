"""Shapes shared by all operators: durable cut points, skew-safe joins, dense numbering, ranks."""

from __future__ import annotations

import atexit
import re
import uuid
from functools import cache
from urllib.parse import urlparse
from weakref import finalize

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
MIN_CHUNK = 1_000_000
# No join ever lists more hot keys than this, whatever the size of the data.
MAX_HOT_KEYS = 10_000
# A group up to this size is ranked by one ordinary window task.
WINDOW_GROUP_LIMIT = 1_000_000


# The tables of one run of the library lie in one folder, which goes when the run ends.
_RUN = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset the session's warehouse. A warehouse
    in a file system of one machine is refused where the executors are on others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        check_shared(folder, spark.sparkContext.master)
    return f"{folder.rstrip('/')}/lexigauge-{_RUN}"


def check_shared(folder: str, master: str) -> None:
    """Raise if only the driver's machine sees the folder and tasks run on others."""
    if not master.startswith("local") and urlparse(folder).scheme in ("", "file"):
        raise ValueError(f"{folder} is on one machine; name a folder that all executors share in spark.checkpoint.dir")


@cache
def _clear_at_exit() -> None:
    atexit.register(clear)


def clear() -> None:
    """Remove every table that this run has written to the shared folder."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it
    nor depend on the executors that made it."""
    spark = df.sparkSession
    _clear_at_exit()
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    finalize(out, _paths.pop, id(out), None)
    return out


# Paths of the tables that ``durable`` has returned and that are still referred to.
_paths: dict[int, str] = {}


def release(df: DataFrame) -> None:
    """Remove the table of a frame that ``durable`` returned, when its last reader has run."""
    path = _paths.pop(id(df))
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def is_written(df: DataFrame) -> bool:
    """Is this a frame that ``durable`` returned?"""
    return id(df) in _paths


def files_of(df: DataFrame) -> list[str] | None:
    """Addresses of the files of a frame that ``durable`` returned, for tasks that read a table whole by
    themselves. None for a folder that only Spark reads."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths[id(df)])
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith("part-")]
    names = [re.sub("^file:/+", "file:///", f.toString()) for f in found]
    try:
        readable = all(files.get_file_info(path).is_file for files, path in map(FileSystem.from_uri, names[:1]))
    except (pa.ArrowException, OSError):
        readable = False
    return names if readable else None


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a scan that has fewer splits than there are cores, ahead of
    costly work per row. Large tables have more splits than that and stay as they are. For scans only:
    to count the parts of a plan that shuffles would run the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    rows_per_key: str,
    total_rows: int,
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join where ``small`` says with each key how often it occurs in ``big``.

    A key with more than a chunk of rows gets ``rows / chunk`` copies on the small side and its
    big rows are dealt out over them by a hash of ``spread``. Since a chunk is at least
    ``total / MAX_HOT_KEYS`` rows, the broadcast list of hot keys is bounded by MAX_HOT_KEYS.
    ``rows_per_key`` is dropped from the result.
    """
    chunk = max(MIN_CHUNK, -(-total_rows // MAX_HOT_KEYS))
    if total_rows <= chunk:
        return big.join(small.drop(rows_per_key), keys, how)
    fan = F.ceil(F.col(rows_per_key) / F.lit(chunk)).cast("int")
    hot = small.filter(F.col(rows_per_key) > chunk).select(*keys, fan.alias("_fan")).distinct()
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_fan")).cast("int"), F.lit(0)),
    )
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(fan, F.lit(1)) - 1))
    ).drop(rows_per_key)
    return dealt.drop("_fan").join(copies, [*keys, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Dense numbers 0, 1, 2 ... in the given order, which must be total.

    Range partitions are sorted on their own and written once; what crosses the driver is one
    count per partition. A window without partition would put every row in one task.
    """
    spark = df.sparkSession
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").count().collect()
    offsets, seen = [], 0
    for row in sorted(sizes):
        offsets.append((row[0], seen))
        seen += row[1]
    table = spark.createDataFrame(offsets or [(0, 0)], "_part bigint, _before bigint")
    row_in_part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_before") + row_in_part)
        .drop("_part", "_at", "_before")
    )


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group, by a pre-aggregated count."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def rank_in_group(
    df: DataFrame,
    by: list[str],
    order: list[Column | str],
    name: str,
    group_size: int | None = None,
    limit: int = WINDOW_GROUP_LIMIT,
) -> DataFrame:
    """Row numbers 1, 2, 3 ... inside each group, in a total order.

    Groups of bounded size use a window. Beyond the limit all rows are numbered over range
    partitions, which also cut through a group, and the group's first number is taken off.
    """
    size = largest_group(df, by) if group_size is None else group_size
    if size <= limit:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    numbered = durable(number_rows(df, [*by, *order], "_idx"), "ranked")
    starts = numbered.groupBy(*by).agg(F.min("_idx").alias("_first"), F.count("*").alias("_rows"))
    total = numbered.count()
    return (
        skew_join(numbered, starts, by, "_rows", total, ["_idx"])
        .withColumn(name, F.col("_idx") - F.col("_first") + 1)
        .drop("_idx", "_first")
    )
