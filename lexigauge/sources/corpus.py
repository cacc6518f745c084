"""Corpora: ``(doc_id, title, text)`` from tagged files, folders of files, or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.functions.text import tagged, unnest
from lexigauge.operators.tables import durable, number_rows, spread

# Ranges of ids whose counts reach the driver at once.
BUCKETS = 4096


def from_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", title: Column | None = None) -> DataFrame:
    """Documents that already are rows, in the order of their id."""
    named = F.concat(F.lit("doc"), F.col(doc_id).cast("string")) if title is None else title
    return df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), named.alias("title"), F.col(text).alias("text")
    )


def from_tagged_files(spark: SparkSession, path: str, tag: str = "TEXT") -> DataFrame:
    """Every element of that name is a document, in file order; titles are ``doc0``, ``doc1`` ...

    For elements that hold text only: of one with children Spark gives the trailing text alone.
    The numbering is written once, since a second scan may split the files differently.
    """
    found = (
        spark.read.format("xml").option("rowTag", tag).schema("_VALUE string").load(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.monotonically_increasing_id().alias("_at"),
            F.col("_VALUE").alias("text"),
        )
    )
    numbered = durable(number_rows(durable(found, "tagged"), ["_file", "_at"], "doc_id"), "corpus")
    return from_table(numbered)


def from_tagged_column(df: DataFrame, source: str, keys: list[str], tag: str) -> DataFrame:
    """The same for markup held in a column: ``keys``, place in the row, inner text."""
    found = F.posexplode_outer(tagged(F.col(source), tag))
    return unnest(spread(df.select(*keys, source)), keys, found, "position", "text")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file of a folder, ordered by path; the title is the file name."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("_file"), F.col("value").alias("text")
    )
    numbered = durable(number_rows(found, ["_file"], "doc_id"), "corpus")
    return from_table(numbered, title=F.element_at(F.split("_file", "/"), -1))


def kth_id(corpus: DataFrame, k: int, buckets: int = BUCKETS) -> int | None:
    """The k-th smallest doc_id (from 1), by histograms of ever narrower ranges: a pass counts the ids of
    each of ``buckets`` equal ranges, and the next one looks into the range that holds the k-th. Ids are
    neither sorted nor shuffled; what moves is one count per range and task."""
    low, high, count = corpus.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if k < 1 or k > count:
        return None
    while low < high:
        width = -(-(high - low + 1) // buckets)
        inside = corpus.filter(F.col("doc_id").between(low, high))
        # as decimals: the distance of two ids may be beyond 64 bits
        after = F.col("doc_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        at = F.call_function("div", after, F.lit(width).cast("decimal(20,0)"))
        for bucket, n in sorted((int(r[0]), r[1]) for r in inside.groupBy(at.alias("b")).count().collect()):
            if k <= n:
                low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
                break
            k -= n
    return low


def prefix(corpus: DataFrame, div: int) -> DataFrame:
    """First ``int(N / div)`` documents; with ``div = 1`` all but the last.

    Becomes a bound on doc_id, which the scan can use; the texts are not sorted.
    """
    n = corpus.count()
    keep = n - 1 if div == 1 else n // div
    last = kth_id(corpus, keep) if keep > 0 else None
    return corpus.filter(F.lit(False) if last is None else F.col("doc_id") <= last)


def group_size_for(n: int, n_docs: int) -> int:
    """Documents per group: ``N / n_docs`` rounded half to even. 0 means one group of all."""
    return round(n / n_docs)


def regroup_map(corpus: DataFrame, n_docs: int) -> DataFrame:
    """``(doc_id, group_id, position)``: which run of consecutive documents each belongs to."""
    numbered = number_rows(corpus.select("doc_id"), ["doc_id"])
    size = group_size_for(corpus.count(), n_docs)
    group = F.floor(F.col("idx") / size).cast("bigint") if size else F.lit(0).cast("bigint")
    return numbered.select("doc_id", group.alias("group_id"), F.col("idx").alias("position"))


def regroup(corpus: DataFrame, n_docs: int) -> DataFrame:
    """Join each run of documents into one text, every document followed by a newline.

    A last group takes the remainder and exists even when that is empty. The joined text is one
    value, so this is for groups that fit a string; ``regroup_counts`` gives the same model for
    groups of any size.
    """
    n = corpus.count()
    size = group_size_for(n, n_docs)
    joined = (
        corpus.select("doc_id", "text").join(regroup_map(corpus, n_docs), "doc_id")
        .groupBy("group_id")
        .agg(F.expr("string_agg(text || '\n', '') WITHIN GROUP (ORDER BY position)").alias("text"))
    )
    if size and n % size == 0:
        last = corpus.sparkSession.range(n // size, n // size + 1)
        joined = joined.unionByName(last.select(F.col("id").alias("group_id"), F.lit("").alias("text")))
    return joined.select(F.col("group_id").alias("doc_id"), "text")


def regroup_counts(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of the regrouped corpus from the counts of its documents.

    A newline ends every token, so the counts of a joined text are sums; they are combined before
    the shuffle and no text of a group is ever put together.
    """
    return (
        counts.join(groups.select("doc_id", "group_id"), "doc_id")
        .groupBy("group_id", "term").agg(F.sum("n").cast("bigint").alias("n"))
        .withColumnRenamed("group_id", "doc_id")
    )
