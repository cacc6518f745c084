"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key divided by its quality weight; the smallest keys of a source
come first. Whole epochs of a source precede the fraction that the keys choose. No source is ever
sorted in one task: sums over key ranges find the range in which the budget ends, and only that
range's documents are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import unit
from lexigauge.operators.tables import durable

# Fixed values of the contract.
SOURCE_WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2

# Key ranges of a source; the documents of one range are ordered by a window.
RANGES = 1 << 16
SEED = 7
MARKS = "!*#$%&|"


def word_size(text: Column) -> Column:
    """White-space separated words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.05 and 1: less the more marks such as * or | a text has for its words."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    share = F.coalesce(marks.cast("double") / F.greatest(size, F.lit(1)), F.lit(0.0))
    return F.greatest(F.lit(0.05), 1.0 - share)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: the budget shared by weight, no source above
    MAX_EPOCHS times its size.

    Sources fill up in the order limit / weight, so resharing the excess is one sorted pass: the
    first ones of that order are full, the rest share what is left, from the first place at which the
    share is not above the limit. One row per source, all in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in SOURCE_WEIGHTS])
    place = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(SOURCE_WEIGHTS))))).withColumn(
        "limit", F.col("source_size") * F.lit(float(MAX_EPOCHS))
    )
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1))
    budget = F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE)
    ranked = ranked.withColumn("level", (budget - F.coalesce(full, F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("place", F.row_number().over(filling))
    shared = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    level = F.min(shared).over(everything).getField("level")
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document.

    ``target / source_size`` is at most MAX_EPOCHS: its whole part is taken of every document, and
    documents in the order of their keys fill the rest of the target, each once more, as long as
    the sum before them is below it; so a source passes its target by less than one document.
    ``weight`` is a column of ``docs``, by default from the text. Null text: size 0. Null source: a
    source of its own, last in order. Rows with the same id draw the same key and go by their
    size and text. Empty table: no rows. Other columns are not looked at.
    """
    size = word_size(F.col("text"))
    quality = quality_weight(F.col("text"), F.col("size")) if weight is None else weight
    draw = unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    keyed = docs.withColumn("size", size).select(
        "doc_id", "source", "size", (-F.log(draw) / quality).alias("key"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("tie")
    )
    keyed = durable(keyed.withColumn("range", F.floor((1.0 - F.exp(-F.col("key"))) * ranges)), "mixing_keys")
    sums = durable(keyed.groupBy("source", "range").agg(F.sum("size").alias("words")), "mixing_sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    # the range in which the rest ends, and the words of the ranges before it
    so_far = Window.partitionBy("source").orderBy("range")
    before = F.coalesce(F.sum("words").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    reached = (
        sums.withColumn("before", before).alias("s").join(targets.alias("t"), same)
        .filter(F.col("before") < F.col("rest"))
        .groupBy(F.col("s.source").alias("source"))
        .agg(F.max(F.struct("range", "before")).alias("last"))
    )
    plan = targets.alias("t").join(reached.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source")), "left").select(
        F.col("t.source").alias("of"), "source_size", "target", "epochs", "rest",
        F.coalesce("last.range", F.lit(-1)).alias("end"), F.coalesce("last.before", F.lit(0)).alias("before"),
    )
    plan = durable(plan, "mixing_plan")
    placed = keyed.join(plan, F.col("source").eqNullSafe(F.col("of")))
    once = placed.filter("range != end").withColumn("again", (F.col("range") < F.col("end")).cast("bigint"))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    last = placed.filter("range = end").withColumn("again", (inside < F.col("rest")).cast("bigint"))
    return once.unionByName(last).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("again"))).alias("taken")
    )
