"""Document fingerprints by closed syncmers of words, in DataFrame and SQL functions alone.

Every word has a number, the head of its MD5. Of all runs of K words those are chosen in which the least
number stands first or last: that depends on the run alone, not on what stands around it, so an edit
leaves all anchors that it does not touch, and two anchors are never more than K - 1 words apart. A
fingerprint lists the anchors of a text in order, each as one hexadecimal digit for the words since the
anchor before it and eight for the run itself: where two texts agree can be read off it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions.text import let

K = 5
# Hexadecimal digits of a run.
DIGITS = 8
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Documents that are put in order together, and the most of such stretches that are told apart.
STRETCH = 2048
MAX_STRETCHES = 1 << 16


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAKS), "")


def fingerprint(text: Column, k: int = K) -> Column:
    """The closed syncmers of a text in order, k from 3 to 16, each the words since the one before it (0 for
    the first) and the number of its run; a text with words but without a closed run is one run as a whole."""
    digits = F.array(*[F.lit(c) for c in "0123456789abcdef"])

    def number(run: Column) -> Column:
        return F.substring(F.md5(F.array_join(run, " ")), 1, DIGITS)

    def closed(n: Column) -> Column:
        def least_at_edge(i: Column) -> Column:
            inner = [F.get(n, i + j) for j in range(1, k - 1)]
            return F.least(F.get(n, i), F.get(n, i + (k - 1))) <= (F.least(*inner) if len(inner) > 1 else inner[0])

        return F.filter(F.sequence(F.lit(0), F.size(n) - k), least_at_edge)

    def written(w: Column, places: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            return F.concat(F.get(digits, i - F.coalesce(F.get(places, j - 1), F.lit(0))), number(F.slice(w, i + 1, F.lit(k))))

        return F.array_join(F.transform(places, one), "")

    def of(w: Column) -> Column:
        heads = F.transform(w, lambda x: F.substring(F.md5(x), 1, DIGITS))
        places = F.when(F.size(w) >= k, let(heads, closed)).otherwise(F.array().cast("array<int>"))
        whole = F.when(F.size(w) > 0, F.concat(F.lit("0"), number(w))).otherwise(F.lit(""))
        return let(places, lambda p: F.when(F.size(p) > 0, written(w, p)).otherwise(whole))

    return let(words(text), of)


def runs(print_: Column) -> Column:
    """The distinct runs of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(f"[0-9a-f]([0-9a-f]{{{DIGITS}}})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: twice the runs that both hold over the runs of each; 1 for two empty ones."""

    def of(x: Column, y: Column) -> Column:
        both = F.size(x) + F.size(y)
        return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) * 2.0 / both)

    return let(runs(a), lambda x: let(runs(b), lambda y: of(x, y)))


def positions(print_: Column) -> Column:
    """``array<struct<at bigint, run string>>``: a fingerprint as anchors again."""
    cells = F.regexp_extract_all(print_, F.lit(f"[0-9a-f]{{{DIGITS + 1}}}"), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.conv(F.substring(x, 1, 1), 16, 10).cast("bigint")
        return F.struct(at.alias("at"), F.concat(s["found"], F.array(F.struct(at.alias("at"), F.substring(x, 2, DIGITS).alias("run")))).alias("found"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,run:string>>").alias("found"))
    return F.aggregate(cells, start, step, lambda s: s["found"])


def aligned(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, shift, matches, first_a, last_a)``: where the texts of given pairs agree, one row for each
    distance between places, in words; ``prints`` is ``(id, fingerprint)``. A run counts at its first place
    in a text, so a text that repeats itself makes no more rows."""

    def side(name: str) -> DataFrame:
        cells = pairs.select("a", "b").distinct().join(prints.select(F.col("id").alias(name), "fingerprint"), name)
        cells = cells.select("a", "b", F.inline(positions(F.col("fingerprint"))))
        return cells.groupBy("a", "b", "run").agg(F.min("at").alias(f"at_{name}"))

    met = side("a").join(side("b"), ["a", "b", "run"])
    return met.groupBy("a", "b", (F.col("at_b") - F.col("at_a")).alias("shift")).agg(
        F.count("*").alias("matches"), F.min("at_a").alias("first_a"), F.max("at_a").alias("last_a")
    )


def _stretch(doc_id: Column, borders: list[int]) -> Column:
    """How many of the borders, in falling order, are above the id: a binary search in a constant array."""
    if not borders:
        return F.when(doc_id.isNull(), F.lit(1)).otherwise(F.lit(0))
    table = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
    steps = [1 << b for b in range(len(borders).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) > doc_id, at + step).otherwise(at),
    )
    return F.when(doc_id.isNull(), F.lit(len(borders) + 1)).otherwise(found)


def with_next(docs: DataFrame, k: int = K, stretch: int = STRETCH, max_stretches: int = MAX_STRETCHES) -> DataFrame:
    """``(doc_id, text, fingerprint, next_text, next_fingerprint)``, next being the row after it by falling
    doc_id, rows of one doc_id by the MD5 of their text, a null doc_id last; after the last row the first.

    Ids are cut into stretches at approximate quantiles, which only deal the work: a stretch is put in order
    by one window, and its last row meets the first one of the next stretch. Each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = rows.filter("doc_id IS NOT NULL")
    parts = min(max_stretches, known.count() // stretch)
    borders = []
    if parts > 1:
        cuts = [i / parts for i in range(1, parts)]
        borders = sorted(set(known.agg(F.percentile_approx("doc_id", cuts, 4 * parts)).first()[0]), reverse=True)
    dealt = rows.withColumn("stretch", _stretch(F.col("doc_id"), borders)).withColumn("hash", F.md5("text"))
    # the first row of each stretch that has any, and the stretch before it
    first = dealt.groupBy("stretch").agg(F.max("doc_id").alias("doc_id")).collect()
    first = sorted((r["stretch"], r["doc_id"]) for r in first)
    ahead = [(first[i - 1][0], *x) for i, x in enumerate(first)]
    table = spark.createDataFrame(ahead, "of int, stretch int, doc_id bigint")
    same = dealt.alias("d").join(F.broadcast(table.alias("t")), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    border = same.groupBy("of").agg(F.min_by("d.text", "d.hash").alias("border_text"))
    border = border.select(F.col("of").alias("stretch"), "border_text", fingerprint(F.col("border_text"), k).alias("border_print"))
    placed = dealt.repartition("stretch").withColumn("fingerprint", fingerprint(F.col("text"), k))
    order = Window.partitionBy("stretch").orderBy(F.col("doc_id").desc_nulls_last(), "hash")
    placed = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("fingerprint").over(order))
    met = placed.alias("p").join(border.alias("b"), (F.col("p.stretch") == F.col("b.stretch")) & F.col("next_text").isNull(), "left")
    return met.select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "border_text").alias("next_text"),
        F.coalesce("next_print", "border_print").alias("next_fingerprint"),
    )


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    A document's edited text has its last half of code points, rounded down, replaced by as many of the
    next document's first ones, or all. ``near_edited`` and ``near_next`` are the likeness to the edited text
    and to the next document (see ``with_next``). Null text: empty, with an empty fingerprint. Null doc_id:
    after all others. Rows with the same doc_id follow each other by the hash of their text, also copies.
    A single document is its own next one. Empty table: no rows. Other columns are not looked at. A very
    long text is worked on in memory as lists of its words, some 150 bytes a word.
    """
    placed = with_next(docs, k).withColumn("n_chars", F.length("text").cast("bigint"))
    kept = F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))")
    head = F.expr("substring(next_text, 1, cast(n_chars div 2 as int))")
    edited = placed.withColumn("edited", F.concat(kept, head))
    edited = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited"), k))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
