"""Normalise, tokenise and count words inside one row, so that no shuffle is needed for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a price, a year and a token.
PRICE_PATTERN = r"[$£€]([,\p{Nd}]+(\.)?\p{Nd}+)"
YEAR_PATTERN = r"[\p{Nd}]{4}"
PRICE_MARK = "@PRICE@"
YEAR_MARK = "@YEAR@"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|@[\p{L}\p{N}_]+@"

BAG_TYPE = "array<struct<term:string,n:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A plain projection does not give that: the optimiser may merge two projections, and an
    expression merged into a lambda runs once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keys: list[str], generator: Column, *names: str) -> DataFrame:
    """``df.select(keys, generator)`` for an outer generator over a costly array.

    For an inner one the optimiser infers the filter ``size(array) > 0``, computes the array a
    second time for it, and may do so ahead of ``spread``.
    """
    made = df.select(*keys, generator.alias(*names) if names else generator)
    return made.filter(F.col(made.columns[-1]).isNotNull())


def normalize(text: Column) -> Column:
    """Lower case, then prices and four-digit runs replaced by upper-case marks."""
    priced = F.regexp_replace(F.lower(text), PRICE_PATTERN, PRICE_MARK)
    return F.regexp_replace(priced, YEAR_PATTERN, YEAR_MARK)


def tokens(
    text: Column,
    stop_words: Iterable[str] | None = None,
    preprocess: Callable[[Column], Column] = normalize,
    pattern: str = TOKEN_PATTERN,
) -> Column:
    """All tokens of a text in order, stop words left out if a list is given."""
    found = F.regexp_extract_all(
        preprocess(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)
    )
    words = sorted(set(stop_words)) if stop_words else []
    return F.filter(found, lambda t: ~t.isin(words)) if words else found


def guarded(token_array: Column) -> Column:
    """A text without any token counts as holding one empty word."""
    return let(
        token_array,
        lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(""))),
    )


def bag(token_array: Column) -> Column:
    """Distinct tokens with their counts, as run lengths of the sorted tokens."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )

        def lengths(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
            return F.zip_with(
                at,
                ends,
                lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("n")),
            )

        return F.when(F.size(s) > 0, let(starts, lengths)).otherwise(
            F.array().cast(BAG_TYPE)
        )

    return let(F.sort_array(token_array), runs)


def split_words(text: Column) -> Column:
    """Lower-cased pieces between white space, punctuation kept."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"\s+")).otherwise(
        F.array().cast("array<string>")
    )


def tagged(source: Column, tag: str) -> Column:
    """The inner text of every element of that name, in order of appearance."""
    return F.regexp_extract_all(
        source, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)
    )
